"""The public surface: an engine converts a column of Latin-typed text to Persian script, with alternatives and spans.

Plan: words are counted (combined before the one shuffle), the commonest of them converted once each over all cores and
broadcast, a bounded number; then one scan of the texts, each scanned, converted and put together in its own row. Words
beyond the common ones are converted where they stand, and remembered by the worker. No token is shuffled, so neither a
hot word nor a long text comes into one task with others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.functions.fold import NormalForm, normalize
from harfgah.functions.tables import DEMONSTRATIVES, HOMOGRAPHS, NUMBER_WORDS
from harfgah.functions.words import englishness_of
from harfgah.operators.candidates import best_path_of
from harfgah.operators.channel import Emissions
from harfgah.operators.convert import Candidate, Converter, Scoring, Tables, rounded, unstretch
from harfgah.operators.tensors import Weights, beam, forward
from harfgah.operators.tokens import guard, scanned
from harfgah.session import parallel, spread

LOCAL_MARKS = NormalForm(digits="preserve", punctuation=True)
DETACHED = re.compile(r"h[aā]{1,2}(ye|yeh|yi|ei|yam|yat|yash|yeshaan|yetaan|yemaan|yeman|yeshan)?|tar|tarin")
RESULT = "struct<text:string,alternatives:array<string>,confidence:double,spans:array<struct<input:string,output:string,action:string,start:int,end:int,copy_reason:string,confidence:double,candidates:array<struct<output:string,probability:double,reason:string>>>>>"


RESULT_SHAPE = pa.struct(
    [("text", pa.string()), ("alternatives", pa.list_(pa.string())), ("confidence", pa.float64())]
    + [("spans", pa.list_(pa.struct(
        [("input", pa.string()), ("output", pa.string()), ("action", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("copy_reason", pa.string()), ("confidence", pa.float64())]
        + [("candidates", pa.list_(pa.struct([("output", pa.string()), ("probability", pa.float64()), ("reason", pa.string())])))]
    )))]
)


@dataclass(frozen=True)
class Options:
    alternatives: int = 3
    candidates: int = 3
    persian_punctuation: bool = True
    protect: tuple[str, ...] = ()
    force: tuple[str, ...] = ()
    #: Outputs that a model's beam keeps at each letter.
    beam: int = 8


@dataclass(slots=True)
class Span:
    input: str
    output: str
    action: str
    start: int
    reason: str | None = None
    confidence: float = 1.0
    found: list[Candidate] = field(default_factory=list)

    def become(self, output: str, reason: str, keep: bool = False) -> None:
        """One certain output; the other candidates stay with probability 0, or go."""
        others = [(o, 0.0, r) for o, _, r in self.found if o != output] if keep else []
        self.output, self.confidence, self.found = output, 1.0, [(output, 1.0, reason), *others]

    def choose(self, i: int) -> None:
        best = self.found[i]
        self.found = [best, *self.found[:i], *self.found[i + 1 :]]
        self.output, self.confidence = best[0], rounded(best[1])


#: Words that are converted beforehand and broadcast; the others are converted in the tasks, with the same results.
COMMON_WORDS = 50_000
#: Spans of an Arrow batch; a longer text has a batch of its own.
SPANS_AT_ONCE = 50_000
ENGLISH_FROM = 0.5
COPIED = {"other-script": "non-latin", "identifier": "code"}
#: The letter by which a model is told that a word ends a clause.
CLAUSE_END = "$"


class Sentence:
    """The passes over the spans of one text, in their order."""

    def __init__(self, converter: Converter, options: Options) -> None:
        self.c, self.o, self.t, self.s = converter, options, converter.t, converter.s

    def run(self, spans: list[Span]) -> None:
        linked = self.detached_link(spans)
        self.final_he(spans)
        if self.t.bigrams:
            self.context(spans)
        self.lexicon(spans)
        self.detached_possessive(spans)
        self.na_prefix(spans)
        self.numbers(spans)
        for i in linked:
            span = spans[i]
            ye = lambda o: o + "ی" if o[-1:] in ("ا", "و") else o
            if ye(span.output) != span.output:
                span.output, span.found = ye(span.output), [(ye(o), p, r) for o, p, r in span.found]
        for span in spans:
            span.found = span.found[: self.o.candidates]

    @staticmethod
    def pairs(spans: list[Span]) -> Iterator[tuple[int, Span, Span, Span]]:
        """Neighbouring spans with a single blank between them."""
        for i in range(len(spans) - 2):
            if spans[i + 1].action == "space" and spans[i + 1].input == " ":
                yield i, spans[i], spans[i + 1], spans[i + 2]

    def detached_link(self, spans: list[Span]) -> list[int]:
        linked = []
        for i, before, gap, span in self.pairs(spans):
            if before.action != "convert" or span.action != "convert":
                continue
            word = span.input.lower()
            if DETACHED.fullmatch(word):
                gap.output = ""
                if word.endswith("yeh"):
                    span.found = list(self.c.convert(word[:-1]))
                    span.choose(0)
            elif word in ("e", "ie") or (word == "ye" and before.input[-1:].lower() in tuple("aeiou")):
                gap.output = ""
                span.become("", "unwritten link")
                if word == "ye":
                    linked.append(i)
        return linked

    def final_he(self, spans: list[Span]) -> None:
        gain = math.exp(self.s.final_he)
        after = "punct"
        for span in reversed(spans):
            last = after == "punct"
            if span.action != "space":
                after = span.action
            if span.action != "convert" or not last:
                continue
            he = [len(o) > 1 and o.endswith("ه") for o, _, _ in span.found]
            if all(he) or not any(he):
                continue
            w = [max(p, 1e-6) * (gain if h else 1.0) for (_, p, _), h in zip(span.found, he, strict=True)]
            order = sorted(range(len(w)), key=lambda k: -w[k])
            span.found = [(span.found[k][0], rounded(w[k] / sum(w)), span.found[k][2]) for k in order]
            span.output, span.confidence = span.found[0][:2]

    def context(self, spans: list[Span]) -> None:
        run: list[Span] = []
        for span in [*spans, None]:
            if span and span.action == "convert" and span.found:
                run.append(span)
            elif span is None or span.action != "space":
                if len(run) > 1:
                    path = best_path_of([[(o, p) for o, p, _ in s.found] for s in run], self.t.followed, self.s.bigram)
                    for s, k in zip(run, path, strict=True):
                        if k:
                            s.choose(k)
                run = []

    def lexicon(self, spans: list[Span]) -> None:
        lex, freq = self.t.lexicon, self.t.frequency
        for span in spans if lex else ():
            if span.action != "convert" or len(span.found) < 2 or span.found[0][0] in lex or span.found[0][0] in freq:
                continue
            k = next((k for k, c in enumerate(span.found) if c[0] in lex), None)
            if k is not None and span.found[0][1] - span.found[k][1] < 0.25:
                span.choose(k)

    def detached_possessive(self, spans: list[Span]) -> None:
        for _, before, gap, span in self.pairs(spans):
            if span.action != "convert" or span.input.lower() != "ash" or before.action != "convert" or not before.output or before.output in DEMONSTRATIVES:
                continue
            typed, output = before.input.lower(), None
            if re.search("eh?$", typed):
                made = (self.c.table_form(o) for o in [before.output, *(c[0] for c in before.found)] if o.endswith("ه"))
                he = next(filter(None, made), None)
                output = he and f"{he}اش"
            elif typed[-1:] not in tuple("aeiou"):
                output = f"{before.output}ش"
            if output:
                before.become(output, "joined possessive", keep=True)
                gap.output = ""
                span.become("", "joined possessive")

    def na_prefix(self, spans: list[Span]) -> None:
        for _, span, gap, after in self.pairs(spans):
            if span.action == after.action == "convert" and span.input.lower() == "na" and after.input[:1].lower() in tuple("aeiou"):
                if output := self.c.table_form(f"نا{after.output}"):
                    span.become(output, "prefix", keep=True)
                    gap.output = ""
                    after.become("", "joined to its prefix")

    def numbers(self, spans: list[Span]) -> None:
        for _, span, _, after in self.pairs(spans):
            low = span.input.lower()
            if span.action != "convert" or len(low) < 3 or not low.endswith("o"):
                continue
            number_after = after.output in NUMBER_WORDS or after.output == "نیم" if after.action == "convert" else after.action == "copy" and re.fullmatch("[0-9۰-۹]+", after.input)
            number = next((o for o, _, _ in self.c.base(low[:-1]) if o in NUMBER_WORDS), None) if number_after else None
            if number:
                span.become(f"{number} و", "number and", keep=True)


def utf16(s: str) -> int:
    return len(s) if s.isascii() or max(s) < "\U00010000" else len(s.encode("utf-16-le", "surrogatepass")) // 2


def finished(spans: list[Span], options: Options) -> dict:
    """The nested result of one text; offsets in UTF-16 units."""
    text = "".join(s.output for s in spans)
    words = [s for s in spans if s.action == "convert"]
    confidence = math.exp(sum(math.log(max(s.confidence, 1e-9)) for s in words) / len(words)) if words else 1.0
    others: dict[str, None] = {}
    unsure = sorted((i for i, s in enumerate(spans) if s.action == "convert" and len(s.found) > 1), key=lambda i: spans[i].confidence)
    for i in unsure[: options.alternatives]:
        for o, _, _ in spans[i].found[1:]:
            other = "".join(o if k == i else s.output for k, s in enumerate(spans))
            if other != text and len(others) < options.alternatives:
                others[other] = None
    return {
        "text": text,
        "alternatives": list(others),
        "confidence": rounded(confidence),
        "spans": [
            {"input": s.input, "output": s.output, "action": s.action, "start": s.start, "end": s.start + utf16(s.input), "copy_reason": s.reason, "confidence": s.confidence, "candidates": [{"output": o, "probability": p, "reason": r} for o, p, r in s.found]}
            for s in spans
        ],
    }


def spans_of(text: str | None, converter: Converter, options: Options, force: frozenset[str], protect: frozenset[str], common: dict[str, list[Candidate]]) -> list[Span]:
    """The spans of a text before the sentence passes: what is copied, and why, and the candidates of each word."""
    s = scanned(text, force)
    shown = [i for i, k in enumerate(s.kind) if k != "space"]
    reason: dict[int, str] = {}
    soft, english = [], []
    for i in shown:
        loan = False
        if s.kind[i] == "word":
            tok, low = s.tok[i], s.tok[i].lower()
            if low in protect and low not in force:
                reason[i] = "english"
            elif low not in force:
                base = unstretch(low)[0]
                loan = converter.loan_forms(base) is not None
                if not s.starts[i] and tok[0].isupper() and tok[1:2].islower() and base not in HOMOGRAPHS:
                    reason[i], loan = "english", False
                elif not loan and englishness_of(base) >= ENGLISH_FROM:
                    reason[i] = "english"
        soft.append(loan)
        english.append(reason.get(i) == "english")
    for i, back in zip(shown, guard(soft, english), strict=True):
        if back:
            reason[i] = "english"
    out, at = [], 0
    for i, (kind, tok) in enumerate(zip(s.kind, s.tok, strict=True)):
        if kind == "word" and i not in reason:
            low = tok.lower()
            found = list(common.get(low) or converter.convert(low))
            out.append(Span(tok, found[0][0], "convert", at, None, rounded(found[0][1]), found))
        elif kind == "space":
            out.append(Span(tok, tok, "space", at))
        elif kind == "punct":
            out.append(Span(tok, normalize(tok, LOCAL_MARKS) if options.persian_punctuation else tok, "punct", at))
        else:
            out.append(Span(tok, tok, "copy", at, reason.get(i) or COPIED.get(kind, kind)))
        at += utf16(tok)
    return out


class Engine:
    """mode rules: candidates by rules and tables; hybrid: a model's outputs join the pool."""

    def __init__(self, tables: Tables | None = None, scoring: Scoring | None = None, weights: Weights | None = None, mode: str | None = None) -> None:
        self.tables, self.scoring, self.weights = tables or Tables(), scoring or Scoring(), weights
        self.mode = mode or ("hybrid" if weights else "rules")
        if self.mode not in ("rules", "hybrid", "model") or (self.mode != "rules" and not weights):
            raise ValueError(f"mode {self.mode!r} with{'' if weights else 'out'} a model")

    @property
    def has_model(self) -> bool:
        return self.weights is not None

    @property
    def has_context(self) -> bool:
        return bool(self.tables.bigrams)

    @property
    def uses_clause_marker(self) -> bool:
        """Whether a word's candidates depend on its ending a clause: they do for a model with a letter for the end."""
        return self.mode != "rules" and self.weights is not None and CLAUSE_END in self.weights.letters

    def converter(self, width: int = 8) -> Converter:
        w = self.weights
        if self.mode == "rules" or w is None:
            return Converter(self.tables, self.scoring)
        place = {c: i + 1 for i, c in enumerate(w.letters)}
        found = lambda word: beam(forward(w, [place.get(c, 0) for c in word]), w.labels, width)
        if self.mode == "hybrid":
            return Converter(self.tables, self.scoring, lambda word: [o for o, _ in found(word)])

        class ModelOnly(Converter):
            def pool(self, word: str) -> list[tuple[str, float, str]]:
                return sorted(((o, s + 2 * self.t.frequency.get(o, 0.0), "model") for o, s in found(word)), key=lambda x: -x[1])

        return ModelOnly(self.tables, self.scoring)

    def remembered(self, width: int = 8) -> Converter:
        """The converter of this process: a worker keeps it, and what it has converted, from task to task."""
        if getattr(self, "_kept", (None, None))[0] != width:
            self._kept = (width, self.converter(width))
        return self._kept[1]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}

    def words(self, words: DataFrame, word: str = "word", limit: int = 8, width: int = 8) -> DataFrame:
        """word and candidates (best first) of different typed words, each converted once."""
        share = words.sparkSession.sparkContext.broadcast(self)
        kind = pa.list_(pa.struct([("output", pa.string()), ("probability", pa.float64()), ("reason", pa.string())]))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = share.value.remembered(width)
            for batch in batches:
                found = [[{"output": o, "probability": p, "reason": r} for o, p, r in c.convert(w)[:limit]] if w is not None else None for w in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["word", "candidates"])

        return spread(words.select(F.col(word).alias("word"))).mapInArrow(work, "word string, candidates array<struct<output:string,probability:double,reason:string>>")

    def common_words(self, texts: DataFrame, text: str, width: int = 8, most: int = COMMON_WORDS) -> dict[str, list[Candidate]]:
        """The commonest words of the texts with all their candidates: at most so many, converted over all cores."""
        typed = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+(?:['’][a-z]+)*"), 0)).alias("word"))
        top = typed.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word")
        rows = self.words(top, limit=1_000, width=width).toArrow()
        out = {}
        for w, found in zip(rows.column("word").to_pylist(), rows.column("candidates").to_pylist(), strict=True):
            out[w] = [(c["output"], c["probability"], c["reason"]) for c in found]
        return out

    def transliterate(self, df: DataFrame, key: str, text: str, options: Options | None = None) -> DataFrame:
        """key and result (see RESULT) of each text. A null text gives an empty result, as an empty one; repeated rows come out each.

        Extra columns are left out; join them back by key. One scan of df counts its words, one converts it. A stream is only
        converted: its words aren't counted, and a text has no state.
        """
        o = options or Options()
        spark = df.sparkSession
        texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
        texts = texts if df.isStreaming else parallel(texts)
        common = {} if df.isStreaming else self.common_words(texts, "text", o.beam)
        share = spark.sparkContext.broadcast((self, common))
        force, protect = (frozenset(w.lower() for w in ws) for ws in (o.force, o.protect))
        kind, shape = df.schema[key].dataType.simpleString(), RESULT_SHAPE

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            engine, common = share.value
            sentence = Sentence(engine.remembered(o.beam), o)
            for batch in batches:
                keys, out, start, size = batch.column(0), [], 0, 0
                for i, t in enumerate(batch.column(1).to_pylist()):
                    spans = spans_of(t, sentence.c, o, force, protect, common)
                    sentence.run(spans)
                    out.append(finished(spans, o))
                    size += len(spans)
                    if size > SPANS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([keys.slice(start, len(out)), pa.array(out, shape)], names=["key", "result"])
                        out, start, size = [], i + 1, 0
                if out:
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(out)), pa.array(out, shape)], names=["key", "result"])

        return texts.mapInArrow(work, f"key {kind}, result {RESULT}").withColumnRenamed("key", key)


def bounded(rows: DataFrame, most: int, name: str) -> list:
    """The rows of a table on the driver; an error if there are more than its stated bound."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} {name}: give a smaller table, or a greater bound if the driver and executors can hold it")
    return found


def tables_from(counts: DataFrame, loanwords: DataFrame | None = None, pairs: DataFrame | None = None, top: int = 25_000, vowels: DataFrame | None = None, lexicon: DataFrame | None = None, emissions: Emissions | None = None, most: int = 1_000_000) -> Tables:
    """Tables of a corpus: its top words (word, score 1-255), loanwords (typed, output or forms), pairs (head, tail, pmi),
    vowels (word, vowels), lexicon (word), and fitted emissions.

    Words are cut to a stated number by count, the vowels to those words; of pairs, loanwords and lexicon every row counts,
    so none is cut: more than most of them are an error.
    """
    freq = {r["word"]: r["score"] / 255 for r in counts.select("word", "score").orderBy(F.desc("score"), "word").limit(top).collect()}
    loans = {}
    if loanwords is not None:
        forms = F.col("forms") if "forms" in loanwords.columns else F.array("output")
        loans = {r["typed"]: r["forms"] for r in bounded(loanwords.select("typed", forms.alias("forms")), most, "loanwords")}
    big = {(r["head"], r["tail"]): r["pmi"] / 6 for r in bounded(pairs.select("head", "tail", "pmi"), most, "pairs")} if pairs is not None else {}
    lex = frozenset(r["word"] for r in bounded(lexicon.select("word"), most, "lexicon words")) if lexicon is not None else frozenset()
    said = {}
    if vowels is not None:
        known = counts.select("word", "score").orderBy(F.desc("score"), "word").limit(top).select("word")
        said = {r["word"]: r["vowels"] for r in vowels.join(known, "word", "left_semi").select("word", "vowels").collect()}
    return Tables(frequency=freq, loanwords=loans, bigrams=big, lexicon=lex, vowels=said, emissions=emissions)
