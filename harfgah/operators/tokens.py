"""The lossless scanner, and the flags that depend on a token's neighbours.

A text is scanned whole in its own row, in Arrow batches: kinds, offsets and the flags that depend on neighbours come out
of one pass, so that no token is shuffled or sorted to find the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harfgah.functions.tables import HOMOGRAPHS
from harfgah.functions.words import englishness, unstretched

# Fixed values of the scanner's format.
TLD = "com|org|net|io|dev|ir|co|app|ai|me|sh|xyz|edu|gov"
BLANKS = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
ADDRESS = rf"[^{BLANKS}<>()\[\]{{}}\"']"
#: Tried in this order at each place. Those up to identifier can be overruled by a word that the caller wants converted.
KINDS: list[tuple[str, str]] = [
    ("code", "`[^`]*`"),
    ("url", rf"(?:[A-Za-z][A-Za-z0-9+.-]*://|[Ww]{{3}}\.){ADDRESS}+|[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.(?i:{TLD})(?:/{ADDRESS}*)?"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("mention", "@[A-Za-z0-9_.]{1,40}"),
    ("hashtag", r"#[\p{L}\p{N}_]{1,60}"),
    ("number", r"[+-]?[0-9][0-9,._:/-]*[0-9]%?|[+-]?[0-9]%?"),
    ("identifier", "[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Z]{2,}[0-9]*(?![a-z])|[A-Za-z]+[0-9]+[A-Za-z0-9]*"),
    ("emoji", r"(?:\p{Extended_Pictographic}|\p{Emoji_Presentation})(?:\ufe0f|\u200d\p{Extended_Pictographic}|\p{Emoji_Modifier})*"),
    ("other-script", r"[^\p{Latin}\p{P}\p{Z}\p{N}\p{C}]+"),
    ("word", "[A-Za-z]+(?:['’][A-Za-z]+)*"),
    ("space", f"[{BLANKS}]+"),
    ("punct", r"[\p{P}\p{S}]+"),
]
HARD = 7
_names = {k.replace("-", "_"): k for k, _ in KINDS}
_all = regex.compile("|".join(f"(?P<{k.replace('-', '_')}>{p})" for k, p in KINDS) + "|(?s:.)")
_each = [(k, regex.compile(p)) for k, p in KINDS]
_ends = regex.compile(r"[.!?؟۔]$")


def scan(text: str, force: frozenset[str] = frozenset()) -> Iterator[tuple[str, str]]:
    """(kind, token) of a text, nothing lost; a character that nothing takes is a mark (punct) of its own.

    force: words in lower case that no pattern before the word's may take.
    """
    if not force:
        for m in _all.finditer(text):
            yield _names.get(m.lastgroup, "punct"), m[0]
        return
    at = 0
    while at < len(text):
        for i, (kind, p) in enumerate(_each):
            m = p.match(text, at)
            if m and m[0] and not (i < HARD and m[0].lower() in force):
                break
        else:
            kind, m = "punct", regex.compile("(?s:.)").match(text, at)
        yield kind, m[0]
        at = m.end()


@dataclass
class Scanned:
    """The tokens of one text. starts: begins a sentence; ends: the clause ends behind it; both hold for tokens but blanks."""

    kind: list[str]
    tok: list[str]
    starts: list[bool]
    ends: list[bool]


def scanned(text: str | None, force: frozenset[str] = frozenset()) -> Scanned:
    kind: list[str] = []
    tok: list[str] = []
    for k, t in scan(text, force) if text else ():
        kind.append(k)
        tok.append(t)
    n = len(tok)
    starts, ends = [False] * n, [False] * n
    begins = True
    for i, k in enumerate(kind):
        if k != "space":
            starts[i] = begins
            begins = k == "punct" and _ends.search(tok[i]) is not None
    final = True
    for i in range(n - 1, -1, -1):
        if kind[i] != "space":
            ends[i] = final
            final = kind[i] == "punct"
    return Scanned(kind, tok, starts, ends)


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, tok, kind, start, sentence_start, clause_final: every text cut without loss; start in code points.

    A sentence starts at the first token and after final punctuation, a clause ends at the last and before punctuation;
    blanks are passed over and have neither. A null or empty text has no tokens. No shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                of: list[int] = []
                pos: list[int] = []
                start: list[int] = []
                parts: tuple[list, list, list, list] = [], [], [], []
                # whole texts each, up to a bound of tokens where possible
                while a < len(texts) and len(of) < TOKENS_AT_ONCE:
                    s = scanned(texts[a])
                    of += [a] * len(s.tok)
                    pos += range(len(s.tok))
                    at = 0
                    for t in s.tok:
                        start.append(at)
                        at += len(t)
                    for part, own in zip(parts, (s.tok, s.kind, s.starts, s.ends), strict=True):
                        part += own
                    a += 1
                tok, kind, starts, ends = parts
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(of, pa.int64())), pa.array(pos, pa.int64()), pa.array(tok, pa.string()), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(starts, pa.bool_()), pa.array(ends, pa.bool_())],
                    names=["key", "pos", "tok", "kind", "start", "sentence_start", "clause_final"],
                )

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}, pos long, tok string, kind string, start long, sentence_start boolean, clause_final boolean")
    return out.withColumnRenamed("key", key)


#: Tokens of a batch; a longer text has a batch of its own.
TOKENS_AT_ONCE = 200_000


def sentence_flags(t: DataFrame, key: str) -> DataFrame:
    """The tokens that the flags hold for: all but blanks."""
    return t.where("kind <> 'space'")


def guard(soft: list[bool], english: list[bool]) -> list[bool]:
    """Of neighbouring tokens, those of a run of loanwords (soft) that has an English one at either end.

    Repeating "a loanword beside an English word becomes English" until nothing changes reaches exactly the whole run.
    """
    out, i, n = [False] * len(soft), 0, len(soft)
    while i < n:
        j = i
        while j < n and soft[j]:
            j += 1
        if j > i and ((i and english[i - 1]) or (j < n and english[j])):
            out[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    return out


def classified(t: DataFrame, loanwords: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Flagged tokens with reason ('english' or null) and loan.

    loanwords: one column, word; joined by equality to the different words, never broadcast unless Spark finds it small.
    """
    word = unstretched(F.lower("tok"))
    loans = loanwords.where("word is not null").distinct().withColumn("listed", F.lit(True))
    rows = t.withColumn("word", word).join(loans, "word", "left")
    is_word, loan = F.col("kind") == "word", F.coalesce("listed", F.lit(False))
    capital = F.col("tok").rlike("^[A-Z][a-z]") & ~F.col("sentence_start") & ~F.col("word").isin(*sorted(HOMOGRAPHS))
    reason = F.when(~is_word, None).when(capital, "english").when(loan, None).when(englishness(F.col("word")) >= threshold, "english")
    return rows.withColumns({"reason": reason, "loan": is_word & loan}).drop("listed", "word")


def guarded(t: DataFrame, key: str) -> DataFrame:
    """Classified tokens with guarded: a loanword whose run of loanwords has an English word beside it.

    Repeating "a loanword beside an English word becomes English" until nothing changes reaches exactly the whole run,
    so runs are numbered and one flag is taken for each.
    """
    w = Window.partitionBy(key).orderBy("pos")
    soft, english = F.col("loan") & F.col("reason").isNull(), F.coalesce(F.col("reason") == "english", F.lit(False))
    rows = t.withColumns({"_soft": soft, "_english": english})
    rows = rows.withColumns({"_new": (~(F.col("_soft") & F.coalesce(F.lag("_soft").over(w), F.lit(False)))).cast("int"), "_beside": F.coalesce(F.lag("_english").over(w), F.lit(False)) | F.coalesce(F.lead("_english").over(w), F.lit(False))})
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    flip = F.max(F.col("_soft") & F.col("_beside")).over(Window.partitionBy(key, "_run"))
    return rows.withColumn("guarded", F.col("_soft") & flip).drop("_soft", "_english", "_new", "_beside", "_run")


def restretched(c: Column, letter: Column, length: Column, most: int = 6) -> Column:
    """The last letter of a Persian word repeated as a typed final run asks, up to most; only vowel to vowel, consonant to consonant."""
    last = F.right(c, F.lit(1))
    pad = F.when(last == "آ", "ا").otherwise(last)
    vowel = letter.rlike("^[aeiou]$")
    have = F.length(c) - F.length(F.rtrim(c, pad))
    have = F.when(last == "آ", 1).when(F.right(F.rtrim(c, pad), F.lit(1)) == "آ", have + F.when(pad == "ا", 1).otherwise(0)).otherwise(have)
    fits = last.rlike(r"^\p{IsArabic}$") & (vowel == last.rlike("^[اآیهو]$"))
    return F.when(fits, F.concat(c, F.repeat(pad, F.greatest(F.least(length, F.lit(most)) - have, F.lit(0))))).otherwise(c)
