"""One typed word to ranked Persian spellings: candidates by beam and dictionary, then the word passes in their order.

Everything here is plain Python over bounded tables, made to run once for each different word inside an Arrow batch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from harfgah.functions.fold import ZWNJ, normalize
from harfgah.functions.tables import ANY_VOWEL, EZAFE_HEADS, LINK, MIN_STEM, POSSESSIVE_AFTER_CONSONANT, POSSESSIVE_AFTER_VOWEL, PREFIXES, SUFFIX_AFTER_HE, SUFFIXES, TANVIN_ADVERBS, TYPED_VOWELS, WORD_EXCEPTIONS
from harfgah.operators.affixes import loan_forms
from harfgah.operators.candidates import by_tail, walked
from harfgah.operators.channel import Channel, Emissions

Candidate = tuple[str, float, str]  # output, probability, reason
#: Words of which a converter keeps the candidates; beyond it, it starts anew, with the same results.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Scoring:
    """The weights of the ranking; see Converter."""

    frequency: float = 5.0
    lexicon: float = 2.5
    out_of_table: float = -2.0
    walk: float = 1.0
    bucket: int = 32
    #: Score of each affix taken off; minus infinity: none is tried.
    affix: float = -math.inf
    stem_bucket: int = 8
    carry: int = 24
    width: int = 48
    segmentations: int = 8
    final_he: float = 2.0
    copula: float = 0.2
    vowels: float = 3.0
    bigram: float = 6.0


@dataclass
class Tables:
    """What a conversion looks words up in; each was cut to a fixed size when it was built, so that it can be broadcast."""

    frequency: dict[str, float] = field(default_factory=dict)
    lexicon: frozenset[str] = frozenset()
    loanwords: dict[str, list[str]] = field(default_factory=dict)
    vowels: dict[str, str] = field(default_factory=dict)
    bigrams: dict[tuple[str, str], float] = field(default_factory=dict)
    emissions: Emissions | None = None
    buckets: dict[str, list[str]] = field(default_factory=dict)

    #: The pairs by their second word.
    followed: dict[str, dict[str, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.followed = by_tail(self.bigrams)
        if self.frequency:
            solid: dict[str, float] = {}
            for w, s in self.frequency.items():
                key = w.replace(ZWNJ, "")
                solid[key] = max(s, solid.get(key, 0.0))
            self.frequency = solid
            for w in sorted(solid, key=lambda w: (-solid[w], w)):
                if (key := persian_key(w)) is not None:
                    self.buckets.setdefault(key, []).append(w)


#: Letters that the normal form keeps whatever stands beside them.
KEPT = "اآبپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیئءؤ"
_fa_key = str.maketrans("صثذضظطغحئ", "سسزززتقه" + "\0", "عءؤأآاویۀ" + ZWNJ)
_la_key = str.maketrans("bptsjhxdrzqfkcglmnv", "بپتسجهخدرزقفککگلمن" + "\0", "wyaeiou'")


def _squeeze(s: str) -> str:
    return re.sub("ه$", "", re.sub(r"(.)\1+", r"\1", s.replace("\0", "")))


def persian_key(word: str) -> str | None:
    """Consonants with homophones as one, doubles once, no final he; None unless all are letters."""
    return _squeeze(word.translate(_fa_key)) if re.fullmatch(r"[ء-غف-يپچژکگی‌]+", word) else None


def latin_key(word: str) -> str | None:
    if not re.fullmatch("[a-z']+", word):
        return None
    return _squeeze(re.sub("kh|sh|ch|zh|gh", lambda m: {"kh": "خ", "sh": "ش", "ch": "چ", "zh": "ژ", "gh": "ق"}[m[0]], word).translate(_la_key))


def rounded(p: float) -> float:
    return math.floor(p * 10000 + 0.5) / 10000


@lru_cache(100_000)
def unstretch(word: str) -> tuple[str, str]:
    """The word without stretches, and its stretched end if it has one."""
    base = re.sub(r"([a-z])\1{2,}", lambda m: m[1] * (2 if m[1] in "ao" else 1), word)
    end = re.search(r"([a-z])\1{2,}$", word)
    return base, end[0] if end else ""


def restretch(output: str, run: str, most: int = 6) -> str:
    if not output or not ("؀" <= output[-1] <= "ۿ") or (run[0] in "aeiou") != (output[-1] in "اآیهو"):
        return output
    pad = "ا" if output[-1] == "آ" else output[-1]
    have = len(output) - len(output.rstrip(output[-1] + pad))
    return output + pad * max(0, min(len(run), most) - have)


def promoted(found: list[Candidate], output: str, reason: str, share: float = 0.8) -> list[Candidate]:
    """output first with its share, the others in proportion in what is left."""
    rest = [c for c in found if c[0] != output]
    total = sum(p for _, p, _ in rest) or 1.0
    return [(output, share, reason), *((o, rounded((1 - share) * p / total), r) for o, p, r in rest)]


def typed_vowels(word: str) -> list[str]:
    """What each run of typed vowels can stand for; a y counts between consonants."""
    runs = re.findall(r"(?:[aeiou]|(?<=[^aeiou])y(?![aeiou]))+", word)
    return [TYPED_VOWELS.get(r, ANY_VOWEL) for r in runs]


def vowel_misses(typed: list[str], vowels: str) -> int:
    """Edit distance of typed vowels to a word's; a vowel of the word that wasn't typed costs nothing."""
    row = [0] * (len(vowels) + 1)
    for i, can in enumerate(typed, 1):
        new = [i]
        for j, v in enumerate(vowels, 1):
            new.append(min(row[j - 1] + (v not in can), row[j] + 1, new[-1]))
        row = new
    return row[-1]


def taken_apart(word: str) -> list[tuple[str, str, list[str]]]:
    """(Persian prefix, Latin stem, Persian suffixes from the inside): one prefix and two suffixes at most, three letters of stem at least."""
    out = []
    for typed, prefix in [("", ""), *((t, f) for t, f in PREFIXES if word.startswith(t))]:
        todo: list[tuple[str, list[str]]] = [(word[len(typed) :], [])]
        for stem, suffixes in todo:
            if (typed or suffixes) and len(stem) >= MIN_STEM:
                out.append((prefix, stem, suffixes))
            if len(suffixes) < 2:
                todo += ((stem[: -len(t)], [f, *suffixes]) for t, f in SUFFIXES if stem.endswith(t) and len(stem) - len(t) >= MIN_STEM)
    return out


def put_together(prefix: str, stem: str, suffixes: list[str]) -> str:
    """Affixes joined to a stem: alef after a silent he, a doubled ye after a long vowel, the object marker in full after a vowel."""
    word = prefix + stem
    for s in suffixes:
        he, long, ye = word.endswith("ه"), word.endswith(("ا", "و")), word.endswith("ی")
        if s == LINK:
            s = "ی" if long else ""
        elif s in ("م", "ت", "ش") and he:
            s = "ا" + s
        elif s == "ی":
            s = "ای" if he else "یی" if long else "" if ye else s
        elif s == "و" and (long or he or ye):
            s = "رو"
        word += s
    return word


class Converter:
    """Ranks spellings of a word and remembers them; extra(word) may add spellings of a model to the pool.

    With a frequency table, candidates are scored by the channel: fit plus weighted frequency for a table word, else fit
    less a constant and what its beam score lacks of the best. Without one, by the beam alone.
    """

    def __init__(self, tables: Tables, scoring: Scoring | None = None, extra: Callable[[str], Iterable[str]] | None = None) -> None:
        self.t, self.s, self.extra = tables, scoring or Scoring(), extra
        self.known: dict[str, list[Candidate]] = {}
        self.channel = Channel(tables.emissions)

    # candidates

    def pool(self, word: str) -> list[tuple[str, float, str]]:
        s, t = self.s, self.t
        # gains add up and are independent, so an output's beginning ranks no lower than the output: carry is wide enough for the carried ones
        beam = sorted(walked(word, min(s.width, s.carry) if t.frequency else s.width, s.segmentations).items(), key=lambda x: -x[1])
        if not t.frequency:
            scored = [(o, x + (s.lexicon if o in t.lexicon else 0.0), "rules") for o, x in beam]
            return sorted(scored, key=lambda x: -x[1])
        beam = beam[: s.carry]
        of = dict(beam)
        top, low = (beam[0][1], beam[-1][1]) if beam else (0.0, 0.0)
        offered = [(o, x, "beam") for o, x in beam]
        key = latin_key(word)
        offered += ((o, of.get(o), "dictionary") for o in t.buckets.get(key, ())[: s.bucket] if key is not None)
        offered += ((o, of.get(o, low), "model") for o in (self.extra(word) if self.extra else ()))
        out: dict[str, tuple[str, float, str]] = {}
        fit_of = self.channel.scorer(word).score
        for o, x, source in offered:
            if o in out:
                continue
            fit, freq = fit_of(o), t.frequency.get(o, 0.0)
            if fit == -math.inf:
                out[o] = (o, -1e6 + (x if x is not None else -1e6), f"{source}, unaligned")
            elif freq:
                out[o] = (o, fit + s.frequency * freq, f"{source}, in table")
            else:
                out[o] = (o, fit + s.out_of_table + s.walk * ((x if x is not None else top) - top), source)
        if s.affix > -math.inf:
            for prefix, stem, suffixes in taken_apart(word):
                cost = s.affix * (len(suffixes) + bool(prefix))
                for fa in t.buckets.get(latin_key(stem), ())[: s.stem_bucket]:
                    o = put_together(prefix, fa, suffixes)
                    fit = fit_of(o)
                    if fit > -math.inf and not (o in out and o in t.frequency):
                        x = fit + s.frequency * t.frequency[fa] + cost
                        if o not in out or x > out[o][1]:
                            out[o] = (o, x, f"affixes on {fa}")
        return sorted(out.values(), key=lambda x: -x[1])

    def generated(self, word: str, results: int) -> list[Candidate]:
        found = self.pool(word)[: max(results, 3)]
        if not found:
            return [(word, 0.0, "copied")]
        top = max(x for _, x, _ in found)
        total = sum(math.exp(x - top) for _, x, _ in found)
        # most spellings are in normal form as they are: nothing but letters that it keeps
        return [(normalize(o) if o.strip(KEPT) else o, rounded(math.exp(x - top) / total), r) for o, x, r in found]

    # word passes, each given the typed word and its candidates

    def table_form(self, word: str) -> str | None:
        f = self.t.frequency
        return word if f.get(word) else solid if f.get(solid := word.replace(ZWNJ, "")) else None

    def base(self, word: str) -> list[Candidate]:
        """Candidates of a word without stretches; made once while it is remembered."""
        if word not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.loanword(word, self.vowel_agreement(word, self.generated(word, 8 if self.t.bigrams else 3)))
            if self.t.frequency and found and found[0][2] != "loanword":
                for step in (self.hiatus, self.short_vav, self.glued_link, self.after_he, self.tanvin, self.marker, self.plural_marker, self.copula):
                    found = step(word, found)
            self.known[word] = found
            return found
        return self.known[word]

    def convert(self, typed: str) -> list[Candidate]:
        low = typed.lower()
        base, run = unstretch(low)
        if run and low[: -len(run)] + run[0] in WORD_EXCEPTIONS:
            base = low[: -len(run)] + run[0]
        return [(restretch(o, run) if run else o, p, r) for o, p, r in self.base(base)]

    def vowel_agreement(self, word: str, found: list[Candidate]) -> list[Candidate]:
        table = self.t.vowels
        groups: dict[str, list[int]] = {}
        for i, (o, _, _) in enumerate(found):
            if o in table:
                groups.setdefault(o.translate(str.maketrans("", "", "اآوی")), []).append(i)
        typed, weight, hit = typed_vowels(word), [p for _, p, _ in found], False
        for members in groups.values():
            misses = [vowel_misses(typed, table[found[i][0]]) for i in members]
            for i, m in zip(members, misses, strict=True):
                if m > min(misses):
                    weight[i], hit = max(weight[i], 1e-6) * math.exp(-self.s.vowels * (m - min(misses))), True
        if not hit:
            return found
        total = sum(weight)
        ranked = [(o, rounded(w / total), r) for (o, _, r), w in zip(found, weight, strict=True)]
        return sorted(ranked, key=lambda c: -c[1])

    def loan_forms(self, word: str) -> list[str] | None:
        return loan_forms(word, self.t.loanwords) if self.t.loanwords else None

    def loanword(self, word: str, found: list[Candidate]) -> list[Candidate]:
        fixed = WORD_EXCEPTIONS.get(word)
        forms = [fixed] if fixed else self.loan_forms(word)
        if not forms:
            return found
        shares = [0.9] if len(forms) == 1 else [0.54, 0.36]
        rest = [c for c in found if c[0] not in forms]
        total = sum(p for _, p, _ in rest) or 1.0
        return [*((o, p, "word exception" if fixed else "loanword") for o, p in zip(forms, shares, strict=False)), *((o, rounded(0.1 * p / total), r) for o, p, r in rest)]

    def put_first(self, found: list[Candidate], output: str | None, reason: str) -> list[Candidate]:
        return found if output is None or found[0][0] == output else promoted(found, output, reason)

    def hiatus(self, word: str, found: list[Candidate]) -> list[Candidate]:
        """A ye after a long vowel doubled, if that makes a table word."""
        if not re.search("[aou]e?(?:i|ee)[^aeiou]", word):
            return found
        made = (self.table_form(f"{o[: m.end()]}ی{o[m.end() :]}") for o, _, _ in found for m in re.finditer("[او]ی(?=.)", o))
        return self.put_first(found, next(filter(None, made), None), "doubled ye")

    def short_vav(self, word: str, found: list[Candidate]) -> list[Candidate]:
        """A vav left out, if only that makes a table word."""
        top = found[0][0]
        if not re.search("[^aeiou](?:ou|oo)[^aeiou]", word) or self.table_form(top):
            return found
        made = (self.table_form(top[:i] + top[i + 1 :]) for i in range(1, len(top)) if top[i] == "و")
        return self.put_first(found, next(filter(None, made), None), "short vowel")

    def glued_link(self, word: str, found: list[Candidate]) -> list[Candidate]:
        m = re.fullmatch("(.+[^aeiou]e)yeh?", word)
        if not m or len(m[1]) < 4:
            return found
        made = (self.table_form(o) for o, _, _ in self.base(m[1]) if o.endswith("ه"))
        return self.put_first(found, next(filter(None, made), None), "linking vowel")

    def after_he(self, word: str, found: list[Candidate]) -> list[Candidate]:
        m = re.fullmatch("(.*[^aeiou]e)(ii|ee|ie|ei|i|and|am|im|id)", word)
        if not m or len(m[1]) < 3:
            return found
        o = self.base(m[1])[0][0]
        stem = self.table_form(o) if o.endswith("ه") else None
        return self.put_first(found, stem and stem + SUFFIX_AFTER_HE[m[2]], "ending after he")

    def tanvin(self, word: str, found: list[Candidate]) -> list[Candidate]:
        f = self.t.frequency
        if len(word) < 4 or not re.search("[^a]an$", word):
            return found
        adverb = next((o for o, _, _ in self.base(word[:-1]) if o in TANVIN_ADVERBS), None)
        if adverb and f.get(found[0][0].replace(ZWNJ, ""), 0.0) >= f.get(adverb, 0.0):
            adverb = None
        return self.put_first(found, adverb, "adverb")

    def marker(self, word: str, found: list[Candidate]) -> list[Candidate]:
        """A final o as the object marker on the most frequent stem, with a possessive or without."""
        if len(word) < 4 or not re.search("[^o]o$", word) or found[0][0][-1:] in ("و", "ع"):
            return found
        body, best = word[:-1], (0.0, None)
        for vowel, endings in ((None, {"": ""}), (False, POSSESSIVE_AFTER_CONSONANT), (True, POSSESSIVE_AFTER_VOWEL)):
            for typed, fa in endings.items():
                stem = body[: len(body) - len(typed)]
                if not body.endswith(typed) or len(stem) < 2 or (vowel is not None and (stem[-1] in "aeiou") != vowel):
                    continue
                o = self.base(stem)[0][0]
                score = self.t.frequency.get(o.replace(ZWNJ, ""), 0.0)
                if score > best[0]:
                    best = (score, f"{o}{fa}و")
        return self.put_first(found, best[1], "object marker")

    def plural_marker(self, word: str, found: list[Candidate]) -> list[Candidate]:
        f, top = self.t.frequency, found[0][0]
        if not re.search("[^a]aro$", word) or (top.endswith("و") and f.get(top[:-1].replace(ZWNJ, ""))):
            return found
        for stem, plural in ([(word[:-4], "ها")] if word.endswith("haro") else []) + [(word[:-3], "ا")]:
            if len(stem) > 1 and f.get(o := self.base(stem)[0][0].replace(ZWNJ, "")):
                return self.put_first(found, f"{o}{plural}رو", "plural and object marker")
        return found

    def copula(self, word: str, found: list[Candidate]) -> list[Candidate]:
        """A final e as the copula: second place with a fixed share."""
        top = found[0]
        if not self.s.copula or len(word) < 4 or not re.search("[^e]e$", word) or top[0].endswith("ه"):
            return found
        stem = self.base(word[:-1])[0][0]
        output = f"{stem}ه"
        if stem[-1:] in ("ه", "ا", "و") or stem in EZAFE_HEADS or not self.t.frequency.get(stem.replace(ZWNJ, "")) or output in [c[0] for c in found]:
            return found
        less = [(o, rounded(p * (1 - self.s.copula)), r) for o, p, r in found]
        return [less[0], (output, self.s.copula, "copula"), *less[1:]]
