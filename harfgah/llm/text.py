"""The folded form and the words that the operators of this package compare texts by.

A folded text is the project's lookup key (functions.fold) of the text after invisible format characters are removed and
look-alike letters of other alphabets are brought to one script. Words are its maximal runs of letters and digits.

A batch of texts is folded as one string, its texts apart by a control character, and as an array of code points: each
step runs once for a batch, in C, and looks at each different character once. Words are spans of that array.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache, lru_cache

import numpy as np
import regex

from harfgah.functions.fold import HAMZA_ABOVE, MATCH, ZWNJ
from harfgah.llm.confusables import SCRIPTS, digits, lookalikes

SEP = "\x1e"

LOOKALIKES = {script: letters for script, letters in lookalikes().items() if script != "latin"}
TO_LATIN = {k: v for letters in lookalikes().values() for k, v in letters.items()}
#: From Latin into a script, for a word that only that script can spell; of several letters the first.
FROM_LATIN = {script: {v: k for k, v in reversed(letters.items())} for script, letters in LOOKALIKES.items()}

_class = "".join(rf"\p{{{s.title()}}}" for s in SCRIPTS)
_script = {s: regex.compile(rf"\p{{{s.title()}}}") for s in ("latin", *SCRIPTS)}
_token = regex.compile(rf"(?:[\p{{Latin}}{_class}]\p{{Mn}}*)+")
_foreign = regex.compile(rf"[{_class}{''.join(lookalikes()['latin'])}]")
#: Format characters that are drawn: they span the digits or words after them.
_DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_ALL = [chr(c) for c in (*range(0x20000), *range(0xE0000, 0xE0200))]
INVISIBLE = {c for c in _ALL if unicodedata.category(c) == "Cf" and ord(c) not in _DRAWN and c != ZWNJ} | {"\u034f"}
#: Characters that join the one before them under composition.
_SECONDS = {chr(int(d[1], 16)) for c in _ALL if len(d := unicodedata.decomposition(c).split()) == 2 and d[0][0] != "<"} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
@cache
def scripts_of(letter: str) -> frozenset[str]:
    """The scripts in which a reader could take this letter to be: its own, and those with a look-alike."""
    own = {name for name, p in _script.items() if p.match(letter)}
    if letter in TO_LATIN:
        own.add("latin")
    return frozenset(own | {s for s, letters in FROM_LATIN.items() if TO_LATIN.get(letter, letter) in letters})


def spell(token: str) -> str:
    """One spelling for a run of letters of alphabets with look-alikes.

    The scripts of its letters are intersected. If Latin can spell all of it (a mixed-script or whole-script confusable,
    or plain Latin), it becomes Latin; else the first other script that can spell all of it is taken; a run that no
    script can spell alone has each look-alike replaced by its Latin letter. Accents take part unseen: they stay.
    """
    token = unicodedata.normalize("NFD", token)
    letters = [c for c in token if not unicodedata.combining(c)]
    common = frozenset.intersection(*map(scripts_of, letters)) if letters else frozenset()
    other = next((s for s in LOOKALIKES if s in common), None)
    if "latin" in common or not other:
        out = "".join(TO_LATIN.get(c, c) for c in token)
    else:
        into = FROM_LATIN[other]
        out = "".join(c if _script[other].match(c) else into.get(TO_LATIN.get(c, c), c) for c in token)
    return unicodedata.normalize("NFC", out)


class Codes:
    """A string as its code points, and which characters it has."""

    def __init__(self, s: str) -> None:
        self.s = s
        self.a = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
        self.there = np.zeros(int(self.a.max(initial=0)) + 1, bool)
        self.there[self.a] = True
        self.chars = set(map(chr, np.flatnonzero(self.there).tolist()))

    def where(self, chars: Iterable[str]) -> np.ndarray:
        """A flag for each position: whether one of these characters stands there."""
        flags = np.zeros(len(self.there), bool)
        flags[[ord(c) for c in chars]] = True
        return flags[self.a]

    def mapped(self, pairs: dict[str, str]) -> Codes:
        """Characters replaced everywhere; pairs: of characters that are there."""
        if not pairs:
            return self
        lut = np.arange(len(self.there), dtype="<u4")
        for c, into in pairs.items():
            if len(into) < 2:
                lut[ord(c)] = ord(into) if into else 0xFFFFFFFF
        a = lut[self.a]
        if "" in pairs.values():
            a = a[a != 0xFFFFFFFF]
        s = a.tobytes().decode("utf-32-le", "surrogatepass")
        for c, into in pairs.items():
            if len(into) > 1:
                s = s.replace(c, into)
        return Codes(s)

    def rewritten(self, inside: np.ndarray, fn: Callable[[str], str], before: int = 0) -> Codes:
        """Each run of flagged positions, with so many characters before it, put through fn."""
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        if not len(edge):
            return self
        out, at = [], 0
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            start = max(at, start - before)
            out += (self.s[at:start], fn(self.s[start:end]))
            at = end
        return Codes("".join([*out, self.s[at:]]))

    def joined(self, form: str) -> Codes:
        """Normalised where a character joins the one before it."""
        marks = [c for c in self.chars if c in _SECONDS or unicodedata.combining(c)]
        return self.rewritten(self.where(marks), lambda x: unicodedata.normalize(form, x), 1) if marks else self

    def nfkc(self, drop: Iterable[str] = ()) -> Codes:
        """NFKC, after the characters of drop are removed."""
        pairs = dict.fromkeys(self.chars.intersection(drop), "")
        pairs |= {c: unicodedata.normalize("NFKC", c) for c in self.chars if c > "\x7f" and c not in pairs and not unicodedata.is_normalized("NFKC", c)}
        return self.mapped(pairs).joined("NFKC")

    def resolved(self) -> Codes:
        """Look-alike letters brought to one script, token by token, look-alike digits to ASCII; this is in NFKC."""
        if max(self.chars, default="") > "\u06ff" and (alien := {c: digits()[c] for c in self.chars if c in digits()}):
            return self.mapped(alien).resolved()
        foreign = [c for c in self.chars if _foreign.match(c)]
        if not foreign:
            return self
        inside = self.where(c for c in self.chars if _token.match(c) or unicodedata.combining(c))
        run = np.cumsum(np.diff(inside, prepend=False) & inside) * inside
        mixed = np.unique(run[self.where(foreign)])
        return self.rewritten(inside & np.isin(run, mixed[mixed > 0]), spell)


def resolve(s: str) -> str:
    return Codes(s).resolved().s


def folded(s: str) -> str:
    """The folded form, blanks as they are (words don't depend on them)."""
    if s.isascii():
        return s.lower()
    c = Codes(s).nfkc(INVISIBLE).resolved()
    s = c.mapped({k: v for k, v in MATCH.pairs().items() if k in c.chars}).joined("NFC").s
    return s.replace(ZWNJ, "").replace(HAMZA_ABOVE, "").lower()


@cache
def _mixed(size: int, seed: int = 1) -> np.ndarray:
    """A 64-bit number for each code point, the same in every process."""
    return np.random.default_rng(seed).integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1)


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    """base to the power 0 .. n, modulo 2**64; n a power of two, so that few lengths are needed."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial rolling hashes modulo 2**64 of many spans of one array of 64-bit numbers, from its prefix sums.

    A span's sum of values[i] * BASE**i is multiplied by BASE**-start (BASE is odd, so it has an inverse): equal spans
    have equal hashes wherever they stand, in any batch.
    """
    n = 1 << int(len(values)).bit_length()
    p, q = powers(int(BASE), n), powers(pow(int(BASE), -1, 1 << 64), n)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * p[: len(values)], dtype=np.uint64)])
    return (prefix[ends] - prefix[starts]) * q[starts]


class Words:
    """A batch of texts, folded, with their words as spans: no Python object is made for a word until it is asked for.

    A null text has no words. start, end: spans of words in the folded string; text: the text that each belongs to;
    size: words of each text; hash: of each word.
    """

    def __init__(self, texts: list[str | None]) -> None:
        self.n = len(texts)
        self.codes = c = Codes(folded(SEP.join([t.replace(SEP, " ") if t else "" for t in texts])))
        inside = c.where(x for x in c.chars if x.isalnum())
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end, self.inside = edge[::2], edge[1::2], inside
        self.breaks = np.flatnonzero(c.a == ord(SEP))
        self.text = np.searchsorted(self.breaks, self.start)
        self.size = np.bincount(self.text, minlength=self.n)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = spans_hash(_mixed(1 << 21)[self.codes.a], self.start, self.end)
        return self._hash

    def word(self, i: int) -> str:
        return self.codes.s[self.start[i] : self.end[i]]

    def of(self, text: int) -> list[str]:
        return [self.word(i) for i in range(self.first[text], self.first[text] + self.size[text])]

    def keys(self) -> list[str]:
        """Of each text its letters and digits in order, nothing between them."""
        a = self.codes.a[self.inside | (self.codes.a == ord(SEP))]
        return a.tobytes().decode("utf-32-le", "surrogatepass").split(SEP) if self.n else []

    @property
    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """All letters and digits in order, and where each text's begin (and the last one's end)."""
        if not hasattr(self, "_letters"):
            self._letters = self.codes.a[self.inside], np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(self.breaks, np.flatnonzero(self.inside)), minlength=self.n))])
        return self._letters

    def key_hash(self, seed: int = 1) -> np.ndarray:
        """A hash of each text's letters and digits in order; 0 if there are none."""
        a, edge = self.letters
        return spans_hash(_mixed(1 << 21, seed)[a], edge[:-1], edge[1:])

    def least_gram(self, k: int) -> np.ndarray:
        """Of each text the least rolling hash of k letters or digits in a row, of all of them if it has fewer; 0 if it has none."""
        a, edge = self.letters
        size = np.diff(edge)
        grams = np.maximum(size - k + 1, np.minimum(size, 1))
        first = np.cumsum(grams) - grams
        start = np.arange(int(grams.sum())) - np.repeat(first - edge[:-1], grams)
        h = spans_hash(_mixed(1 << 21)[a], start, np.minimum(start + k, np.repeat(edge[1:], grams)))
        out, some = np.zeros(self.n, np.uint64), np.flatnonzero(grams)
        if len(some):
            out[some] = np.minimum.reduceat(h, first[some])
        return out


def words_of(text: str | None) -> list[str]:
    return Words([text]).of(0)


def key_of(text: str | None) -> str:
    return Words([text]).keys()[0]
