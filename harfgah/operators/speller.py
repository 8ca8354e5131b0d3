"""Synthetic typings of Persian words, as aligned pieces whose Persian sides spell the word without loss."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.functions.fold import ZWNJ
from harfgah.functions.tables import CORRESPONDENCES

VARIANT_RATE = 0.3
SHORT_VOWELS, SHORT_WEIGHTS = ("a", "e", "o"), (0.5, 0.35, 0.15)
# Two consonants that can end a syllable together.
CODAS = frozenset(
    """ست شت خت فت پت کت رد رگ رز رس رف رم رن رخ رچ رج رک رب رو رت رش رع رض رط ند نگ نج نز نس نت نک نچ نف نب
    لد لم لف لگ لس لت لخ لب لچ لج لع سب بز بح صح زد ژد مب مد مس سک سپ کس خش فس نظ حم عل عم عب عت عد عش عض عف عق""".split()
)
LONG = "آاوی"


@cache
def spellings(fa: str, role: str) -> tuple[str, ...]:
    return next((s for f, s, _, r, _ in CORRESPONDENCES if f == fa and r == role), ())


def pick(r: random.Random, fa: str, *roles: str) -> str:
    """The first spelling, at the variant rate one of the others; a letter without any is typed as nothing."""
    ways = next(filter(None, (spellings(fa, role) for role in roles)), ("",))
    return r.choice(ways[1:]) if len(ways) > 1 and r.random() < VARIANT_RATE else ways[0]


def typed(word: str, r: random.Random) -> list[tuple[str, str]]:
    """(Persian, Latin) pieces of a word: written vowels, consonants, and between them the short vowels that aren't written.

    A vav or ye beside a written vowel is a consonant, else a vowel; a final he after a consonant is silent; after a
    consonant that neither a vowel nor an allowed end of the syllable follows, a short vowel is typed.
    """
    out: list[tuple[str, str]] = []
    n = len(word)

    def vowel(i: int) -> bool:
        c = word[i] if 0 <= i < n else ""
        if c in ("آ", "ا"):
            return True
        return c in ("و", "ی") and i > 0 and not (word[i - 1] in LONG) and not (i + 1 < n and word[i + 1] in ("ا", "آ"))

    open_syllable = False
    for i, c in enumerate(word):
        if c == ZWNJ:
            out.append((c, r.choices(spellings(c, "zwnj"), (0.75, 0.15, 0.1))[0]))
            open_syllable = False
        elif c in "ءئؤٔ":
            out.append((c, pick(r, c, "silent")))
        elif c == "و" and i and word[i - 1] == "خ" and i + 1 < n and word[i + 1] == "ا":
            out.append((c, ""))
        elif c == "ا" and i == 0:
            out.append((c, r.choices(SHORT_VOWELS, SHORT_WEIGHTS)[0] if not vowel(1) else ""))
            open_syllable = True
        elif vowel(i):
            out.append((c, pick(r, c, "vowel")))
            open_syllable = True
        elif c == "ه" and i == n - 1 and i and not vowel(i - 1):
            out.append((c, pick(r, c, "silent")))
        else:
            out.append((c, pick(r, c, "consonant", "silent")))
            after = i + 1 < n and (vowel(i + 1) or (word[i + 1] == "ه" and i + 2 == n))
            ends = open_syllable and (i + 1 == n or word[i : i + 2] in CODAS or (i + 2 < n and not vowel(i + 1) and vowel(i + 2)))
            if not after and not ends and i + 1 < n and word[i + 1] != ZWNJ:
                out.append(("", r.choices(SHORT_VOWELS, SHORT_WEIGHTS)[0]))
                open_syllable = True
            else:
                open_syllable = False
    return out


def labelled(pieces: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """The typing, and a label for each of its letters; Persian that was typed as nothing goes to the next letter, at the end to the last."""
    latin, labels, waiting = "", [], ""
    for fa, typed_as in pieces:
        waiting += fa
        if typed_as:
            latin += typed_as
            labels += [waiting, *[""] * (len(typed_as) - 1)]
            waiting = ""
    if waiting and labels:
        labels[-1] += waiting
    return latin, labels


def synthetic(words: DataFrame, word: str, variants: int = 6, longest: int = 32, seed: int = 0) -> DataFrame:
    """persian, variant, latin, labels: up to so many different typings of each different word.

    The draw depends on seed, word and variant alone, so a task that runs again types the same. Typings that are empty,
    too long or the same as an earlier one, and any whose labels don't spell the word, are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for w in batch.column(0).to_pylist():
                seen: set[str] = set()
                for v in range(variants if w else 0):
                    latin, labels = labelled(typed(w, random.Random(f"{seed}:{w}:{v}")))
                    if latin and len(latin) <= longest and latin not in seen and "".join(labels) == w:
                        seen.add(latin)
                        rows.append((w, v, latin, labels))
            yield pa.RecordBatch.from_pydict({"persian": pa.array([x[0] for x in rows], pa.string()), "variant": pa.array([x[1] for x in rows], pa.int32()), "latin": pa.array([x[2] for x in rows], pa.string()), "labels": pa.array([x[3] for x in rows], pa.list_(pa.string()))})

    return words.select(F.col(word).alias("persian")).mapInArrow(work, "persian string, variant int, latin string, labels array<string>")
