"""The noisy channel: how probable a typing is for a Persian word, and how the letters line up.

A Persian word is spelled letter by letter: each letter (or pair of letters that has its own spellings) emits one of its
Latin spellings at its place in the word, an unwritten short vowel may be typed after a letter, a consonant may be typed
twice. The best way is found by a dynamic program over places in both words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.functions.fold import ZWNJ
from harfgah.functions.tables import CORRESPONDENCES
from harfgah.operators.candidates import smoothed

INSERTION, GEMINATION = 0.5, math.log(0.3)
SHORT_VOWELS = ("a", "e", "o")
Emissions = dict[tuple[str, str], dict[str, float]]


@cache
def from_rules() -> Emissions:
    """(Persian, position) to spelling to log probability, from the correspondences' ranks; each sums to one."""
    weight: dict[tuple[str, str], dict[str, float]] = {}
    for fa, spellings, positions, _, w in CORRESPONDENCES:
        for pos in positions if fa and fa != ZWNJ else ():
            of = weight.setdefault((fa, pos), {})
            for rank, s in enumerate(spellings):
                of[s] = of.get(s, 0.0) + w / (rank + 1)
    return {k: {s: math.log(w / sum(of.values())) for s, w in of.items()} for k, of in weight.items()}


class Channel:
    """Emissions prepared for scoring."""

    def __init__(self, emissions: Emissions | None = None) -> None:
        # of each (Persian, position): spelling, its length, log probability, doubled spelling if it can be
        self.ways = {k: [(s, len(s), p, s * 2 if len(s) == 1 and s not in "aeiou" else "") for s, p in of.items()] for k, of in (emissions or from_rules()).items()}
        # of each (Persian, position): spelling or doubled spelling to log probability
        self.spelled: dict[tuple[str, str], dict[str, float]] = {}
        for k, ways in self.ways.items():
            of = self.spelled[k] = {}
            for s, _, p, double in ways:
                of[s] = max(p, of.get(s, -math.inf))
                if double:
                    of[double] = max(p + GEMINATION, of.get(double, -math.inf))
        self.longest = max((len(s) for of in self.spelled.values() for s in of), default=0)

    def scorer(self, latin: str) -> Scorer:
        return Scorer(self, latin)

    def best(self, latin: str, fa: str) -> tuple[float, list[tuple[str, str, str]]]:
        """Log probability of the best way to type fa as latin, and its steps (Persian, position, typed); minus infinity and none if there is no way.

        A step without Persian is a short vowel that isn't written; it stands after a letter, once.
        """
        fa = fa.replace(ZWNJ, "")
        n, m = len(fa), len(latin)
        # of each place in fa: place in latin to (score, place before in fa and latin, step)
        states: list[dict[int, tuple]] = [{} for _ in range(n + 1)]
        states[0][0] = (0.0, -1, -1, None)
        for i in range(n):
            here = states[i]
            if i:
                self.insert(here, latin, i)
            for k in (1, 2) if i + 2 <= n else (1,):
                f = fa[i : i + k]
                pos = "initial" if i == 0 else "final" if i + k == n else "medial"
                ways, after = self.ways.get((f, pos), ()), states[i + k]
                for j, (score, *_) in here.items():
                    for s, size, p, double in ways:
                        if latin.startswith(s, j):
                            x = score + p
                            if j + size not in after or x > after[j + size][0]:
                                after[j + size] = (x, i, j, (f, pos, s))
                            if double and latin.startswith(double, j) and (j + 2 not in after or x + GEMINATION > after[j + 2][0]):
                                after[j + 2] = (x + GEMINATION, i, j, (f, pos, double))
        if n:
            self.insert(states[n], latin, n)
        if m not in states[n]:
            return -math.inf, []
        score, steps, at = states[n][m][0], [], (n, m)
        while (state := states[at[0]][at[1]])[3]:
            steps.append(state[3])
            at = state[1:3]
        return score, steps[::-1]

    @staticmethod
    def insert(states: dict[int, tuple], latin: str, i: int) -> None:
        vowel = VOWEL_COST
        for j, (score, *_) in list(states.items()):
            if latin[j : j + 1] in SHORT_VOWELS and (j + 1 not in states or score + vowel > states[j + 1][0]):
                states[j + 1] = (score + vowel, i, j, ("", "medial", latin[j]))


VOWEL_COST = math.log(INSERTION / len(SHORT_VOWELS))


class Scorer:
    """Scores of many Persian words for one typing; words that begin alike share the work on their beginnings."""

    def __init__(self, channel: Channel, latin: str) -> None:
        self.spelled, self.latin, self.size = channel.spelled, latin, len(latin)
        # what is typed from each place: spelling and the place after it
        self.typed = [[(latin[j : j + k], j + k) for k in range(min(channel.longest, self.size - j) + 1)] for j in range(self.size + 1)]
        self.vowel = [c in SHORT_VOWELS for c in latin]
        self.steps: dict[tuple[str, str], list[list[tuple[int, float]]]] = {}
        # of each beginning: place in latin to the best score
        self.states: dict[str, dict[int, float]] = {"": {0: 0.0}}

    def moves(self, key: tuple[str, str]) -> list[list[tuple[int, float]]] | None:
        """From each place in latin, where a letter can lead and at what log probability; None if it has no spelling here."""
        of = self.spelled.get(key)
        found = of and [[(after, of[s]) for s, after in typed if s in of] for typed in self.typed]
        self.steps[key] = found = found if found and any(found) else None
        return found

    def grown(self, fa: str, last: str) -> dict[int, float]:
        """Scores after all of fa, its last letter or pair being medial or final."""
        n, out, steps, states = len(fa), {}, self.steps, self.states
        for k in (1, 2) if n > 1 else (1,):
            key = (fa[n - k :], "initial" if n == k else last)
            moves = steps[key] if key in steps else self.moves(key)
            if moves:
                start = fa[: n - k]
                before = states[start] if start in states else self.reached(start)
                for j, score in before.items():
                    for after, p in moves[j]:
                        x = score + p
                        if after not in out or x > out[after]:
                            out[after] = x
        vowel, size = self.vowel, self.size
        for j, score in list(out.items()):
            if j < size and vowel[j] and (j + 1 not in out or score + VOWEL_COST > out[j + 1]):
                out[j + 1] = score + VOWEL_COST
        return out

    def reached(self, fa: str) -> dict[int, float]:
        if fa not in self.states:
            self.states[fa] = self.grown(fa, "medial")
        return self.states[fa]

    def score(self, fa: str) -> float:
        """What Channel.best gives, without the steps."""
        fa = fa.replace(ZWNJ, "")
        return (self.grown(fa, "final") if fa else self.states[""]).get(self.size, -math.inf)


@lru_cache(4)
def _shared() -> Channel:
    return Channel()


def best_alignment(latin: str, fa: str, emissions: Emissions | None = None) -> tuple[float, list[tuple[str, str, str]]]:
    return (Channel(emissions) if emissions else _shared()).best(latin, fa)


def channel_score(latin: str, fa: str, emissions: Emissions | None = None) -> float:
    return best_alignment(latin, fa, emissions)[0]


def labels_of(latin: str, fa: str, channel: Channel | None = None) -> list[str] | None:
    """One Persian label for each typed letter, which together spell the word; None if there is no alignment.

    What is typed as nothing goes to the label of the next letter typed, or of the last one; a joiner is put back before
    the letter that it stands before.
    """
    score, steps = (channel or _shared()).best(latin, fa)
    if score == -math.inf or not latin:
        return None
    labels: list[str] = []
    waiting = ""
    for f, _, s in steps:
        waiting += f
        if s:
            labels += [waiting, *[""] * (len(s) - 1)]
            waiting = ""
    labels[-1] += waiting
    if ZWNJ in fa:
        out, at = [], 0
        for label in labels:
            text = ""
            for _ in label:
                while fa[at] == ZWNJ:
                    text, at = text + ZWNJ, at + 1
                text, at = text + fa[at], at + 1
            out.append(text)
        out[-1] += fa[at:]
        labels = out
    return labels


def aligned_steps(pairs: DataFrame, latin: str, fa: str, emissions: Emissions | None = None) -> DataFrame:
    """latin, fa, score, steps, labels of different pairs; a pair without an alignment has null labels and no steps."""
    share = pairs.sparkSession.sparkContext.broadcast(emissions)
    step = pa.struct([("fa", pa.string()), ("position", pa.string()), ("unit", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(share.value)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [channel.best(x or "", y or "") for x, y in zip(a, b, strict=True)]
            steps = [[{"fa": f, "position": p, "unit": s} for f, p, s in st] for _, st in found]
            labels = [labels_of(x, y, channel) if x and y else None for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s if s > -math.inf else None for s, _ in found], pa.float64()), pa.array(steps, pa.list_(step)), pa.array(labels, pa.list_(pa.string()))], names=["latin", "fa", "score", "steps", "labels"])

    schema = "latin string, fa string, score double, steps array<struct<fa:string,position:string,unit:string>>, labels array<string>"
    return pairs.select(F.col(latin).alias("latin"), F.col(fa).alias("fa")).mapInArrow(work, schema)


def fitted(pairs: DataFrame, latin: str, fa: str, n: str, rounds: int = 3, alpha: float = 20.0) -> Emissions:
    """Emissions re-estimated from counted pairs, each round from the best alignments of the one before, drawn toward the rules.

    What comes to the driver is a table of letters, places and spellings; its size doesn't depend on the corpus.
    """
    spark, now = pairs.sparkSession, from_rules()
    prior = spark.createDataFrame([(f, p, s, math.exp(x)) for (f, p), of in from_rules().items() for s, x in of.items()], "fa string, position string, unit string, p double")
    for _ in range(rounds):
        steps = aligned_steps(pairs.select(latin, fa), latin, fa, now).select(F.col("latin"), F.col("fa").alias("word"), F.explode("steps").alias("s"))
        weights = pairs.select(F.col(latin).alias("latin"), F.col(fa).alias("word"), F.col(n).alias("n"))
        counts = steps.join(weights, ["latin", "word"]).where("s.fa <> ''").groupBy("s.fa", "s.position", "s.unit").agg(F.sum("n").alias("n"))
        single = counts.join(prior.select("fa", "position", "unit"), ["fa", "position", "unit"], "left_semi")
        rows = smoothed(single, prior, ["fa", "position"], alpha).where("p_new > 0").select("fa", "position", "unit", "p_new").collect()
        now = {}
        for r in rows:
            now.setdefault((r["fa"], r["position"]), {})[r["unit"]] = math.log(r["p_new"])
    return now
