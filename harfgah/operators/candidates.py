"""Candidate lists: made from rules, ranked, rescaled and chosen in context.

A list is rows (key, ord, output, probability): ord is the place from 0, which also decides ties, as sorts in Spark aren't
stable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harfgah.functions.tables import ANY_VOWEL, CORRESPONDENCES, TYPED_VOWELS, latin_units, reverse_index
from harfgah.session import spread

UNIT_COST, UNKNOWN_COST = 1.2, 6.0


def correspondences(spark: SparkSession) -> DataFrame:
    rows = [(fa, list(latin), list(pos), role, float(w)) for fa, latin, pos, role, w in CORRESPONDENCES]
    return spark.createDataFrame(rows, "fa string, latin array<string>, pos array<string>, role string, w double")


def reverse_table(rules: DataFrame) -> DataFrame:
    """unit, position, fa, w, canonical, rank: what each Latin unit can stand for at each place, heaviest first."""
    spelled = rules.select("fa", "w", F.explode("pos").alias("position"), F.posexplode("latin").alias("at", "unit"))
    summed = spelled.where("unit <> ''").groupBy("unit", "position", "fa").agg(F.sum(F.col("w") / (F.col("at") + 1)).alias("w"), F.max(F.col("at") == 0).alias("canonical"))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("unit", "position").orderBy(F.desc("w"), "fa")) - 1)


@cache
def _unit_lengths() -> tuple[frozenset[str], tuple[int, ...]]:
    units = latin_units()
    return frozenset(units), tuple(sorted({len(u) for u in units}, reverse=True))


def units_at(word: str, at: int) -> list[str]:
    """The units that stand at a place, longest first."""
    units, lengths = _unit_lengths()
    return [u for k in lengths if at + k <= len(word) and (u := word[at : at + k]) in units]


def segment_all(word: str, limit: int) -> list[list[str]]:
    """Up to limit ways to cut a word into units, longest unit first at each place (depth first)."""
    out: list[list[str]] = []
    stack: list[tuple[int, tuple[str, ...]]] = [(0, ())]
    while stack and len(out) < limit:
        at, done = stack.pop()
        if at == len(word):
            out.append(list(done))
            continue
        stack.extend((at + len(u), (*done, u)) for u in reversed(units_at(word, at)))
    return out


def segmentations(words: DataFrame, word: str, limit: int = 8) -> DataFrame:
    """word, rank, units. A word with a letter that no unit has gives no row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, i, u) for w in batch.column(0).to_pylist() if w for i, u in enumerate(segment_all(w, limit))]
            yield pa.RecordBatch.from_pydict({"word": pa.array([r[0] for r in rows], pa.string()), "rank": pa.array([r[1] for r in rows], pa.int32()), "units": pa.array([r[2] for r in rows], pa.list_(pa.string()))})

    return words.select(F.col(word).alias("word")).mapInArrow(work, "word string, rank int, units array<string>")


Steps = dict[tuple[str, str], list[tuple[str, float]]]


@cache
def unit_steps() -> Steps:
    """What each unit can become at each place, with its gain."""
    out = {}
    for key, choices in reverse_index().items():
        total = sum(w for _, w, _ in choices)
        out[key] = [(fa, math.log(w / total) - UNIT_COST) for fa, w, _ in choices]
    return out


def stepped(beam: dict[str, float], steps: list[tuple[str, float]], width: int) -> dict[str, float]:
    """The best outputs after one more unit, best first; beam and steps come best first.

    A full beam with the best step makes as many outputs as are kept, so what is worse than the last of them is passed over.
    """
    floor = next(reversed(beam.values())) + steps[0][1] if len(beam) >= width else -math.inf
    grown: dict[str, float] = {}
    for output, score in beam.items():
        for fa, gain in steps:
            x = score + gain
            if x < floor:
                break
            o = output + fa
            if o not in grown or x > grown[o]:
                grown[o] = x
    return dict(sorted(grown.items(), key=_score, reverse=True)[:width])


_score = itemgetter(1)


def walked(word: str, width: int = 48, limit: int = 8) -> dict[str, float]:
    """Every output of the beams of a word's segmentations with its best score.

    A beam of this width goes over the units of each segmentation; segmentations that begin alike share their beginning.
    """
    steps, out = unit_steps(), {}
    shared: dict[tuple[str, ...], dict[str, float]] = {(): {"": 0.0}}
    for units in segment_all(word, limit):
        last = len(units) - 1
        for i, unit in enumerate(units):
            position = "initial" if i == 0 else "final" if i == last else "medial"
            key = tuple(units[: i + 1])
            if i < last and key in shared:
                continue
            beam = stepped(shared[key[:-1]], steps.get((unit, position)) or [(unit, -UNKNOWN_COST - UNIT_COST)], width)
            if i < last:
                shared[key] = beam
            else:
                for output, score in beam.items():
                    if score > out.get(output, -math.inf):
                        out[output] = score
    return out


def beam_candidates(words: DataFrame, word: str, results: int = 3, width: int = 48, limit: int = 8) -> DataFrame:
    """word, ord, output, score by rules alone. Give different words: each is worked on once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, i, o, s) for w in batch.column(0).to_pylist() if w for i, (o, s) in enumerate(sorted(walked(w, width, limit).items(), key=lambda x: -x[1])[:results])]
            yield pa.RecordBatch.from_pydict({"word": pa.array([r[0] for r in rows], pa.string()), "ord": pa.array([r[1] for r in rows], pa.int32()), "output": pa.array([r[2] for r in rows], pa.string()), "score": pa.array([r[3] for r in rows], pa.float64())})

    return spread(words.select(F.col(word).alias("word"))).mapInArrow(work, "word string, ord int, output string, score double")


def channel_prior(rules: DataFrame) -> DataFrame:
    """fa, position, unit, p: how a letter is spelled, from the rules."""
    spelled = rules.select("fa", F.explode("pos").alias("position"), "w", F.posexplode("latin").alias("at", "unit")).where("fa <> '' and unit <> ''")
    weight = spelled.groupBy("fa", "position", "unit").agg(F.sum(F.col("w") / (F.col("at") + 1)).alias("w"))
    return weight.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("fa", "position"))).drop("w")


def smoothed(counts: DataFrame, prior: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """(n + alpha p) / (N + alpha) of each key and value: counts drawn toward a prior."""
    both = counts.join(prior, [*keys, "unit"], "full")
    n = F.coalesce("n", F.lit(0))
    total = F.sum(n).over(Window.partitionBy(*keys))
    return both.withColumn("p_new", (n + alpha * F.coalesce("p", F.lit(0.0))) / (total + alpha))


def best_by_key(candidates: DataFrame, keys: list[str], order: list[Column], k: int | None) -> DataFrame:
    """The k best rows of each key, or all, with ord from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = candidates.withColumn("ord", F.row_number().over(w) - 1)
    return ranked if k is None else ranked.where(F.col("ord") < k)


def softmax(candidates: DataFrame, keys: list[str], score: str, digits: int = 4) -> DataFrame:
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return candidates.withColumn("probability", F.round(e / F.sum(e).over(w), digits))


def promoted(candidates: DataFrame, keys: list[str], first: Column, share: float = 0.8, digits: int = 4) -> DataFrame:
    """The flagged output gets share and comes first, the rest share what is left in proportion."""
    w = Window.partitionBy(*keys)
    rest = F.sum(F.when(~first, F.col("probability")).otherwise(0.0)).over(w)
    p = F.when(first, share).otherwise(F.round((1 - share) * F.col("probability") / F.when(rest == 0, 1.0).otherwise(rest), digits))
    place = F.row_number().over(w.orderBy((~first).cast("int"), "ord")) - 1
    return candidates.withColumns({"probability": p, "ord": place})


def tilted(candidates: DataFrame, keys: list[str], favoured: Column, log_gain: float, digits: int = 4) -> DataFrame:
    """Favoured candidates times e**log_gain, renormalised and ranked anew; lists with all or none favoured stay."""
    w = Window.partitionBy(*keys)
    n = F.sum(favoured.cast("int")).over(w)
    mixed = (n > 0) & (n < F.count("*").over(w))
    weight = F.greatest("probability", F.lit(1e-6)) * F.when(favoured, F.lit(math.exp(log_gain))).otherwise(1.0)
    out = candidates.withColumns({"_w": weight, "_mixed": mixed})
    out = out.withColumn("probability", F.when(F.col("_mixed"), F.round(F.col("_w") / F.sum("_w").over(w), digits)).otherwise(F.col("probability")))
    rank = F.row_number().over(w.orderBy(F.when(F.col("_mixed"), -F.col("_w")), "ord")) - 1
    return out.withColumn("ord", rank).drop("_w", "_mixed")


def vowel_slots(typed: Column) -> Column:
    """What each run of typed vowels can stand for, as an array of vowel letters; a y counts between consonants."""
    runs = F.regexp_extract_all(typed, F.lit("(?:[aeiou]|(?<=[^aeiou])y(?![aeiou]))+"), 0)
    known = F.create_map(*(F.lit(x) for kv in TYPED_VOWELS.items() for x in kv))
    return F.transform(runs, lambda r: F.coalesce(F.try_element_at(known, r), F.lit(ANY_VOWEL)))


def vowel_misses(slots: Column, vowels: Column) -> Column:
    """Edit distance of typed vowels to a word's; a vowel of the word that wasn't typed costs nothing."""
    n = F.length(vowels)

    def step(row: Column, can: Column) -> Column:
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        cost = lambda j: F.least(F.get(row, j - 1) + F.contains(can, vowels.substr(j, F.lit(1))).cast("int") * -1 + 1, F.get(row, j) + 1)
        return F.aggregate(places, F.array(F.get(row, F.lit(0)) + 1), lambda new, j: F.concat(new, F.array(F.least(cost(j), F.element_at(new, -1)))))

    return F.element_at(F.aggregate(slots, F.array_repeat(F.lit(0), n + 1), step), -1)


def penalised(candidates: DataFrame, keys: list[str], group: str, misses: str, weight: float, digits: int = 4) -> DataFrame:
    """Within a group of confusable outputs, e**(-weight) for each miss more than the group's least; renormalised if any."""
    g, w = Window.partitionBy(*keys, group), Window.partitionBy(*keys)
    excess = F.when(F.count("*").over(g) > 1, F.col(misses) - F.min(misses).over(g)).otherwise(0)
    out = candidates.withColumn("_excess", excess)
    p = F.when(F.col("_excess") > 0, F.greatest("probability", F.lit(1e-6)) * F.exp(-weight * F.col("_excess"))).otherwise(F.col("probability"))
    out = out.withColumns({"_p": p, "_any": F.max("_excess").over(w) > 0})
    out = out.withColumn("probability", F.when(F.col("_any"), F.round(F.col("_p") / F.sum("_p").over(w), digits)).otherwise(F.col("probability")))
    return out.withColumn("ord", F.row_number().over(w.orderBy(F.desc("probability"), "ord")) - 1).drop("_excess", "_p", "_any")


def best_path(lists: list[list[tuple[str, float]]], pair, weight: float) -> list[int]:
    """Viterbi: the choice at each place that maximises the sum of log probabilities and weighted pair scores; first of equals."""
    score = [math.log(max(p, 1e-6)) for _, p in lists[0]]
    back: list[list[int]] = []
    for before, here in zip(lists, lists[1:], strict=False):
        step = [max(range(len(before)), key=lambda i, o=o: (score[i] + weight * pair(before[i][0], o), -i)) for o, _ in here]
        score = [score[i] + weight * pair(before[i][0], o) + math.log(max(p, 1e-6)) for i, (o, p) in zip(step, here, strict=True)]
        back.append(step)
    at = max(range(len(score)), key=lambda i: (score[i], -i))
    path = [at]
    for step in reversed(back):
        path.append(at := step[at])
    return path[::-1]


Followed = Mapping[str, Mapping[str, float]]


def by_tail(pairs: Mapping[tuple[str, str], float]) -> dict[str, dict[str, float]]:
    """Scores of pairs by the second word, then the first."""
    out: dict[str, dict[str, float]] = {}
    for (head, tail), score in pairs.items():
        out.setdefault(tail, {})[head] = score
    return out


def best_path_of(lists: list[list[tuple[str, float]]], pairs: Followed, weight: float) -> list[int]:
    """best_path for a table of pairs by tail: an output that follows nothing in it goes behind the best one before."""
    score = [math.log(max(p, 1e-6)) for _, p in lists[0]]
    back: list[list[int]] = []
    for before, here in zip(lists, lists[1:], strict=False):
        top = max(range(len(score)), key=lambda i, s=score: (s[i], -i))
        step, new = [], []
        for o, p in here:
            i, best = top, score[top]
            if heads := pairs.get(o):
                for k, (h, _) in enumerate(before):
                    x = score[k] + weight * heads.get(h, 0.0)
                    if x > best or (x == best and k < i):
                        i, best = k, x
            step.append(i)
            new.append(best + math.log(max(p, 1e-6)))
        score = new
        back.append(step)
    at = max(range(len(score)), key=lambda i: (score[i], -i))
    path = [at]
    for step in reversed(back):
        path.append(at := step[at])
    return path[::-1]


def chosen_paths(lines: DataFrame, key: str, pairs: DataFrame, weight: float = 6.0, most: int = 1_000_000) -> DataFrame:
    """key and the chosen outputs: lines has lists, an array of arrays of (output, probability); pairs: head, tail, score.

    pairs is broadcast, so it must be a table that was cut to a number of pairs when it was built; more than most are an error.
    """
    rows = pairs.select("head", "tail", "score").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pairs")
    known = lines.sparkSession.sparkContext.broadcast(by_tail({(r["head"], r["tail"]): r["score"] for r in rows}))
    kind = lines.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = known.value
        for batch in batches:
            # outputs and probabilities as flat lists, cut by the offsets of both levels
            of_line = batch.column(1)
            of_word = of_line.flatten()
            flat = of_word.flatten()
            output, p = flat.field("output").to_pylist(), flat.field("probability").to_pylist()
            ends = (np.cumsum(np.diff(of_word.offsets.to_numpy()))).tolist()
            out, word, at = [], 0, 0
            for n in np.diff(of_line.offsets.to_numpy()).tolist():
                lists = []
                for _ in range(n):
                    lists.append(list(zip(output[at : ends[word]], p[at : ends[word]], strict=True)))
                    at, word = ends[word], word + 1
                out.append([x[i][0] for x, i in zip(lists, best_path_of(lists, score, weight), strict=True)] if lists else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["key", "chosen"])

    return lines.select(F.col(key).alias("key"), F.transform("lists", lambda x: F.transform(x, lambda c: F.struct(c["output"].alias("output"), c["probability"].alias("probability")))).alias("lists")).mapInArrow(work, f"key {kind}, chosen array<string>").withColumnRenamed("key", key)
