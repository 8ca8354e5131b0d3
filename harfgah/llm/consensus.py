"""Problem 5: consensus from several annotators' labels by message passing on the graph of items and judges."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harfgah.operators.skew import hot_keys, salted_join
from harfgah.session import cut, spread, under

#: Judges whose messages are broadcast to the votes, an item's votes being one row; beyond it votes stay rows and are joined.
BROADCAST_JUDGES = 100_000
#: Rounds end when no judge's reliability moves by more than this. More rounds than MOST are an error, not a result.
TOLERANCE, MOST = 1e-3, 500
#: Log odds per unit of the first share of accepts above a half.
FIRST = 6.0


def verdict(c: Column) -> Column:
    """accept or reject whatever the case and blanks; anything else is no verdict (null)."""
    clean = F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))
    return F.when(clean.isin("accept", "reject"), clean)


def votes(df: DataFrame, item: str, judge: str, label: str, at: str | None = None) -> DataFrame:
    """item, judge, up (1 for accept, 0 for reject): a judge's last decided verdict on an item.

    Repeated rows count once. Of verdicts at the same moment, and where there is no time, accept is taken (a defined
    choice among ties). Rows without item, judge or a decided verdict are no votes.
    """
    up = (verdict(F.col(label)) == "accept").cast("int")
    when = F.col(at) if at else F.lit(None).cast("timestamp")
    rows = df.select(F.col(item).cast("string").alias("item"), F.col(judge).cast("string").alias("judge"), up.alias("up"), when.alias("at"))
    return rows.where("item is not null and judge is not null and up is not null").groupBy("item", "judge").agg(F.max(F.struct("at", "up"))["up"].alias("up"))


@dataclass
class Consensus:
    items: DataFrame
    judges: DataFrame
    #: One row: rounds, and the last change of any judge's reliability.
    rounds: DataFrame


def clipped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-30.0)), F.lit(30.0))


def probability(c: Column) -> Column:
    return 1 / (1 + F.exp(-clipped(c)))


def _judge_rows(state: DataFrame) -> DataFrame:
    """Per judge and kind: votes, and what the beliefs say of them; and the kind's share of accepted items, each item once."""
    p, up = probability(F.col("belief")), F.col("up")
    return state.groupBy("judge", "kind").agg(
        F.count("*").alias("n"),
        F.sum(p).alias("accepted"),
        F.sum(p * up).alias("both_up"),
        F.sum((1 - p) * (1 - up)).alias("both_down"),
        F.sum(p / F.col("votes")).alias("items_accepted"),
        F.sum(1 / F.col("votes")).alias("items"),
    )


MEASURES = ("n", "accepted", "both_up", "both_down")


def _by_judge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("judge").agg(*(F.sum(c).alias(c) for c in MEASURES))


def _prior(rows: DataFrame) -> dict[str, float]:
    """Log odds of accept of each kind; kinds are the few sorts of items that the caller names."""
    found = rows.where("kind is not null").groupBy("kind").agg(F.sum("items_accepted").alias("a"), F.sum("items").alias("n")).collect()
    return {r["kind"]: _log_odds(r["a"], r["n"]) for r in found}


def _log_odds(part: float, whole: float) -> float:
    return math.log(part + 1) - math.log(max(whole - part, 0.0) + 1)


def _worth() -> Column:
    """What a vote is worth in log odds of accept, from all the judge's other items, smoothed by one vote each way."""
    p, vote = probability(F.col("belief")), F.col("up")
    up = (F.col("both_up") - p * vote + 1) / (F.col("accepted") - p + 2)
    down = (F.col("both_down") - (1 - p) * (1 - vote) + 1) / (F.col("n") - F.col("accepted") - (1 - p) + 2)
    up, down = (F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6)) for x in (up, down))
    return F.when(vote == 1, F.log(up) - F.log(1 - down)).otherwise(F.log(1 - up) - F.log(down))


MEASURED = ("n", "accepted", "both_up", "both_down", "items_accepted", "items")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _votes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of items: kind, belief, votes of each, and judge and vote of every edge."""
    lists = batch.column(2)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    kind, belief = batch.column(1).to_numpy(), batch.column(3).to_numpy()
    return kind, belief, size, flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.float64)


def _measured(state: DataFrame, n_judges: int, n_kinds: int) -> np.ndarray:
    """MEASURED of each kind and judge, an array of three dimensions: what the beliefs say of the judges' votes.

    Each task adds up its own; a row for each judge and kind that it met goes through the shuffle.
    """
    n = n_judges * n_kinds

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(MEASURED), n))
        for batch in batches:
            kind, belief, size, judge, up = _votes_of(batch)
            at = np.repeat(kind.astype(np.int64), size) * n_judges + judge
            p, share = np.repeat(_sigmoid(belief), size), np.repeat(1 / np.maximum(size, 1), size)
            for row, values in zip(sums, (np.ones(len(p)), p, p * up, (1 - p) * (1 - up), p * share, share), strict=True):
                row += np.bincount(at, values, n)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(row[some]) for row in sums)], names=["at", *MEASURED])

    rows = state.select("item", "kind", "votes", "belief").mapInArrow(work, "at long, " + ", ".join(f"{c} double" for c in MEASURED))
    # judges times kinds rows at most, both of a checked number
    found = rows.groupBy("at").agg(*(F.sum(c).alias(c) for c in MEASURED)).toArrow()
    out = np.zeros((len(MEASURED), n))
    at = found.column("at").to_numpy()
    for row, c in zip(out, MEASURED, strict=True):
        row[at] = found.column(c).to_numpy()
    return out.reshape(len(MEASURED), n_kinds, n_judges)


def _believed(state: DataFrame, of_judge: np.ndarray, prior: np.ndarray) -> DataFrame:
    """The items with the belief that the judges' messages and the kind's prior make; see _worth."""
    share = state.sparkSession.sparkContext.broadcast((of_judge, prior))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (n, accepted, both_up, both_down), prior = share.value
        for batch in batches:
            kind, belief, size, judge, up = _votes_of(batch)
            p = np.repeat(_sigmoid(belief), size)
            right = np.clip((both_up[judge] - p * up + 1) / (accepted[judge] - p + 2), 1e-6, 1 - 1e-6)
            down = np.clip((both_down[judge] - (1 - p) * (1 - up) + 1) / (n[judge] - accepted[judge] - (1 - p) + 2), 1e-6, 1 - 1e-6)
            worth = np.where(up == 1, np.log(right) - np.log(1 - down), np.log(1 - right) - np.log(down))
            total = np.bincount(np.repeat(np.arange(len(size)), size), worth, len(size))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total + prior[kind])], names=["item", "kind", "votes", "belief"])

    return state.mapInArrow(work, state.schema)


def _in_rows(edges: DataFrame, of_judge: DataFrame, names: list[str], tolerance: float) -> tuple[DataFrame, DataFrame, dict[str, float], int, float]:
    """Rounds over items as rows that hold their votes: one judge has one vote on an item, so a row has a checked number.

    A round is one pass that adds up the judges and one that renews the beliefs; nothing but sums is shuffled.
    """
    spark = edges.sparkSession
    judges = [r["judge"] for r in of_judge.select("judge").orderBy("judge").collect()]
    number = F.broadcast(spark.createDataFrame(list(enumerate(judges)), "place int, judge string"))
    # items without a kind have a place of their own, and no prior
    sort = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(names)), F.lit(len(names)))
    votes = edges.join(number, "judge").groupBy("item", sort.cast("int").alias("kind")).agg(F.collect_list(F.struct("place", F.col("up").cast("int").alias("up"))).alias("votes"))
    share = F.aggregate("votes", F.lit(0), lambda n, v: n + v["up"]) / F.size("votes")
    state = cut(spread(votes.withColumn("belief", FIRST * (share - 0.5))))
    last, done, step = np.full(len(judges), 2.0), 0, math.inf
    while True:
        m = _measured(state, len(judges), len(names) + 1)
        by = m[:4].sum(axis=1)
        now = (by[2] + by[3]) / np.maximum(by[0], 1)
        prior = np.array([*(_log_odds(a, n) for a, n in zip(m[4].sum(axis=1)[:-1], m[5].sum(axis=1)[:-1], strict=True)), 0.0])
        step = float(np.abs(now - last).max(initial=0.0))
        if done and step < tolerance:
            break
        if done == MOST:
            raise RuntimeError(f"no consensus after {MOST} rounds: reliabilities still move by {step}")
        state, last, done = cut(_believed(state, by, prior)), now, done + 1
    rows = [(j, int(by[0][i]), *(float(x[i]) for x in by[1:])) for i, j in enumerate(judges)]
    people = spark.createDataFrame(rows, "judge string, n long, accepted double, both_up double, both_down double")
    return state.select("item", "belief"), people, dict(zip(names, prior.tolist(), strict=False)), done, step


def _in_joins(edges: DataFrame, of_judge: DataFrame, per_item: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame, dict[str, float], int, float]:
    """Rounds over votes as rows, for any number of judges: two aggregations, combined before the shuffle, and joins that split hot items and judges."""
    hot_items, hot_judges = hot_keys(per_item, ["item"], "votes"), hot_keys(of_judge, ["judge"])
    state = cut(salted_join(edges, per_item, ["item"], hot_items).withColumn("belief", FIRST * (F.col("ups") / F.col("votes") - 0.5)).drop("ups"))
    before: DataFrame | None = None
    done = 0
    while True:
        rows = cut(_judge_rows(state))
        judges, prior = cut(_by_judge(rows)), _prior(rows)
        moved = judges.select("judge", ((F.col("both_up") + F.col("both_down")) / F.col("n")).alias("r"))
        step = 2.0 if before is None else moved.join(before, "judge").agg(F.max(F.abs(F.col("r") - F.col("r0")))).first()[0] or 0.0
        if done and step < tolerance:
            break
        if done == MOST:
            raise RuntimeError(f"no consensus after {MOST} rounds: reliabilities still move by {step}")
        before = moved.withColumnRenamed("r", "r0")
        sent = salted_join(state, judges, ["judge"], hot_judges).select("item", "judge", "up", "kind", "votes", _worth().alias("to_item"))
        sums = sent.groupBy("item").agg(F.sum("to_item").alias("total"))
        belief = F.col("total") + _of_kind(prior)
        state, done = cut(salted_join(sent, sums, ["item"], hot_items).select("item", "judge", "up", "kind", "votes", belief.alias("belief"))), done + 1
    return state.groupBy("item").agg(F.first("belief").alias("belief")), judges, prior, done, step


def _of_kind(prior: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for kind, value in prior.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def consensus(edges: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> Consensus:
    """Consensus of each item, with its agreement, and the reliability of each judge.

    edges: item, judge, up. items: item, kind; each kind has its own share of accepted items. Messages, as log odds of
    accept against the rest (with two classes, reject's are their negatives):

    judge to item: what this judge's vote is worth, from all their *other* items: of those held accepted (rejected), how
    many the judge accepted (rejected), smoothed by one vote each way.
    item to judge: the prior of its kind and the messages of its *other* judges; the judge adds their own vote's worth
    of the round before and so has a belief in each item.

    Rounds go on until no judge's reliability moves by more than the tolerance. With judges of a checked number an item's
    votes are one row and a round needs no join (_in_rows), else votes stay rows (_in_joins); both send the same messages.
    Beliefs are written to the shared folder each round. An item without votes gets the verdict of its kind's prior and
    null agreement; ties are 'accept'.
    """
    spark = edges.sparkSession
    kinds = cut(items.select(F.col("item").cast("string").alias("item"), "kind").where("item is not null").dropDuplicates(["item"]))
    edges = cut(edges.join(kinds, "item"))
    per_item = cut(edges.groupBy("item").agg(F.sum("up").alias("ups"), F.count("*").alias("votes")))
    of_judge = cut(edges.groupBy("judge").agg(F.count("*").alias("n")))
    if under(of_judge, BROADCAST_JUDGES):
        # the few sorts of items that the caller names
        names = sorted(r["kind"] for r in kinds.select("kind").where("kind is not null").distinct().collect())
        believed, judges, prior, done, step = _in_rows(edges, of_judge, names, tolerance)
    else:
        believed, judges, prior, done, step = _in_joins(edges, of_judge, per_item, tolerance)
    whole = kinds.join(believed, "item", "left").join(per_item, "item", "left").withColumn("belief", F.coalesce("belief", _of_kind(prior)))
    ups, n = F.coalesce("ups", F.lit(0)), F.col("votes")
    accept = F.col("belief") >= 0
    found = whole.select(
        F.col("item").alias("item_id"),
        "kind",
        F.when(accept, "accept").otherwise("reject").alias("verdict"),
        F.coalesce(n, F.lit(0)).alias("n_votes"),
        F.try_divide(F.when(accept, ups).otherwise(n - ups), n).alias("agreement"),
        F.try_divide(ups * (ups - 1) + (n - ups) * (n - ups - 1), n * (n - 1)).alias("pair_agreement"),
        probability(F.abs(F.col("belief"))).alias("confidence"),
    )
    people = judges.select(
        "judge",
        F.col("n").alias("n_votes"),
        ((F.col("both_up") + F.col("both_down")) / F.col("n")).alias("reliability"),
        ((F.col("both_up") + 1) / (F.col("accepted") + 2)).alias("accepts_right"),
        ((F.col("both_down") + 1) / (F.col("n") - F.col("accepted") + 2)).alias("rejects_right"),
    )
    return Consensus(found, people, spark.createDataFrame([(done, float(step))], "rounds int, last_change double"))
