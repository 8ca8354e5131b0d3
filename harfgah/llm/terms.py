"""Problem 3: frequency of every distinct term, heavy ones counted where they stand, light ones by a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.llm.arrow import pieces
from harfgah.llm.text import Words
from harfgah.session import cut

#: A term is heavy if it is more than this share of all words; so there are at most 1/HEAVY of them.
HEAVY = 1 / 2000
#: Light terms that a task gathers before it hands them on.
GATHERED = 200_000


def counted(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: the hash of each term, a place where it stands, its occurrences and its records."""
    h, at, number, n = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
    # records: of each term's occurrences, those in another text than the one before it
    order = np.lexsort((w.text, number))
    fresh = np.diff(number[order], prepend=-1).astype(bool) | np.diff(w.text[order], prepend=-1).astype(bool)
    return h, at, n, np.bincount(number[order][fresh], minlength=len(h))


class Summary:
    """Misra-Gries: of a stream of counts, every term with more than n/size of them is kept, in bounded space."""

    def __init__(self, size: int) -> None:
        self.size, self.counts, self.n = size, {}, 0

    def add(self, terms: list[str], counts: list[int]) -> None:
        kept = self.counts
        for t, c in zip(terms, counts, strict=True):
            kept[t] = kept.get(t, 0) + c
        self.n += sum(counts)
        if len(kept) > self.size:
            cut = sorted(kept.values(), reverse=True)[self.size]
            self.counts = {t: c - cut for t, c in kept.items() if c > cut}


def heavy_terms(df: DataFrame, text: str = "text", share: float = HEAVY) -> list[str]:
    """All terms that are more than a share of the words, found in one pass over all rows; at most 4/3 of 1/share come to the driver.

    Each task keeps a summary that loses at most share/4 of its words from a term's count, so a term above the share is
    still above three quarters of it when the summaries are added up.
    """
    size = int(4 / share)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Summary(size)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in pieces(texts):
                w = Words(texts[a:b])
                _, at, n, _ = counted(w)
                s.add(list(map(w.word, at.tolist())), n.tolist())
        yield pa.RecordBatch.from_pydict({"term": pa.array([None, *s.counts], pa.string()), "n": pa.array([s.n, *s.counts.values()], pa.int64())})

    # a row for each term that some task kept, and the number of all words under the null term
    found = cut(df.select(F.col(text).alias("text")).mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
    total = found.where("term is null").agg(F.sum("n")).first()[0] or 0
    return sorted(r["term"] for r in found.where((F.col("n") > total * share * 0.75) & F.col("term").isNotNull()).select("term").collect())


def term_counts(df: DataFrame, text: str = "text", share: float = HEAVY) -> DataFrame:
    """term, n_occurrences, n_records of every distinct term; df is read twice, whole.

    Heavy terms are added up in one exact counter array per task (there are at most 4/3 of 1/share, a proven bound for the
    broadcast); the arrays, one row a task, are summed place by place. Light terms are gathered per task, and only they
    are shuffled by term. The two tables of counts are put together; no term is in both. Null, empty and wordless texts
    have no terms. An empty table gives no rows.
    """
    spark = df.sparkSession
    heavy = spark.sparkContext.broadcast(heavy_terms(df, text, share))
    columns = ["term", "n", "r", "heavy_n", "heavy_r"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = heavy.value
        place = {t: i for i, t in enumerate(names)}
        n_heavy, r_heavy = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        light: dict[str, list[int]] = {}

        def gathered() -> pa.RecordBatch:
            n, r = ([c[k] for c in light.values()] for k in (0, 1))
            nothing = pa.nulls(len(light), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(list(light), pa.string()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), nothing, nothing], names=columns)

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in pieces(texts):
                w = Words(texts[a:b])
                _, at, n, r = counted(w)
                terms = list(map(w.word, at.tolist()))
                where = np.fromiter((place.get(t, -1) for t in terms), np.int64, len(terms))
                known = where >= 0
                n_heavy[where[known]] += n[known]
                r_heavy[where[known]] += r[known]
                for i in np.flatnonzero(~known).tolist():
                    c = light.setdefault(terms[i], [0, 0])
                    c[0] += int(n[i])
                    c[1] += int(r[i])
                if len(light) > GATHERED:
                    yield gathered()
                    light = {}
        yield gathered()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([n_heavy.tolist()], pa.list_(pa.int64())), pa.array([r_heavy.tolist()], pa.list_(pa.int64()))], names=columns)

    # read by both sides below, and little: a row for each light term of a task, and one row of counters
    parts = cut(df.select(F.col(text).alias("text")).mapInArrow(work, "term string, n long, r long, heavy_n array<long>, heavy_r array<long>"))
    total = [F.sum("n").alias("n_occurrences"), F.sum("r").alias("n_records")]
    light = parts.where("heavy_n is null").groupBy("term").agg(*total)
    place = parts.where("heavy_n is not null").select(F.posexplode(F.arrays_zip(F.col("heavy_n").alias("n"), F.col("heavy_r").alias("r"))).alias("place", "c"))
    names = F.broadcast(spark.createDataFrame(list(enumerate(heavy.value)), "place int, term string"))
    counters = place.groupBy("place").agg(F.sum("c.n").alias("n_occurrences"), F.sum("c.r").alias("n_records")).join(names, "place")
    return light.unionByName(counters.drop("place")).where("n_occurrences > 0")


def marked(counts: DataFrame, records: DataFrame, rare_below: int = 3, common_part: int = 20) -> DataFrame:
    """counts with mark: 'rare' in fewer than rare_below records, 'common' in more than one common_part-th of all, else null.

    records: one row with n_all, the number of all records, with or without text.
    """
    rare, common = F.col("n_records") < rare_below, F.col("n_records") * common_part > F.col("n_all")
    return counts.crossJoin(F.broadcast(records)).select("term", "n_occurrences", "n_records", F.when(common, "common").when(rare, "rare").alias("mark"))
