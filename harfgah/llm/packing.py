"""Problem 8: documents put into training sequences of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harfgah.llm.arrow import map_batches
from harfgah.session import cut

CAPACITY = 2048
#: Items of one size that are ranked in one task.
RANKED_AT_ONCE = 500_000


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over runs: (size, first rank, items, first sequence, offset in the sequence).

    Items of one size are a run, and so are neighbouring sequences with the same free space. In descending order of
    sizes, a sweep gives a run of items to its successor, the run of sequences with the least space that is enough: item
    number r of the one goes to sequence number r of the other, so no two want the same place; the space is updated and
    the sweep repeated until the items are placed. Where no space is enough, as many new sequences are begun as that
    size alone needs. There are at most capacity sizes, so this doesn't grow with the number of items.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: runs of sequences
    begun, out = 0, []
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            space = next((g for g in range(size, capacity) if gaps[g]), None)
            if space is None:
                first, n = begun, -(-left // (capacity // size))
                space, begun = capacity, begun + n
            else:
                first, n = gaps[space].pop()
            used = min(left, n)
            if used < n:
                gaps[space].append((first + used, n - used))
            out.append((size, rank, used, first, capacity - space))
            if space > size:
                gaps[space - size].append((first, used))
            rank, left = rank + used, left - used
    return out


def packed(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """key, part, seq_id, seq_offset, part_tokens: where each document goes.

    A document of more than capacity tokens is split into full sequences and a rest; no other one is. One with 0 or a
    null size has one row with part 0 and no sequence. sizes must be a stored table (it is read twice). Ranks within a
    size are made in salted groups, so that a size that many documents share isn't ranked in one task.
    """
    s = F.coalesce(F.col(size), F.lit(0)).cast("long")
    cap = F.lit(capacity).cast("long")
    items = sizes.select(F.col(key).alias("key"), s.alias("size")).where("size > 0")
    items = items.select("key", F.col("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / cap) - 1)).alias("part"))
    items = items.select("key", F.col("part").cast("int").alias("part"), F.least(cap, F.col("size") - F.col("part") * cap).cast("int").alias("size"))
    counts = items.groupBy("size").count().collect()  # at most capacity rows
    largest = max((r["count"] for r in counts), default=0)
    salts = max(1, -(-largest // RANKED_AT_ONCE))
    runs = np.array(best_fit({r["size"]: r["count"] for r in counts}, capacity) or np.zeros((0, 5)), np.int64)
    items = items.withColumn("salt", F.pmod(F.xxhash64("key", "part"), F.lit(salts)).cast("int"))
    w = Window.partitionBy("size", "salt").orderBy("key", "part")
    before = items.groupBy("size", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = items.withColumn("rank", F.row_number().over(w) - 1)
    if salts > 1:
        ranked = ranked.join(before.select("size", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    starts = (runs[:, 0] << 40) | runs[:, 1]
    kind = sizes.schema[key].dataType.simpleString()

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        part_size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
        run = runs[np.searchsorted(starts, (part_size << 40) | rank, "right") - 1]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4].astype(np.int32)), batch.column(2)], names=["key", "part", "seq_id", "seq_offset", "part_tokens"])

    schema = f"key {kind}, part int, seq_id long, seq_offset int, part_tokens int"
    placed = map_batches(ranked.select("key", "part", "size", "rank"), place, schema)
    none = sizes.where(s <= 0).select(F.col(key).alias("key"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("seq_id"), F.lit(None).cast("int").alias("seq_offset"), F.lit(0).alias("part_tokens"))
    return placed.unionByName(none).withColumnRenamed("key", key)


def fill(packing: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, and the share of their space that is used; all 0 or null without sequences."""
    return packing.where("seq_id is not null").agg((F.coalesce(F.max("seq_id") + 1, F.lit(0))).alias("n_sequences"), F.coalesce(F.sum("part_tokens"), F.lit(0)).alias("n_tokens")).withColumn("used_share", F.try_divide("n_tokens", F.col("n_sequences") * capacity))


def stored_sizes(tokens: DataFrame) -> DataFrame:
    """Sizes written to the shared folder: encoding is the dear part, and packing reads sizes twice."""
    return cut(tokens)
