"""Joins whose keys may be hot: one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with fewer rows than this is never split.
LEAST_HOT = 50_000
#: A key is hot only if it holds more than one of so many of all rows; so there are fewer hot keys than this.
MOST_HOT = 5_000


def hot_keys(counts: DataFrame, on: list[str], n: str = "n", least: int = LEAST_HOT) -> DataFrame | None:
    """The hot keys of a table of counts by key, with the number of salts each gets; None if there are none.

    A hot key has more than 1/MOST_HOT of all rows, so fewer than MOST_HOT rows come to the driver whatever the data.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(least, total // MOST_HOT)
    rows = counts.where(F.col(n) > limit).select(*on, F.ceil(F.col(n) / limit).cast("int").alias("_salts")).collect()
    schema = T.StructType([*(counts.schema[k] for k in on), T.StructField("_salts", T.IntegerType())])
    return counts.sparkSession.createDataFrame(rows, schema) if rows else None


def salted_join(many: DataFrame, few: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """many joined to few on keys; rows of many under a hot key are spread over its salts, those of few repeated for each.

    The salt is a hash of the row, so a task that runs again makes the same one.
    """
    if hot is None:
        return many.join(few, on, how)
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    left = many.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), salts).cast("int")).drop("_salts")
    right = few.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
