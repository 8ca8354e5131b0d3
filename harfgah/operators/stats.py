"""Resampling and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harfgah.operators.order import indexed


def bootstrap(rows: DataFrame, by: list[str], measures: dict[str, tuple[str, str]], resamples: int, seed: str) -> DataFrame:
    """b and one ratio for each measure (name: numerator, denominator) in each resample.

    Draw i of resample b takes the row whose place is a hash of (seed, b, i), so anyone can repeat it. Draws are made
    from a range and joined to the placed rows by equality: resamples times rows, never all pairs.
    """
    spark = rows.sparkSession
    placed = indexed(rows, by, "place")
    n = placed.count()
    if not n:
        return spark.createDataFrame([], "b long, " + ", ".join(f"{m} double" for m in measures))
    draws = spark.range(resamples * n).select((F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("i"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("b").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % n
    drawn = draws.select("b", place.alias("place")).groupBy("b", "place").agg(F.count("*").alias("times")).join(placed, "place")
    ratio = {m: F.try_divide(F.sum(F.col("times") * F.col(a)), F.sum(F.col("times") * F.col(z))) for m, (a, z) in measures.items()}
    return drawn.groupBy("b").agg(*(F.coalesce(v, F.lit(0.0)).alias(m) for m, v in ratio.items()))


def interval(samples: DataFrame, column: str, resamples: int) -> DataFrame:
    """lo, hi: the samples at the places floor(q * resamples) of 2.5 and 97.5 per cent; there are as many rows as resamples."""
    ordered = F.array_sort(F.collect_list(column))
    at = lambda q: F.get(ordered, F.lit(min(resamples - 1, int(q * resamples))))
    return samples.agg(at(0.025).alias("lo"), at(0.975).alias("hi"))


def kappa(agree: Column, a: Column, b: Column, n: Column) -> Column:
    """Cohen's kappa of two yes-or-no judges from counts: both the same, yes of each, all."""
    po, pa_, pb = agree / n, a / n, b / n
    pe = pa_ * pb + (1 - pa_) * (1 - pb)
    return F.when(pe == 1, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))
