"""Sinks: shards and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.operators.order import indexed


def shards(rows: DataFrame, path: str, n: int, by: list[str], start: int = 0, contiguous: bool = False) -> None:
    """JSON lines in folders shard=start, start + 1, ...: dealt round by round, or in stretches. Never overwrites."""
    placed = indexed(rows, by)
    if contiguous:
        size = max(1, -(-placed.count() // n))
        shard = F.floor(F.col("row_index") / size)
    else:
        shard = F.col("row_index") % n
    placed.withColumn("shard", (shard + start).cast("int")).drop("row_index").write.partitionBy("shard").mode("errorifexists").json(path)


def manifest(df: DataFrame) -> DataFrame:
    """One row: rows and a hash of their content that doesn't depend on their order or partitions."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("content"))


def write_with_manifest(df: DataFrame, path: str) -> None:
    """Parquet, and its manifest beside it."""
    df.write.mode("errorifexists").parquet(path)
    manifest(df.sparkSession.read.parquet(path)).write.mode("errorifexists").json(f"{path.rstrip('/')}.manifest")


def write_json_with_manifest(df: DataFrame, path: str) -> None:
    """Lines of JSON, and their manifest beside them."""
    df.write.mode("errorifexists").json(path)
    manifest(df).write.mode("errorifexists").json(f"{path.rstrip('/')}.manifest")
