"""Streams: the engine's batch operators over unbounded tables. These are additions; nothing here has batch-only state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harfgah.engine import Engine
from harfgah.functions.words import naive_text
from harfgah.session import scratch


def converted(stream: DataFrame, text: str, output: str = "output") -> DataFrame:
    """Each text with its naive conversion: a projection, no state."""
    return stream.withColumn(output, naive_text(F.col(text)))


def transliterated(stream: DataFrame, engine: Engine, key: str, text: str) -> DataFrame:
    """key and result of each text by the whole engine, text by text: no state; words are remembered by the workers."""
    return engine.transliterate(stream, key, text)


def windowed_counts(stream: DataFrame, at: str, kind: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows by window and kind; state of a window is dropped once the watermark has passed it, rows later than that are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def latest(stream: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last revision of each key so far, for update or complete output: one row of state a key."""
    return stream.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in [*order, *columns]))


def run_once(result: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there, then stop; progress is kept in the shared folder, output files are written once."""
    progress = scratch(result.sparkSession, "stream")
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).outputMode(mode).trigger(availableNow=True).start()
