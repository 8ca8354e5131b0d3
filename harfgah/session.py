"""Session defaults, table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("harfgah").config("spark.driver.memory", memory)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, read from the session.

    Only where spark.checkpoint.dir is unset and the master is local (tests, the bench) is a temporary one made.
    """
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"harfgah-checkpoint-{os.getpid()}")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: it is computed once, survives the loss of an executor and ends the lineage."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table that is written once and read more than once."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def under(df: DataFrame, rows: int) -> bool:
    """Whether df has at most this many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: for few bytes with much work each, which adaptive execution would put into one task."""
    sc, parts = df.sparkSession.sparkContext, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, sc.defaultParallelism))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df hashed by keys over all cores, for a grouping by them that much work follows: its partitions aren't put together."""
    sc, parts = df.sparkSession.sparkContext, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, sc.defaultParallelism), *keys)


def parallel(df: DataFrame) -> DataFrame:
    """df as it is if its scan has a task for every core; a small file in one piece is dealt to all cores.

    For scans under costly expressions. A large table has more splits than cores and is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
