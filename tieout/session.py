"""Session helpers: the shared scratch folder and cut points in long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What a cluster session should run with; `tune` applies the runtime ones.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Arrow batches of long texts stay small on both sides of the pipe to Python.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Names the shared folder of a session on one machine that has no spark.checkpoint.dir.
SCRATCH = "spark.tieout.scratch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the session names it.

    On a cluster a session without one is an error. On one machine it gets a new folder, once.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH, None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tieout-")
        spark.conf.set(SCRATCH, named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder; all of one application's lie together and can go when it has ended."""
    return f"{shared_folder(spark)}/tieout/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Used where several outputs hang off one expensive table: it is computed once,
    keeps size statistics for the planner, and outlives any executor.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Compressed bytes of a few columns that one task is given to work on.
SPREAD_BYTES = 4 << 20


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deal a table that comes in few file splits to all cores, and to more tasks the larger it is.

    A scan cannot cut a small file, and its splits are of a size that is right for copying but not for
    work on every row: everything after it would run in a few tasks that grow with the table.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES)), key)
