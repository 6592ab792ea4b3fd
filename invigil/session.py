"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

# Runtime settings that matter at scale.  Split skewed join partitions even where that
# costs one more exchange, and read the session clock as UTC.  Broadcasts are never
# hinted: Catalyst decides by size, before the run and again from shuffle statistics.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A join on a fact's bucket column and more finds its rows in place.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    # What goes to a Python worker at once: the JVM holds it as vectors and as a message, the worker once more.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

_SCRATCH = "spark.checkpoint.dir"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names, else one in the warehouse, which is shared as well.

    The same on any master; every run works in a new folder below it.
    """
    context = spark.sparkContext
    root = spark.conf.get(_SCRATCH, None) or context.getConf().get(_SCRATCH) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder of this application: all it leaves behind lies in one place."""
    return f"{scratch_root(spark)}/invigil/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def writing(df: DataFrame, dense: bool = False) -> Iterator[DataFrameWriter]:
    """A writer whose own shuffles are dropped when it ends, not when the driver next collects its garbage.

    ``dense`` packs the files harder: for rows that are many.  Catalyst broadcasts by the size of files, so what is
    looked up by key stays packed as it is everywhere.

    Only for a write: its plan is never run again, so nothing asks for these shuffles a second time.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield df.write.option("compression", "zstd") if dense else df.write
    finally:
        spark.conf.set(_CLEANUP, before)


def stage_dense(df: DataFrame, purpose: str) -> DataFrame:
    """As ``stage``, for rows that are many."""
    path = new_folder(df.sparkSession, purpose)
    with writing(df, dense=True) as writer:
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    For results that several later steps read: they scan columns of a finished table, with
    its true size known, instead of running all that led to it again.
    """
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
