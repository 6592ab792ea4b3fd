"""Reading and changing whole tables.

A change is a pure ``DataFrame -> DataFrame`` step that yields the table's next version;
``publish`` writes that version beside the old one, which readers keep until they ask
for the newest again.
"""

from __future__ import annotations

import datetime as dt
from collections import ChainMap
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invigil.schema import TABLES
from invigil.session import writing

Tables = Mapping[str, DataFrame]


def replace(tables: Tables, **changed: DataFrame) -> Tables:
    """``tables`` with some of them exchanged; the others are not touched."""
    return ChainMap(changed, tables)


def conform(df: DataFrame, table: str, also: Sequence[str] = ()) -> DataFrame:
    """Exactly the declared columns and types, in order, then those named in ``also``; a flag that
    was left out is false."""
    spec = TABLES[table]
    columns = []
    for field in spec.struct:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if (table, field.name) in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[table, field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns, *also)


# Fixed value: the one column with a default.
DEFAULTS = {("MCQChoice", "Ch_Correct"): False}


def load_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table].struct).parquet(f"{root}/{table}")


def load_tables(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Typed scans of the tables below ``root``; the files' schema is never inferred."""
    return {name: load_table(spark, root, name) for name in (names or TABLES)}


def register(tables: Tables, names: Iterable[str] | None = None) -> None:
    """Expose tables to ``spark.sql`` under their own names."""
    for name in names or TABLES:
        tables[name].createOrReplaceTempView(name)


# -- changes ---------------------------------------------------------------------------


def update_from_join(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """``target`` with ``columns`` taken from the matching row of ``changes``.

    ``changes`` has at most one row per key.  A NULL in a change is stored as NULL; rows
    without a change stay as they are, and changes without a row do nothing.
    """
    return _merge(target, changes, keys, columns, "left")


def upsert(
    target: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """Update ``columns`` where the key exists, insert where it does not.

    Columns outside ``columns`` keep the old value, or NULL in a new row; both sides hold
    a key once.
    """
    return _merge(target, incoming, keys, columns, "full")


def _merge(target, changes, keys, columns, how):
    renamed = changes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(f"_n_{c}") for c in columns],
        F.lit(True).alias("_changed"),
    )
    joined = target.join(renamed, [F.col(k) == F.col(f"_k_{k}") for k in keys], how)
    out = []
    for name in target.columns:
        if name in keys:
            value = F.coalesce(F.col(name), F.col(f"_k_{name}"))
        elif name in columns:
            value = F.when(F.col("_changed"), F.col(f"_n_{name}")).otherwise(F.col(name))
        else:
            value = F.col(name)
        out.append(value.cast(target.schema[name].dataType).alias(name))
    return joined.select(*out)


def delete_rows(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` without the rows whose key is listed in ``doomed``."""
    return target.join(doomed.select(*keys), list(keys), "left_anti").select(*target.columns)


# -- versions and snapshots ------------------------------------------------------------


def publish(df: DataFrame, root: str, table: str, version: int) -> str:
    """Write one complete version of a table; a path that is being read is never replaced."""
    path = f"{root}/{table}/version={version:09d}"
    conform(df, table).write.mode("errorifexists").parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """Write a fact as ``buckets`` files hashed by ``key``, one file each, and name it ``table``.

    Two facts with the same key values and number of buckets join on it without an exchange.
    The number is a property of the table: a task reads a whole bucket, so it has to grow with
    the data (see ``Star.n_buckets``).
    """
    with writing(df.repartition(buckets, key), dense=True) as writer:
        writer = writer.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
        writer.option("path", path).saveAsTable(table)


def snapshot_tables(
    tables: Tables,
    root: str,
    day: dt.date,
    names: Iterable[str] | None = None,
) -> dict[str, str]:
    """Full compressed export of every table for one day; a second run replaces that day's copy."""
    stamp = day.strftime("%Y%m%d")
    paths = {}
    for name in names or TABLES:
        paths[name] = f"{root}/{name}/snapshot_date={stamp}"
        tables[name].write.mode("overwrite").option("compression", "zstd").parquet(paths[name])
    return paths


def load_snapshot(spark: SparkSession, root: str, day: dt.date, names: Iterable[str] | None = None):
    stamp = day.strftime("%Y%m%d")
    return {
        name: spark.read.schema(TABLES[name].struct).parquet(f"{root}/{name}/snapshot_date={stamp}")
        for name in names or TABLES
    }
