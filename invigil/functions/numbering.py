"""Consecutive numbers over a large table without a global window.

The order column is a unique LONG, so a block of ``2**20`` neighbouring values holds at
most ``2**20`` rows.  Rows are numbered inside their block, blocks inside a block of
blocks, and the few remaining totals at the top.  Every window partition is therefore
bounded by a constant, whatever the data looks like, and the result depends on the data
alone, so a recomputed task gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 20


def running_total(
    df: DataFrame,
    order: str,
    out: str,
    weight: Column | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (1 if not given) over all rows before this one.

    Rows are ordered by ``order``, unique in each group of ``within``.
    """
    within = list(within)
    weight = F.lit(1) if weight is None else weight
    rows = df.withColumn("_w", weight.cast("long")).withColumn("_b1", F.shiftright(order, BLOCK_BITS))
    rows = rows.withColumn("_b2", F.shiftright("_b1", BLOCK_BITS))

    blocks = rows.groupBy(*within, "_b2", "_b1").agg(F.sum("_w").alias("_w"))
    tops = blocks.groupBy(*within, "_b2").agg(F.sum("_w").alias("_w"))

    rows = _before(rows, [*within, "_b2", "_b1"], order, "_o0")
    blocks = _before(blocks, [*within, "_b2"], "_b1", "_o1").drop("_w")
    tops = _before(tops, within, "_b2", "_o2").drop("_w")

    numbered = _join(_join(rows, blocks, [*within, "_b2", "_b1"]), tops, [*within, "_b2"])
    numbered = numbered.withColumn(out, F.col("_o0") + F.col("_o1") + F.col("_o2"))
    return numbered.select(*df.columns, out)


def _before(df: DataFrame, by: Sequence[str], order: str, out: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum("_w").over(window), F.lit(0).cast("long")))


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return left.join(renamed, condition).drop(*[f"_r{k}" for k in keys])


def last_id(table: DataFrame, id_col: str) -> Column:
    """The largest id in use, 0 for an empty table, as a scalar subquery."""
    return table.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()


def append_with_ids(
    existing: DataFrame,
    new_rows: DataFrame,
    id_col: str,
    order: str,
    then: Sequence[str] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """``new_rows`` with ids that follow the largest one in ``existing``.

    Ids follow ``order``, a LONG.  Where several rows share a value of it, ``then``
    orders them; the caller sees to it that such a set is small (the questions of one
    exam, the answers of one seat).  ``counts(order, n)`` says how many rows share each
    value, if the caller knows already.
    """
    base = last_id(existing, id_col)
    if not then:
        numbered = running_total(new_rows, order, "_before")
        return numbered.withColumn(id_col, (base + F.col("_before") + 1).cast("long")).drop("_before")
    if counts is None:
        counts = new_rows.groupBy(order).agg(F.count("*").alias("n"))
    offsets = running_total(counts, order, "_before", F.col("n")).select(F.col(order).alias("_order"), "_before")
    place = F.row_number().over(Window.partitionBy(order).orderBy(*then))
    numbered = new_rows.withColumn("_place", place).join(offsets, F.col(order) == F.col("_order"))
    return numbered.withColumn(id_col, (base + F.col("_before") + F.col("_place")).cast("long")).drop(
        "_before", "_place", "_order"
    )
