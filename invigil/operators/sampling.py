"""Random questions: n of each group, and n from a pool for each of many requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invigil.functions.numbering import running_total

# Fixed value: hexadecimal digits of an md5 that fit a LONG.
_DIGITS = 15


def random_order(seed: int | str, key: Column) -> Column:
    """A random but repeatable sort key: equal for the same seed and key on any cluster."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")))


def sample_n_per_group(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int | str) -> DataFrame:
    """``n`` random rows of each group, or all rows of a smaller group.

    ``n`` is a constant, so every task keeps at most ``n`` rows of a group before the
    exchange and a huge group costs no more than a small one.
    """
    window = Window.partitionBy(*by).orderBy(random_order(seed, F.col(key)), F.col(key))
    return df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= n).drop("_place")


def permuted(place: Column, size: Column, seed: Column) -> Column:
    """Where a random permutation of 0..``size`` - 1, chosen by ``seed``, puts ``place``.

    A Feistel network on the cells of a table of about sqrt(size) rows and columns, walked on from cell
    to cell until it is one of the first ``size`` (cycle walking).  The table has fewer cells to spare than rows, which
    bounds the walk; nearly always the first step or two are enough, and no more are looked at.
    """
    size = size.cast("long")
    rows = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    columns = F.ceil(size / rows).cast("long")

    def number(half: Column, turn: Column) -> Column:
        digest = F.md5(F.concat_ws("-", seed, turn.cast("string"), half.cast("string")))
        return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long")

    def turned(cell: Column, turn: Column) -> Column:
        up, across = cell["up"], cell["across"]
        return F.when(
            turn % 2 == 0, F.struct(((up + number(across, turn) % rows) % rows).alias("up"), across.alias("across"))
        ).otherwise(F.struct(up.alias("up"), ((across + number(up, turn) % columns) % columns).alias("across")))

    def step(at: Column) -> Column:
        cell = F.struct(F.floor(at / columns).cast("long").alias("up"), (at % columns).alias("across"))
        turns = F.array(*[F.lit(i) for i in range(_TURNS)])
        return F.aggregate(turns, cell, turned, lambda c: c["up"] * columns + c["across"])

    def walk(start: Column, steps: Column) -> Column:
        return F.aggregate(steps, start, lambda at, _: F.when(at < size, at).otherwise(step(at)))

    soon = walk(step(place.cast("long")), F.array(*[F.lit(i).cast("long") for i in range(_SOON)]))
    # A struct, so that the short walk is not worked out again for each use.
    return F.transform(F.array(soon), lambda at: F.when(at < size, at).otherwise(walk(at, F.sequence(F.lit(1).cast("long"), rows))))[0]


#: Turns of the network, and steps before the walk is taken to its bound.
_TURNS, _SOON = 4, 3


def draw(requests: DataFrame, size: str, n: str, seed: str, out: str) -> DataFrame:
    """Each request ``n`` times, with ``n`` different random numbers out of 1..``size`` as ``out``.

    The first ``n`` places of a permutation: no number is compared with another, so a draw takes as many steps as it
    has numbers.
    """
    places = requests.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)))
    number = permuted(F.col("_place"), F.col(size), F.col(seed)) + 1
    return places.withColumn(out, number).drop("_place")


def draw_questions(requests: DataFrame, pool: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """For each request, ``n`` random rows of the pool named by its ``by`` columns.

    ``requests`` has ``by``, ``n``, ``size`` (rows in that pool, at least ``n``) and
    ``draw_seed``; the result has its columns and ``key``.  Requests never meet their whole
    pool: the pool is numbered 1..size once, each request draws numbers, and the two meet
    on (pool, number).
    """
    numbered = running_total(pool.select(*by, key), key, "_before", within=by).select(
        *[F.col(c).alias(f"_p_{c}") for c in by], (F.col("_before") + 1).alias("_number"), key
    )
    drawn = draw(requests.where("n > 0"), "size", "n", "draw_seed", "_drawn")
    same = [F.col(c) == F.col(f"_p_{c}") for c in by]
    return drawn.join(numbered, [*same, F.col("_drawn") == F.col("_number")]).select(*requests.columns, key)
