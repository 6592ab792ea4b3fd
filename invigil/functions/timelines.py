"""Who may take a value that only one row can hold, when requests give values up as well as take them.

Requests come in order; each wants to give one row a new value.  It is refused if another row holds that value then, and
otherwise the row's old value is free for later requests of the same batch.

Every value has a timeline of claims on it and of later requests of its possible holders, which give it up if they are
accepted.  Those in turn are claims on other timelines.  A round walks all timelines at once.  Where a walk meets a give-up without a
verdict, it goes on for both verdicts, and what follows hangs on that one request; behind a second one it only knows who may hold
the value, which still refuses all others.  Claims that hang on one request are settled by pointer doubling (``turns.settle``),
however long their chains are; those that hang on more wait for another round.

The earliest open request is settled in every round, so rounds end.  More than one is needed only for requests that hang on
several open ones: rounds are bounded by how deep such requests are nested, not by the length of chains or timelines.

A walk keeps a few holders in memory, whatever the length of the timeline: timelines are sorted by Spark, which spills.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from invigil.functions.turns import settle
from invigil.session import new_folder, stage

#: Where the holders at the start stand in time: before all requests.
START = -(1 << 63)

STEP = "id long, parent long, yes boolean, no boolean, waits boolean"
_ARROW = pa.schema([("id", pa.int64()), ("parent", pa.int64()), ("yes", pa.bool_()), ("no", pa.bool_()), ("waits", pa.bool_())])


class Walk:
    """What is known of one value's holder after some of its events.

    Either who holds it (None: nobody) for both verdicts of one open request, which is None itself where nothing is open; or, once
    more than one is open, all rows that may hold it.  ``MANY`` rows are as good as any.
    """

    MANY = 64

    def __init__(self):
        self.open, self.holders, self.may = None, (None, None), None

    def claim(self, number: int, row: int, known: bool) -> tuple:
        """The claim's step: a verdict, a parent, or word that it waits."""
        if known:
            self.open, self.holders, self.may = None, (row, row), None
            return number, None, True, False, False
        if self.may is None:
            yes, no = (h is None or h == row for h in self.holders)
            self.holders = tuple(row if free else h for free, h in zip((yes, no), self.holders))
            parent = self.open if yes != no else None
            if self.holders[0] == self.holders[1]:
                self.open = None
            return number, parent, yes, no, False
        if self.may <= {None, row}:
            self.open, self.holders, self.may = None, (row, row), None
            return number, None, True, False, False
        if None not in self.may and row not in self.may and len(self.may) < self.MANY:
            return number, None, False, False, False
        self.may.add(row)
        return number, None, False, False, True

    def give_up(self, number: int, row: int, known: bool) -> None:
        if self.may is not None:
            if row in self.may or len(self.may) >= self.MANY:
                self.may.add(None)
                if known and len(self.may) < self.MANY:
                    self.may.discard(row)
        elif row in self.holders:
            yes, no = ((None if h == row else h) for h in self.holders)
            if known:
                self.holders = yes, no
            elif self.open in (None, number):
                self.open, self.holders = number, (yes, self.holders[1])
            else:
                self.open, self.may = None, {None, *self.holders}
                return
            if self.holders[0] == self.holders[1]:
                self.open = None


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events (value, at, row, claims, known) to the steps of the claims that are open."""
    value, walk = None, Walk()
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("value", "at", "row", "claims", "known"))
        for own, at, row, claims, known in zip(*columns):
            if own != value:
                value, walk = own, Walk()
            if not claims:
                walk.give_up(at, row, known)
                continue
            step = walk.claim(at, row, known)
            if not known:
                out.append(step)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 5, _ARROW)], schema=_ARROW)


def _events(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Claims, and for each of them the later requests of its row that may give the value up.

    Of these the first two that are not refused are enough, and the first accepted one: a walk tells one open give-up from
    several, and what follows a claim on the same value belongs to that claim.
    """
    wanted = requests.select("value").distinct()
    start = held.join(wanted, "value", "left_semi").groupBy("value").agg(F.min("row").alias("row"))
    start = start.select(F.lit(START).alias("at"), "row", "value", F.lit(True).alias("known"))
    claims = start.unionByName(requests.select(F.col("req_id").alias("at"), "row", "value", F.col("verdict").isNotNull().alias("known")))
    order = Window.partitionBy("row").orderBy("at")
    back = Window.partitionBy("row").orderBy(F.desc("at"))
    event = F.struct("at", "value", "known")
    seen = claims.withColumns({"_one": F.lead(event, 1).over(order), "_two": F.lead(event, 2).over(order)})
    # The last of a run of claims on one value knows what follows; the others take it from there.
    follows = F.when(F.col("_one.value") != F.col("value"), F.struct(F.col("_one").alias("one"), F.col("_two").alias("two")))
    seen = seen.withColumn("_next", F.last(follows, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    sure = F.last(F.when(F.col("known"), event), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("_sure", sure)
    later = F.array(F.struct("at", F.lit(True).alias("claims"), "known"), *[
        F.when(F.col(c).isNotNull() & (F.col(f"{c}.value") != F.col("value")), F.struct(F.col(f"{c}.at"), F.lit(False).alias("claims"), F.col(f"{c}.known")))
        for c in ("_next.one", "_next.two", "_sure")
    ])
    return seen.select("value", "row", F.explode(F.array_compact(later)).alias("e")).select("value", "e.at", "row", "e.claims", "e.known")


def decide(requests: DataFrame, held: DataFrame, rounds: list | None = None) -> DataFrame:
    """``(req_id, accepted)`` for requests ``(req_id, row, value)`` in the order of their unique LONG ids.

    ``held(row, value)`` says who holds what at the start; of several holders of one value the smallest counts.  ``rounds``,
    if given, is appended to in every round.
    """
    spark = requests.sparkSession
    folder = new_folder(spark, "timelines")
    schema = "_id long, accepted boolean"
    left = stage(requests.select("req_id", "row", "value", F.lit(None).cast("boolean").alias("verdict")), "claims")
    number = 0
    while left.where("verdict is null").take(1):
        number += 1
        if rounds is not None:
            rounds.append(number)
        events = _events(_concerned(left, held) if number > 1 else left, held)
        steps = events.repartition("value").sortWithinPartitions("value", "at", "claims").mapInArrow(_walk, STEP)
        path = f"{folder}/round={number}"
        settle(steps).select(F.col("id").alias("_id"), "accepted").write.parquet(path)
        known = left.join(spark.read.schema(schema).parquet(path), F.col("req_id") == F.col("_id"), "left")
        # Refused requests play no further part.
        kept = F.coalesce("verdict", "accepted")
        left = stage(known.select("req_id", "row", "value", kept.alias("verdict")).where("coalesce(verdict, true)"), "claims")
    if not number:
        return spark.createDataFrame([], "req_id long, accepted boolean")
    return spark.read.schema(schema).parquet(folder).select(F.col("_id").alias("req_id"), "accepted")


def _concerned(left: DataFrame, held: DataFrame) -> DataFrame:
    """The requests of rows that claim, or held at the start, a value that is still open."""
    open_ = left.where("verdict is null").select(F.col("value").alias("_open")).distinct()
    rows = left.select("row", "value").unionByName(held.select("row", "value"))
    rows = rows.join(open_, F.col("value") == F.col("_open"), "left_semi").select(F.col("row").alias("_row")).distinct()
    return left.join(rows, F.col("row") == F.col("_row"), "left_semi")
