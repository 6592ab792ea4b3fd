"""Adding to and changing the dimension tables, in batches.

Two operators serve all of them: ``ingest`` appends rows with new ids, ``merge`` changes
rows by id.  What differs between the tables is data: which columns a caller gives and
which rules apply.  Requests carry the table's own column names and a unique LONG
``req_id`` that tells their order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invigil.functions.numbering import append_with_ids
from invigil.functions.rules import ERROR, Rule, judge, split, violates_required
from invigil.functions.text import text_key
from invigil.functions.timelines import decide
from invigil.functions.turns import settle
from invigil.operators.exams import first_per_key, known, lost
from invigil.schema import TABLES
from invigil.session import new_folder, stage
from invigil.sources.tables import Tables, conform, update_from_join

CODES = ["50600", "I-15", "I-14", "I-1", "I-12"]


@dataclass(frozen=True)
class Entry:
    """What a caller gives for one table, and which uniqueness and rules that touches."""

    table: str
    columns: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...]
    # Code reported when a reference is missing, by column; I-14 unless named here.
    missing: tuple[tuple[str, str], ...] = ()


# The columns each operator takes.
ADD = {
    "Branch": Entry("Branch", ("Br_Name", "Br_Location"), (("Br_Name",),)),
    "Track": Entry("Track", ("Trk_Name", "Trk_BrId"), (("Trk_Name", "Trk_BrId"),), (("Trk_BrId", "50600"),)),
    "Intake": Entry("Intake", ("Int_Name", "Int_StartDate"), (("Int_Name",),)),
    "Student": Entry(
        "Student",
        ("St_User", "St_Name", "St_Email", "St_Phone", "St_BrId", "St_TrkId", "St_IntId"),
        (("St_User",), ("St_Email",)),
    ),
}
CHANGE = {
    "Branch": Entry("Branch", ("Br_Name", "Br_Location"), (("Br_Name",),)),
    "Track": Entry("Track", ("Trk_Name", "Trk_BrId"), (("Trk_Name", "Trk_BrId"),)),
    "Student": Entry(
        "Student", ("St_Name", "St_Email", "St_Phone", "St_BrId", "St_TrkId", "St_IntId"), (("St_Email",),)
    ),
}


class Changed(NamedTuple):
    rows: DataFrame
    rejected: DataFrame


def _rules(requests: DataFrame, tables: Tables, entry: Entry) -> tuple[DataFrame, list[Rule]]:
    """Required values, references and the student's track, in order."""
    spec, missing = TABLES[entry.table], dict(entry.missing)
    first: list[Rule] = []
    later: list[Rule] = [violates_required(entry.table, entry.columns)]
    for column, target in spec.references.items():
        if entry.table == "Student" and target == "Track":
            tracks = tables["Track"].select("Trk_Id", "Trk_BrId")
            requests, found = requests.join(tracks, F.col(column) == F.col("Trk_Id"), "left"), F.col("Trk_Id").isNotNull()
        else:
            requests, found = known(requests, column, tables[target], TABLES[target].key)
        if column in missing:
            first.append((missing[column], ~found))
        else:
            later.append(lost(column, found))
    if entry.table == "Student":
        later.append(("I-1", F.col("Trk_BrId") != F.col("St_BrId")))
    return requests, [*first, *later]


def _keyed(df: DataFrame, table: str, key: Sequence[str], ci: bool, prefix: str) -> DataFrame:
    """``df`` with the comparable form of a unique key in columns ``<prefix>0..``."""
    spec = TABLES[table]
    for i, column in enumerate(key):
        text = spec.column(column).type == "string"
        df = df.withColumn(f"{prefix}{i}", text_key(F.col(column), ci) if text else F.col(column))
    return df


def _reject_taken(judged: DataFrame, existing: DataFrame, entry: Entry, ci: bool) -> DataFrame:
    """I-12 where a unique key is held by an existing row.

    The holders of the keys that are asked for are written down first, one per key: their
    table then goes straight into the join, which lets Spark split the partition of a key
    that many requests ask for.
    """
    spec = TABLES[entry.table]
    judged = stage(judged, "requests")
    for n, key in enumerate(entry.unique):
        names = [f"_k{n}_{i}" for i in range(len(key))]
        judged = _keyed(judged, entry.table, key, ci, f"_k{n}_")
        wanted = judged.select(*names).distinct()
        held = _keyed(existing, entry.table, key, ci, f"_k{n}_").join(wanted, names, "left_semi")
        held = held.groupBy(*names).agg(F.min(spec.key).alias("_holder")).withColumnsRenamed({c: f"_t{c}" for c in names})
        joined = judged.join(stage(held, "held"), [F.col(c) == F.col(f"_t{c}") for c in names], "left")
        taken = F.col("_holder").isNotNull()
        judged = joined.withColumn(ERROR, F.when(F.col(ERROR).isNull() & taken, "I-12").otherwise(F.col(ERROR)))
        judged = judged.drop("_holder", *names, *[f"_t{c}" for c in names])
    return judged


def judge_ingest(requests: DataFrame, tables: Tables, table: str, ci: bool = False) -> DataFrame:
    """``requests`` with ``error_code``; requests for one unique key are taken in order."""
    entry = ADD[table]
    joined, rules = _rules(requests, tables, entry)
    judged = judge(joined, rules).select(*requests.columns, ERROR)
    if len(entry.unique) > 1:
        return _in_turn(_reject_taken(judged, tables[table], entry, ci), entry, ci)
    key = entry.unique[0]
    names = [f"_k{i}" for i in range(len(key))]
    keyed = stage(_keyed(judged, table, key, ci, "_k"), "requests")
    return first_per_key(keyed, names, _keyed(tables[table], table, key, ci, "_k")).drop(*names)


def _in_turn(judged: DataFrame, entry: Entry, ci: bool, rounds: list | None = None) -> DataFrame:
    """Several unique keys: what one request loses on one key it leaves free on the other.

    A request that is first on all of its keys is accepted.  One that comes second, after a
    single rival, is accepted exactly if that rival is not: such chains are settled by pointer
    doubling, however long.  Requests for a key of an accepted one are refused, the rest go
    into another round.  Rounds are bounded by how deep requests with several rivals are nested: a request of depth d
    is settled in round d at the latest, where d is one more than the depth of the deepest of its rivals that has
    several rivals itself.  Each writes its verdicts to one folder and goes on from a stored table, so no plan grows.
    """
    spark = judged.sparkSession
    folder = new_folder(spark, "in-turn")
    columns = ["req_id"]
    keyed = judged.where(F.col(ERROR).isNull())
    for n, key in enumerate(entry.unique):
        keyed = keyed.withColumn(f"_u{n}", _as_text(entry.table, key, ci))
        columns.append(f"_u{n}")
    open_ = stage(keyed.select(*columns), "open")
    schema = spark.createDataFrame([], "req_id long, accepted boolean").schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/round=0")
    number = 0
    while open_.take(1):
        number += 1
        if rounds is not None:
            rounds.append(number)
        steps = open_
        for n in range(len(entry.unique)):
            steps = _with_rivals(steps, open_, f"_u{n}", n)
        # Earlier rivals over all keys: none, one and the same, or more.
        rivals = [F.col(f"_rival{n}") for n in range(len(entry.unique))]
        many = F.lit(False)
        for n in range(len(entry.unique)):
            many = many | F.col(f"_many{n}")
        parent = F.coalesce(*rivals)
        many = many | F.coalesce(F.least(*rivals) != F.greatest(*rivals), F.lit(False))
        verdicts = settle(
            steps.select(
                F.col("req_id").alias("id"),
                F.when(~many, parent).alias("parent"),
                parent.isNull().alias("yes"),
                parent.isNotNull().alias("no"),
                many.alias("waits"),
            )
        )
        verdicts = stage(verdicts.select(F.col("id").alias("req_id"), "accepted"), "verdicts")
        verdicts.write.parquet(f"{folder}/round={2 * number - 1}")
        settled = verdicts.select(F.col("req_id").alias("_settled"))
        rest = open_.join(settled, F.col("req_id") == F.col("_settled"), "left_anti")
        won = verdicts.where("accepted").select(F.col("req_id").alias("_won"))
        winners = open_.join(won, F.col("req_id") == F.col("_won"), "left_semi")
        lose = F.lit(False)
        for n in range(len(entry.unique)):
            taken = winners.select(F.col(f"_u{n}").alias(f"_w{n}")).distinct()
            rest = rest.join(taken, F.col(f"_u{n}") == F.col(f"_w{n}"), "left")
            lose = lose | F.col(f"_w{n}").isNotNull()
        rest = stage(rest.select(*columns, lose.alias("_lose")), "rest")
        refused = rest.where("_lose").select("req_id", F.lit(False).alias("accepted"))
        refused.write.parquet(f"{folder}/round={2 * number}")
        open_ = rest.where(~F.col("_lose")).select(*columns)
    verdicts = spark.read.schema(schema).parquet(folder).select(F.col("req_id").alias("_req"), "accepted")
    found = judged.join(verdicts, F.col("req_id") == F.col("_req"), "left")
    late = F.col(ERROR).isNull() & ~F.coalesce("accepted", F.lit(True))
    return found.withColumn(ERROR, F.when(late, "I-12").otherwise(F.col(ERROR))).select(*judged.columns)


def _as_text(table: str, key: Sequence[str], ci: bool) -> Column:
    """A unique key as one text, equal exactly where the key is."""
    spec = TABLES[table]

    def part(column: str) -> Column:
        if spec.column(column).type != "string":
            return F.col(column).cast("string")
        text = F.rtrim(F.col(column))
        return F.lower(text) if ci else text

    return F.to_json(F.array(*[part(c) for c in key]))


def _with_rivals(steps: DataFrame, open_: DataFrame, key: str, n: int) -> DataFrame:
    """``steps`` with the one earlier request for the same key, or word that there are more."""
    firsts = stage(open_.groupBy(F.col(key).alias("_k")).agg(F.min("req_id").alias("_first")), "firsts")
    after = open_.join(firsts, F.col(key) == F.col("_k")).where(F.col("req_id") > F.col("_first"))
    seconds = after.groupBy("_k").agg(F.min("_first").alias("_first"), F.min("req_id").alias("_second"))
    seconds = stage(seconds, "seconds")
    joined = steps.join(seconds, F.col(key) == F.col("_k"), "left")
    later = F.coalesce(F.col("req_id") > F.col("_second"), F.lit(False))
    rival = F.when(F.col("req_id") == F.col("_second"), F.col("_first"))
    return joined.select(*steps.columns, rival.alias(f"_rival{n}"), later.alias(f"_many{n}"))


def ingest(requests: DataFrame, tables: Tables, table: str, ci: bool = False) -> Changed:
    """Append the accepted requests to ``table``; returns the new rows, with ids."""
    outcome = split(judge_ingest(requests, tables, table, ci), CODES)
    rows = append_with_ids(tables[table], outcome.accepted, TABLES[table].key, "req_id")
    return Changed(conform(rows, table), outcome.rejected)


def judge_merge(requests: DataFrame, tables: Tables, table: str, ci: bool = False) -> DataFrame:
    """``requests`` (with the row's id) with ``error_code``; unknown ids pass and do nothing.

    Requests are taken in order: a unique key is taken if another row holds it at that moment, and a row that
    gets another key leaves its old one free for later requests of the batch.
    """
    entry, spec = CHANGE[table], TABLES[table]
    (key,) = entry.unique
    joined, rules = _rules(requests, tables, entry)
    ids = tables[table].select(F.col(spec.key).alias("_row"))
    judged = judge(joined, rules).select(*requests.columns, ERROR)
    judged = judged.join(ids, F.col(spec.key) == F.col("_row"), "left")
    # A change to a row that does not exist changes nothing, so no rule can fail.
    real = F.col("_row").isNotNull()
    judged = stage(judged.withColumn(ERROR, F.when(real, F.col(ERROR))), "requests")
    keyed = [F.col(spec.key).cast("long").alias("row"), _as_text(table, key, ci).alias("value")]
    claims = judged.where(real & F.col(ERROR).isNull()).select("req_id", *keyed)
    verdicts = decide(claims, tables[table].select(*keyed)).withColumnRenamed("req_id", "_req")
    late = F.col(ERROR).isNull() & ~F.coalesce("accepted", F.lit(True))
    found = judged.join(verdicts, F.col("req_id") == F.col("_req"), "left")
    return found.withColumn(ERROR, F.when(late, "I-12").otherwise(F.col(ERROR))).select(*requests.columns, ERROR)


def merge(requests: DataFrame, tables: Tables, table: str, ci: bool = False) -> Changed:
    """The next version of ``table``; of several requests for one row the last wins."""
    entry, spec = CHANGE[table], TABLES[table]
    outcome = split(judge_merge(requests, tables, table, ci), CODES)
    last = (
        outcome.accepted.groupBy(spec.key)
        .agg(F.max(F.struct("req_id", *entry.columns)).alias("last"))
        .select(spec.key, *[f"last.{c}" for c in entry.columns])
    )
    return Changed(update_from_join(tables[table], last, [spec.key], entry.columns), outcome.rejected)
