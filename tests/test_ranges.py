"""Exams laid out by day: a search of a day reads that day."""

from __future__ import annotations

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SEED, frame
from invigil.functions.filters import within_days
from invigil.plans import searches, views
from invigil.sources.ranges import EXAM_DAY, lay_out_exams, write_ranged

DAYS = 40


@pytest.fixture(scope="module")
def many(spark, seed, tmp_path_factory):
    """Exams on forty days, ten a day, in no order, three questions each."""
    rows = [
        (i, 1, "Exam", 1, 1, 1, dt.datetime(2027, 3, 1, 9) + dt.timedelta(days=i * 7 % DAYS, minutes=i % 50), dt.datetime(2027, 9, 1), 90, None)
        for i in range(1, 401)
    ]
    tables = {**seed, "Exam": frame(spark, "Exam", rows).repartition(4)}
    questions = [(3 * i + q, i, q, q) for i in range(1, 402) for q in (1, 2, 3)]
    tables["ExamQuestion"] = frame(spark, "ExamQuestion", questions).repartition(4)
    root = str(tmp_path_factory.mktemp("exams")) + "/laid-out"
    return tables, lay_out_exams(tables, root, rows_per_file=20), root


def rows_scanned(df):
    """The rows that came out of the scan, after files and row groups were skipped and before any filter."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_a_day_is_read_from_few_files(many):
    tables, laid_out, root = many
    assert len(glob.glob(f"{root}/Exam/*.parquet")) >= 15 and len(glob.glob(f"{root}/ExamQuestion/*.parquet")) >= 40
    day = dt.date(2027, 3, 11)
    for name, n, whole in (("Exam", 10, 400), ("ExamQuestion", 30, 1203)):
        found = within_days(laid_out[name], "", day, day, EXAM_DAY[name])
        assert "PushedFilters: [IsNotNull(" in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == n
        assert n <= rows_scanned(found) <= 6 * n < whole


def test_searches_and_details_of_a_day_are_the_same(many):
    tables, laid_out, _ = many
    day = dt.date(2027, 3, 11)
    plain, fast = (searches.search_exams(t, from_date=day, to_date=day) for t in (tables, laid_out))
    assert sorted(plain.collect()) == sorted(fast.collect()) and plain.count() == 10
    whole = views.exam_details(tables).where(F.col("Exm_Start").cast("date") == F.lit(day))
    details = views.exam_details(laid_out, day, day)
    assert sorted(whole.collect(), key=str) == sorted(details.collect(), key=str)
    assert {r.TotalDegree for r in details.collect()} == {6}


def test_days_are_inclusive_at_both_ends(spark):
    times = [dt.datetime(2027, 3, 10, 23, 59, 59, 999999), dt.datetime(2027, 3, 11), dt.datetime(2027, 3, 11, 23, 59, 59, 999999), dt.datetime(2027, 3, 12), None]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    day = dt.date(2027, 3, 11)
    assert [r.t for r in within_days(df, "t", day, day).collect()] == times[1:3]
    assert within_days(df, "t", None, day).count() == 3 and within_days(df, "t", day, None).count() == 3
    assert within_days(df, "t", None, None).count() == 5
    assert within_days(df, "t", day, dt.date.max).count() == 3


def test_questions_without_an_exam_are_kept(many):
    tables, laid_out, _ = many
    assert laid_out["ExamQuestion"].count() == 1203
    assert laid_out["ExamQuestion"].where(F.col(EXAM_DAY["ExamQuestion"]).isNull()).count() == 3
    assert len(SEED["Exam"]) == 3


def test_small_files_are_no_ranges_of_their_own(spark, folder):
    """Spark samples each range at the driver: 500 files come from one range, in order and each a stretch of the keys."""
    df = spark.range(0, 10_000, numPartitions=3).selectExpr("pmod(id * 7919, 10000) as k")
    ran = spark._jsc.sc().statusTracker()
    spark.sparkContext.setJobGroup("ranged", "ranged")
    assert write_ranged(df, folder, "k", rows_per_file=20).count() == 10_000
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [ran.getStageInfo(s).get().numTasks() for j in ran.getJobIdsForGroup("ranged") for s in ran.getJobInfo(j).get().stageIds()]
    files = glob.glob(f"{folder}/*.parquet")
    assert len(files) == 500 and max(tasks) < 50
    bounds = sorted((min(k), max(k), len(k)) for k in (pq.read_table(f)["k"].to_pylist() for f in files))
    assert bounds == [(i, i + 19, 20) for i in range(0, 10_000, 20)]
