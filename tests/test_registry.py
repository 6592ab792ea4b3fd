"""Registered queries against their SQL on the smallest given data, and the shape of plans.

All queries run with ``INVIGIL_ALL=1``; otherwise one of each family.
"""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from checks import catalog
from checks import inputs as req
from checks.compare import compare, database
from checks.skew import skewed_copy
from invigil.operators import answers, audits, constraints, exams, grading
from invigil.operators.sampling import sample_n_per_group
from invigil.plans import views
from invigil.sources.star import Star, stored

DIR = "/root/testdata/sf0.001"
SOME = [
    "s4_append_with_ids", "s8_upsert", "s10_snapshot", "r21_sample_n_per_group", "i5_exam_max_degree", "i10_answer_fits",
    "i11_check", "i15_value", "f2_normalize_answer", "p1_create_question_keys", "p2_random_exam_questions",
    "p3_manual_exam_rejected", "p4_assign_student", "p6_final_results", "p7_mark_answer_results", "p13_add_student",
    "p14_update_student", "p16_search_exams", "v2_exam_details", "st1_stream_answers", "p5_two_batches", "p6_grade_requests_answers",
    "p6_overflowing_seats", "p7_mark_answer", "p11_stale_exams", "p14_stale_seats", "p15_search_students_backslash",
    "p2_random_exam_defaults_rejected", "r22_exam_papers_in_order", "r37_column_default", "i5_batch_verdict", "i12_unique",
    "v4_text_answers_for_review",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no given data here")


@pytest.fixture(scope="module")
def con():
    return database(DIR)


@pytest.mark.parametrize("key", list(catalog.QUERIES) if os.environ.get("INVIGIL_ALL") else SOME)
def test_query_agrees_with_sql(spark, con, key):
    assert compare(spark, con, key, registered.queries()[key], registered.oracle_sql().get(key), DIR)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    return skewed_copy(DIR, str(tmp_path_factory.mktemp("skewed")))


@pytest.mark.parametrize(
    "key",
    ["p2_random_exam_questions", "p3_manual_exam_questions", "p4_assign_student", "p5_save_answer", "p6_final_results", "i12_unique"],
)
def test_query_agrees_with_sql_when_one_key_holds_a_third_of_the_rows(spark, skewed, key):
    assert compare(spark, database(skewed), key, registered.queries()[key], registered.oracle_sql()[key], skewed)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["SE_Id", "FinalResult"] and df.count() == 1500


PLANS = {
    "grade answers": lambda t: grading.grade_answers(t),
    "final results": lambda t: grading.final_results(t),
    "marks": lambda t: grading.judge_marks(req.marks(t), t),
    "answers": lambda t: answers.judge_answers(req.answer_requests(t), t),
    "random exams": lambda t: exams.judge_random_exams(req.random_exam_requests(t), t),
    "manual exams": lambda t: exams.judge_manual_exams(req.manual_exam_requests(t), req.manual_exam_lists(t), t),
    "questions": lambda t: exams.judge_questions(req.question_requests(t), t),
    "rules": lambda t: audits.run_audits(t),
    "checks": lambda t: constraints.check_violations(t),
    "unique": lambda t: constraints.unique_violations(t),
    "references": lambda t: constraints.reference_violations(t),
    "values": lambda t: constraints.value_violations(t),
    **{name: view for name, view in views.VIEWS.items()},
}


@pytest.mark.parametrize("name", PLANS)
def test_plans_stay_in_the_engine_and_apart(spark, name):
    """No product of two tables, no Python per row, no window over everything."""
    plan = PLANS[name](Star(spark, DIR))._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan
    assert not re.search(r"Window \[[^\]]*\], \[[^\]]*\]\n\s*\+- Sort[^\n]*\n\s*\+- Exchange SinglePartition", plan)


def test_latest_answer_is_combined_before_the_exchange(spark):
    requests = req.answer_requests(Star(spark, DIR))
    plan = answers.latest_answers(requests)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(struct(submitted_at" in plan


def test_sampling_keeps_n_rows_per_task(spark):
    sample = sample_n_per_group(Star(spark, DIR)["Question"], ["Q_CrsId", "Q_Type"], "Q_Id", 3, 1)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange(.|\n)*WindowGroupLimit[^\n]*Partial", plan)


def test_seats_meet_their_answers_without_an_exchange(spark):
    """Also when nothing is small enough to broadcast."""
    tables = stored(spark, DIR)
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    try:
        for key in limits:
            spark.conf.set(key, "-1")
        seats = tables["StudentExam"].join(tables["StudentAnswer"], F.col("SE_Id") == F.col("Ans_SEId"), "left")
        plan = seats.groupBy("SE_Id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_small_batch_leaves_the_answers_where_they_are(spark):
    """Also when nothing is small enough to broadcast: only the batch is exchanged."""
    tables = stored(spark, DIR)
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    few = req.answer_requests(tables).where("Ans_SEId % 50 = 0")
    try:
        for key in limits:
            spark.conf.set(key, "-1")
        latest = answers.latest_answers(few)
        plan = answers.store_answers(latest, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in limits:
            spark.conf.unset(key)
    lines = plan.splitlines()
    for n, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "Bucketed: true" not in next(below for below in lines[n:] if "FileScan" in below)


def test_hot_seat_question_and_choice_are_split(spark, skewed):
    """Submissions that crowd on one seat, with thresholds scaled down to the test's size."""
    t = stored(spark, skewed)
    requests, tables = req.answer_requests(t), req.some_answers(t)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5KB",
    }
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        judged = answers.judge_answers(requests, tables)
        judged.collect()
        plan = judged._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    final = plan.split("== Initial Plan ==")[0]
    for key in ("[Ans_SEId#", "[SE_ExmId#", "[Ans_QId#", "[coalesce(Ans_ChoiceId#"):
        assert f"SortMergeJoin(skew=true) {key}" in final
