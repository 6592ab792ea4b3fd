from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from checks import inputs
from conftest import SEED, frame
from invigil.operators import grading
from invigil.plans import searches, views
from invigil.schema import TABLES
from invigil.session import new_folder, stage
from invigil.sources import star
from invigil.sources import tables as store


def rows(df):
    return sorted(map(str, df.collect()))


def test_load_what_was_written(spark, seed, folder):
    for name in TABLES:
        seed[name].write.parquet(f"{folder}/{name}")
    loaded = store.load_tables(spark, folder)
    for name, spec in TABLES.items():
        assert loaded[name].schema == spec.struct
        assert rows(loaded[name]) == rows(seed[name])
    store.register(loaded, ["Branch"])
    assert spark.sql("select count(*) from Branch").first()[0] == 3


def test_conform_fills_types_and_the_default(spark):
    got = store.conform(spark.createDataFrame([(1, 2, "t")], "Ch_Id int, Ch_QId int, Ch_Text string"), "MCQChoice")
    assert got.dtypes == spark.createDataFrame([], TABLES["MCQChoice"].struct).dtypes
    assert got.first().Ch_Correct is False


def test_update_upsert_delete(spark, seed):
    changes = spark.createDataFrame([(1, None), (77, "x")], "Br_Id long, Br_Name string")
    updated = store.update_from_join(seed["Branch"], changes, ["Br_Id"], ["Br_Name"])
    assert sorted((r.Br_Id, r.Br_Name) for r in updated.collect()) == [(1, None), (2, "Hill"), (3, "Mill")]
    merged = store.upsert(seed["Branch"], changes, ["Br_Id"], ["Br_Name"])
    assert sorted((r.Br_Id, r.Br_Name, r.Br_Location) for r in merged.collect()) == [
        (1, None, "Pier 4"), (2, "Hill", None), (3, "Mill", None), (77, "x", None),
    ]
    left = store.delete_rows(seed["Branch"], spark.createDataFrame([(1,), (5,)], "Br_Id long"), ["Br_Id"])
    assert sorted(r.Br_Id for r in left.collect()) == [2, 3]


def test_versions_do_not_replace_each_other(spark, seed, folder):
    path = store.publish(seed["Branch"], folder, "Branch", 1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.publish(seed["Branch"], folder, "Branch", 1)
    store.publish(seed["Branch"].limit(1), folder, "Branch", 2)
    assert spark.read.parquet(path).count() == 3


def test_snapshot_replaces_the_same_day_only(spark, seed, folder):
    monday, tuesday = dt.date(2026, 3, 2), dt.date(2026, 3, 3)
    paths = store.snapshot_tables(seed, folder, monday, ["Branch"])
    assert paths["Branch"].endswith("snapshot_date=20260302")
    store.snapshot_tables(seed, folder, tuesday, ["Branch"])
    store.snapshot_tables({"Branch": seed["Branch"].limit(1)}, folder, monday, ["Branch"])
    assert store.load_snapshot(spark, folder, monday, ["Branch"])["Branch"].count() == 1
    assert store.load_snapshot(spark, folder, tuesday, ["Branch"])["Branch"].count() == 3


def test_bucketed_facts_meet_without_an_exchange(spark, folder):
    facts = spark.range(1000).selectExpr("id", "id % 50 as k")
    store.write_bucketed(facts, "fact_a", f"{folder}/a", "k", 4)
    store.write_bucketed(facts, "fact_b", f"{folder}/b", "k", 4)
    joined = spark.table("fact_a").join(spark.table("fact_b"), "k").groupBy("k").count()
    with_hint = spark.table("fact_a").hint("merge").join(spark.table("fact_b"), "k").groupBy("k").count()
    plan = with_hint._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert joined.agg(F.sum("count")).first()[0] == 1000 * 20


def test_staged_rows_are_read_back(spark):
    df = spark.range(5).withColumn("t", F.lit(None).cast("string"))
    staged = stage(df, "test")
    assert staged.dtypes == df.dtypes and staged.count() == 5
    assert stage(df.where("id < 0"), "test").isEmpty()
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_views_in_sql(spark, seed):
    views.register_views(seed)
    got = {r.Exm_Id: r.TotalDegree for r in spark.sql("select Exm_Id, TotalDegree from ExamDetails").collect()}
    assert got == {1: 70, 2: D("26.50"), 3: 20}
    assert spark.sql("select * from QuestionPool").count() == 8
    assert spark.sql("select * from ExamQuestions where EQ_ExmId = 2").count() == 3
    assert spark.sql("select St_Name from StudentResults").count() == 2
    review = spark.sql("select Ans_TextAns, Txt_BestAnswer from TextAnswersForReview").collect()
    assert [(r.Ans_TextAns, r.Txt_BestAnswer) for r in review] == [(" Until it  has DOUBLED.", "Until it has doubled.")]


def test_total_degree_without_questions(spark, seed):
    none = {**seed, "ExamQuestion": seed["ExamQuestion"].where("EQ_ExmId = 2")}
    assert {r.Exm_Id: r.TotalDegree for r in views.exam_total_degree(none).collect()} == {1: 0, 2: D("26.50"), 3: 0}


def test_searches(spark, seed):
    assert searches.search_students(seed).count() == 4
    assert [r.St_Id for r in searches.search_students(seed, name="ia", branch=1, track=1, intake=1).collect()] == [1]
    assert {r.St_Name for r in searches.search_students(seed, name="_o").collect()} == {"Rob", "Sol"}
    assert searches.search_students(seed, name="ROB").isEmpty()
    assert searches.search_students(seed, name="ROB", ci=True).count() == 1
    day = dt.date(2027, 3, 8)
    assert searches.search_exams(seed, course=1, branch=1, track=1, exam_type="Exam", from_date=day, to_date=day).count() == 1
    assert searches.search_exams(seed, from_date=dt.date(2027, 3, 9)).isEmpty()
    assert searches.search_exams(seed, course=3).isEmpty()
    assert [r.Q_Id for r in searches.search_questions(seed, course=1, question_type="TF", created_by=1).collect()] == [3]
    assert searches.search_questions(seed, question_type="tf").isEmpty()
    assert searches.search_questions(seed, question_type="tf", ci=True).count() == 2


def test_a_backslash_in_a_search_is_a_plain_character(spark, seed):
    names = {1: "a\\b", 2: "a\\", 3: "100%", 4: "ab"}
    rows = [(i, f"u{i}", n, f"m{i}", None, 1, 1, 1) for i, n in names.items()]
    tables = {**seed, "Student": frame(spark, "Student", rows)}

    def found(part, **more):
        return {r.St_Id for r in searches.search_students(tables, name=part, **more).collect()}

    assert found("\\") == {1, 2} and found("\\b") == {1} == found("A\\B", ci=True)
    assert found("a%b") == {1, 4} and found("a_b") == {1} and found("\\%") == {1, 2}


def test_absent_search_arguments_leave_no_trace_in_the_plan(spark, seed, folder):
    for name in ("Student", "Branch", "Track", "Intake"):
        seed[name].write.parquet(f"{folder}/{name}")
    tables = store.load_tables(spark, folder, ["Student", "Branch", "Track", "Intake"])
    plan = searches.search_students(tables, branch=1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(St_BrId,1)" in plan and "St_Name LIKE" not in plan and "EqualTo(St_TrkId" not in plan


def test_credentials_are_not_carried():
    assert not [c for t in TABLES.values() for c in t.names if c.endswith("_Pass")]
    assert len(SEED) == len(TABLES)


def test_grading_reads_only_the_columns_it_needs(spark, seed, folder):
    for name in ("StudentAnswer", "StudentExam", "ExamQuestion", "MCQChoice", "TFQuestion", "TextQuestion"):
        seed[name].write.parquet(f"{folder}/{name}")
    names = ["StudentAnswer", "StudentExam", "ExamQuestion", "MCQChoice", "TFQuestion", "TextQuestion"]
    results = grading.final_results(store.load_tables(spark, folder, names))
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert "Ch_Text" not in plan and "Ans_Comment" not in plan and "SE_Date" not in plan


def test_frames_have_declared_types(spark):
    assert frame(spark, "Course", SEED["Course"]).schema["Crs_MaxDeg"].dataType.simpleString() == "decimal(5,2)"


def test_exchanges_follow_the_input(spark, folder, monkeypatch):
    """More input means more partitions, not larger ones; the session's number is the least."""
    spark.range(2000).selectExpr("id r_regionkey", "'x' r_name").write.parquet(f"{folder}/region.parquet")
    number, advisory = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(number, None), spark.conf.get(advisory)
    try:
        star.stored(spark, folder)
        assert spark.conf.get(number) == spark.conf.get("spark.sql.shuffle.partitions")
        monkeypatch.setattr(star, "PARTITION_INPUT", 100)
        star.stored(spark, folder)
        assert int(spark.conf.get(number)) > 50
        assert spark.range(1000).groupBy(F.col("id") % 7).count()._jdf.queryExecution().executedPlan().toString().count(f", {spark.conf.get(number)})") == 1
        assert spark.conf.get(advisory) == f"{star.PARTITION_BYTES}b"
    finally:
        for key, value in zip((number, advisory), was):
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_scans_follow_the_input(spark, folder, monkeypatch):
    """A split takes as much at any size, so a task holds no more where it combines rows; a smaller setting stays."""
    spark.range(40_000).selectExpr("id r_regionkey", "uuid() r_name").repartition(4).write.parquet(f"{folder}/region.parquet")
    most, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    was = {c: spark.conf.get(c) for c in (most, cost, "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set(most, "128MB")
        spark.conf.set(cost, "128MB")
        few = star.stored(spark, folder).file("region").rdd.getNumPartitions()
        assert spark.conf.get(most) == f"{star.PARTITION_BYTES}b"
        monkeypatch.setattr(star, "PARTITION_BYTES", 100_000)
        assert star.stored(spark, folder).file("region").rdd.getNumPartitions() > 2 * few
        spark.conf.set(most, "50000")
        star.stored(spark, folder)
        assert spark.conf.get(most) == "50000"
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def test_answers_keep_no_more_than_is_read(spark, folder):
    """The columns that only order submissions are not written with the last one."""
    for name, schema in star.FILES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert not {"l_shipdate", "l_partkey", "l_extendedprice"} & set(star.Star(spark, folder).latest.columns)


def test_submissions_come_in_in_few_files(spark, folder):
    """Many tasks make many files; what comes in is the same rows in a few."""
    t = star.Star(spark, folder, f"{folder}/kept")
    t.keep("answer_request", lambda: spark.range(1000).repartition(40))
    spark.range(1).selectExpr("id l_orderkey").write.parquet(f"{folder}/lineitem.parquet")
    read = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "128MB")
        path = inputs.incoming(t)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", read)
    assert len(star.files(spark, path)) == inputs.LEAST_INCOMING
    assert rows(spark.read.parquet(path)) == rows(spark.range(1000))
