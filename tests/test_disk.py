"""What saving answers writes and moves: every step once, and nothing left behind."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from checks import inputs as req
from conftest import codes, moment
from invigil import session
from invigil.functions.rules import ERROR
from invigil.operators import answers
from invigil.sources import star
from invigil.streaming import answers as stream
from test_answers import REQUESTS, batch, content, graded


@pytest.fixture()
def written(monkeypatch):
    """The purposes of the scratch folders that are asked for."""
    purposes = []
    folder = session.new_folder
    monkeypatch.setattr(session, "new_folder", lambda spark, purpose: purposes.append(purpose) or folder(spark, purpose))
    return purposes


def test_submissions_are_derived_once(spark, folder, monkeypatch):
    """both the batch and the answers come of one reading of the line items."""
    for name, schema in star.FILES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    derived = {}
    keep = star.Star.keep

    def watched(self, name, derive, *more, **options):
        return keep(self, name, lambda: derived.setdefault(name, derive()), *more, **options)

    monkeypatch.setattr(star.Star, "keep", watched)
    t = star.Star(spark, folder, f"{folder}/kept")
    req.some_answers(t)
    req.answer_requests(t)
    assert {"latest", "answer_request"} <= set(derived)
    assert [n for n, df in derived.items() if "l_orderkey" in scanned(df)] == ["submitted"]


def scanned(df):
    """The columns of the files that are read as they are given or kept."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return {a.name() for i in range(leaves.size()) for a in [leaves.apply(i).output().apply(j) for j in range(leaves.apply(i).output().size())]}


def test_a_batch_is_exchanged_three_times(spark, seed, folder):
    """by seat, by choice and by question; there it meets type and paper, and the last one of each question is found."""
    for name in ("StudentExam", "ExamQuestion", "Question", "MCQChoice"):
        seed[name].write.parquet(f"{folder}/{name}")
    batch(spark).write.parquet(f"{folder}/in")
    tables = {n: spark.read.parquet(f"{folder}/{n}") for n in ("StudentExam", "ExamQuestion", "Question", "MCQChoice")}
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    try:
        for key in limits:
            spark.conf.set(key, "-1")
        judged = answers.judge_answers(spark.read.parquet(f"{folder}/in"), tables)
        plan = answers.latest_answers(judged.where(F.col(ERROR).isNull()))._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert plan.count("SortMergeJoin") == 4 and plan.count("Exchange hashpartitioning") == 3 + 4
    assert plan.index("partial_max") < plan.index("SortMergeJoin") < plan.index("Exchange")


def test_a_batch_is_written_once(spark, seed, written):
    """accepted and refused submissions come of one file, and new answers of no other."""
    saved = answers.save_answers(batch(spark), graded(spark, seed))
    assert saved.answers.count() == 6 and codes(saved.rejected) == {r[0]: r[7] for r in REQUESTS if r[7]}
    assert written == ["verdicts"]


def test_refused_submissions_are_as_many_as_came(spark, seed):
    """verdicts are combined; a request that came three times is refused three times."""
    rows = [("a", moment(13, 30), 9999, 2, 2, None, None)] * 3 + [("a", moment(13, 30), 2, 777, None, None, "t"), ("b", moment(13, 30), None, None, None, None, None)]
    rejected = answers.save_answers(batch(spark, rows), seed).rejected
    assert sorted((r.req_id, r.error_code) for r in rejected.collect()) == [("a", "50500")] * 3 + [("a", "I-14"), ("b", "50500")]


def test_stamps_are_kept_only_where_they_are_asked_for(spark, seed, written):
    """a first batch without stamps carries none, a second one on stamped answers compares them."""
    plain, _ = answers.settle_answers(answers.judge_answers(batch(spark), seed), stamped=False)
    assert not set(answers.STAMP) & set(plain.columns)
    late = [r for r in REQUESTS if r[1] and r[1].minute >= 30]
    early = [r for r in REQUESTS if r not in late]
    tables = graded(spark, seed)
    first = answers.save_answers(batch(spark, late), tables, stamped=True).answers
    both = answers.save_answers(batch(spark, early), {**tables, "StudentAnswer": first}).answers
    assert content(both) == content(answers.save_answers(batch(spark), tables).answers)
    assert written == ["verdicts"] * 4


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return set(re.findall(r"shuffle_\d+_\S+\.data", found))


def test_a_write_leaves_no_shuffle_files(spark, folder):
    """what a write has shuffled is gone when it is done; the setting is as before."""
    before, setting = shuffle_files(spark), spark.conf.get(session._CLEANUP)
    df = spark.range(10_000).selectExpr("id", "id % 7 k")
    assert session.stage_dense(df.repartition(5, "k"), "rows").groupBy("k").count().count() == 7
    counted = shuffle_files(spark) - before
    with session.writing(df.repartition(5, "k")) as writer:
        writer.parquet(folder)
    assert shuffle_files(spark) - before <= counted and spark.conf.get(session._CLEANUP) == setting
    assert spark.read.parquet(folder).count() == 10_000


def test_the_log_is_merged_by_one_write_of_its_latest(spark, seed, folder, written):
    """the latest submissions and the changed buckets are written once each."""
    tables = graded(spark, seed)
    store = answers.create_store(answers.answer_store(spark, f"{folder}/answers", 8), tables["StudentAnswer"])
    batch(spark).coalesce(1).write.parquet(f"{folder}/in")
    stream.stream_answers(stream.read_submissions(spark, f"{folder}/in"), tables, f"{folder}/log", f"{folder}/checkpoint")
    stream.merge_log(f"{folder}/log", store, f"{folder}/merged")
    assert written == ["latest", "buckets"]
    assert content(store.rows()) == content(answers.save_answers(batch(spark), tables).answers)
