"""Every registered query with the SQL it must agree with.

Dates and timestamps leave as text, so both engines hand over the same values.
"""

from __future__ import annotations

import datetime as dt
import functools
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as req
from checks.oracle_inputs import NORM, SUBQUERY, reference_sql, rejected, texts, unique_sql, value_sql
from checks.oracle_tables import with_tables
from invigil.functions.clock import micros_of_day
from invigil.functions.numbering import append_with_ids
from invigil.functions.rules import ERROR, first_failing_rule, with_messages
from invigil.functions.text import is_answer_valid, normalize_answer
from invigil.messages import message
from invigil.operators import answers, audits, constraints, dimensions, exams, grading, stale
from invigil.operators.sampling import sample_n_per_group
from invigil.plans import searches, views
from invigil.schema import TABLES
from invigil.session import new_folder, stage, stage_dense, tune
from invigil.sources import ranges
from invigil.sources import tables as store
from invigil.sources.buckets import Store
from invigil.sources.star import Star, every, stored
from invigil.streaming import answers as stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BODY: dict[str, str] = {}

DAY = dt.date(2024, 1, 31)
SMALL, LARGE = string.ascii_lowercase, string.ascii_uppercase


def portable(df: DataFrame) -> DataFrame:
    kinds = {"date", "timestamp_ntz"}
    return df.select(
        *[F.col(f.name).cast("string") if f.dataType.simpleString() in kinds else F.col(f.name) for f in df.schema]
    )


def query(name: str, sql: str | None = None):
    def add(function: Callable[[Star], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(function(stored(tune(spark), sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            BODY[name] = sql
            SQL[name] = with_tables(sql)
        return function

    return add


def _manual(t):
    return exams.create_manual_exams(req.manual_exam_requests(t), req.manual_exam_lists(t), t)


def _all_exams(t) -> store.Tables:
    """All exams: the derived ones and those the manual requests add, which grow with the orders."""
    new = functools.cache(lambda: _manual(t))
    more = t.keep("manual_exam", lambda: store.conform(new().exams, "Exam"))
    questions = t.keep("manual_exam_question", lambda: new().questions)
    return store.replace(
        t, Exam=t["Exam"].unionByName(more), ExamQuestion=t["ExamQuestion"].unionByName(questions)
    )


def _graded(t) -> store.Tables:
    """The tables after all seats have been graded."""
    graded = t.keep("graded_answer", lambda: grading.grade_answers(t), "Ans_SEId")
    seats = t.keep("graded_seat", lambda: grading.store_results(t["StudentExam"], grading.final_results(t, graded)))
    return store.replace(t, StudentAnswer=graded, StudentExam=seats)


# -- sources and sinks -------------------------------------------------------------------


def _profile(tables: store.Tables) -> DataFrame:
    parts = None
    for name, spec in TABLES.items():
        part = tables[name].agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.sum(spec.key).cast("long").alias("key_sum")
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _profile_sql(extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS table_name{extra}, count(*) AS n_rows, CAST(sum({TABLES[n].key}) AS BIGINT) AS key_sum FROM {SUBQUERY[n]}"
        for n in TABLES
    )


@query("s1_load_tables", _profile_sql())
def _(t):
    """Write the seventeen tables once, read them back through their declared schemas."""
    root = new_folder(t.spark, "tables")
    for name in TABLES:
        t[name].write.parquet(f"{root}/{name}")
    return _profile(store.load_tables(t.spark, root))


@query(
    "s4_append_with_ids",
    "SELECT (SELECT max(St_Id) FROM t_student) + row_number() OVER (ORDER BY o_orderkey) AS St_Id, o_orderkey FROM orders",
)
def _(t):
    """New ids for every order, after the last student id in use."""
    return append_with_ids(t["Student"], t.file("orders").select("o_orderkey"), "St_Id", "o_orderkey")


@query("s6_update_from_join", "SELECT SE_Id, SE_ExmId, SE_StId, FinalResult AS SE_Result FROM t_seat JOIN results USING (SE_Id)")
def _(t):
    stored_results = grading.store_results(t["StudentExam"], grading.final_results(t))
    return stored_results.select("SE_Id", "SE_ExmId", "SE_StId", "SE_Result")


@query(
    "s7_update_by_key",
    """
SELECT St_Id, CASE WHEN c_acctbal < 0 THEN 'Renamed ' || St_Id ELSE St_Name END AS St_Name,
       CASE WHEN c_acctbal >= 0 THEN St_Phone END AS St_Phone FROM t_student JOIN customer ON c_custkey = St_Id""",
)
def _(t):
    """Rename students in debt and take their phone away; changes to unknown students do nothing."""
    c = F.col("c_custkey")
    changes = t.file("customer").where(F.col("c_acctbal") < 0).select(
        c.alias("St_Id"), F.concat(F.lit("Renamed "), c).alias("St_Name"), F.lit(None).alias("St_Phone")
    )
    nobody = changes.withColumn("St_Id", -F.col("St_Id") - 1)
    both = changes.unionByName(nobody)
    return store.update_from_join(t["Student"], both, ["St_Id"], ["St_Name", "St_Phone"]).select(
        "St_Id", "St_Name", "St_Phone"
    )


@query(
    "s8_upsert",
    """
SELECT coalesce(b.Ans_SEId, l.Ans_SEId) AS Ans_SEId, coalesce(b.Ans_QId, l.Ans_QId) AS Ans_QId,
       CASE WHEN l.age = 1 THEN l.Ans_ChoiceId ELSE b.Ans_ChoiceId END AS Ans_ChoiceId,
       CASE WHEN l.age = 1 THEN l.Ans_BoolAns ELSE b.Ans_BoolAns END AS Ans_BoolAns,
       CASE WHEN l.age = 1 THEN l.Ans_TextAns ELSE b.Ans_TextAns END AS Ans_TextAns, b.Ans_Degree
FROM base5 b FULL JOIN last5 l ON l.Ans_SEId = b.Ans_SEId AND l.Ans_QId = b.Ans_QId""",
)
def _(t):
    tables = req.some_answers(t)
    judged = answers.judge_answers(req.answer_requests(t), tables)
    latest = stage_dense(answers.latest_answers(judged.where(F.col(ERROR).isNull())), "latest")
    merged = store.upsert(tables["StudentAnswer"], latest, answers.KEYS, answers.GIVEN)
    return merged.select(*answers.KEYS, *answers.GIVEN, "Ans_Degree")


@query(
    "s9_delete_rows",
    "SELECT Ans_Id, Ans_SEId, Ans_QId FROM t_answer a WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = Ans_SEId AND o_orderstatus = 'F')",
)
def _(t):
    finished = t.file("orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("Ans_SEId"))
    return store.delete_rows(t["StudentAnswer"], finished, ["Ans_SEId"]).select("Ans_Id", "Ans_SEId", "Ans_QId")


def _answer_store(t, given: DataFrame) -> Store:
    return answers.create_store(answers.answer_store(t.spark, new_folder(t.spark, "answers"), t.n_buckets), given)


@query(
    "s6_results_in_place",
    "SELECT SE_Id, SE_ExmId, SE_StId, CASE WHEN SE_Id % 7 = 0 THEN FinalResult END AS SE_Result FROM t_seat JOIN results USING (SE_Id)",
)
def _(t):
    """The results of some seats, stored without touching other buckets."""
    seats = Store(t.spark, new_folder(t.spark, "seats"), "StudentExam", "SE_Id", 4 * t.n_buckets)
    seats.create(t["StudentExam"].withColumn("SE_Result", F.lit(None)))
    results = grading.final_results(t).where(F.col("SE_Id") % 7 == 0)
    seats.update(results.select("SE_Id", F.col("FinalResult").alias("SE_Result")), ["SE_Id"], ["SE_Result"])
    return seats.rows().select("SE_Id", "SE_ExmId", "SE_StId", "SE_Result")


@query(
    "s8_upsert_in_place",
    """
SELECT Ans_SEId, Ans_QId, Ans_Correct, CASE WHEN l.age = 1 THEN l.Ans_ChoiceId ELSE b.Ans_ChoiceId END AS Ans_ChoiceId,
       CASE WHEN l.age = 1 THEN l.Ans_TextAns ELSE b.Ans_TextAns END AS Ans_TextAns
FROM base5 b FULL JOIN (SELECT * FROM last5 WHERE Ans_SEId % 11 = 0) l USING (Ans_SEId, Ans_QId)""",
)
def _(t):
    """The submissions of some seats, merged into the buckets of these seats."""
    tables = req.some_answers(t)
    stored_answers = _answer_store(t, tables["StudentAnswer"])
    answers.save_into(stored_answers, req.answer_requests(t).where(F.col("Ans_SEId") % 11 == 0), tables)
    return stored_answers.rows().select("Ans_SEId", "Ans_QId", "Ans_Correct", "Ans_ChoiceId", "Ans_TextAns")


@query(
    "s9_delete_in_place",
    "SELECT Ans_Id, Ans_SEId, Ans_QId FROM t_answer a WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = Ans_SEId AND o_orderstatus = 'P')",
)
def _(t):
    stored_answers = _answer_store(t, t["StudentAnswer"])
    stored_answers.delete(t.file("orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("Ans_SEId")), ["Ans_SEId"])
    return stored_answers.rows().select("Ans_Id", "Ans_SEId", "Ans_QId")


@query("s10_snapshot", _profile_sql(", '20240131' AS snapshot_date"))
def _(t):
    root = new_folder(t.spark, "snapshots")
    store.snapshot_tables(t, root, DAY)
    copies = store.load_snapshot(t.spark, root, DAY)
    return _profile(copies).withColumn("snapshot_date", F.lit(DAY.strftime("%Y%m%d")))


# -- primitives --------------------------------------------------------------------------


@query(
    "r21_sample_n_per_group",
    """
SELECT Q_CrsId, Q_Type, Q_Id FROM (
  SELECT *, row_number() OVER (PARTITION BY Q_CrsId, Q_Type ORDER BY md5('11-' || Q_Id), Q_Id) AS place FROM t_question)
WHERE place <= 3""",
)
def _(t):
    return sample_n_per_group(t["Question"], ["Q_CrsId", "Q_Type"], "Q_Id", 3, 11).select("Q_CrsId", "Q_Type", "Q_Id")


@query(
    "r26_micros_of_day",
    "SELECT event_id, epoch_us(ts) % 86400000000 AS micros, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
)
def _(t):
    events = t.spark.read.schema("event_id BIGINT, ts TIMESTAMP_NTZ").parquet(f"{t.sf_dir}/events.parquet")
    return events.select("event_id", micros_of_day(F.col("ts")).alias("micros"), F.to_date("ts").alias("day"))


@query(
    "r36_first_failing_rule",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 45 THEN 'quantity'
  WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax > l_discount THEN 'tax' END AS rule FROM lineitem""",
)
def _(t):
    rules = [
        ("quantity", F.col("l_quantity") > 45),
        ("discount", F.col("l_discount") > 0.08),
        ("tax", F.col("l_tax") > F.col("l_discount")),
    ]
    return t.file("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", first_failing_rule(rules).alias("rule")
    )


@query("r37_column_default", "SELECT Ch_Id, Ch_QId, Ch_Text, false AS Ch_Correct FROM t_choice")
def _(t):
    """Choices that come in without the flag."""
    return store.conform(t["MCQChoice"].drop("Ch_Correct"), "MCQChoice")


@query("r22_exam_papers_in_order", "SELECT EQ_ExmId, EQ_QId, Q_Type, EQ_Degree FROM t_slot ORDER BY EQ_ExmId, EQ_QId")
def _(t):
    """The papers as they are printed: by exam, then question."""
    return views.exam_questions(t).select("EQ_ExmId", "EQ_QId", "Q_Type", "EQ_Degree").orderBy("EQ_ExmId", "EQ_QId")


# -- integrity rules ---------------------------------------------------------------------


def _violations(rule: str, rows: str) -> str:
    return f"SELECT '{rule}' AS rule, key, '{message(rule)}' AS message FROM ({rows})"


@query("i1_student_track_branch", _violations("I-1", "SELECT St_Id AS key FROM t_student JOIN t_track ON Trk_Id = St_TrkId WHERE Trk_BrId <> St_BrId"))
def _(t):
    return audits.AUDITS["I-1"](t, None)


@query("i2_exam_track_branch", _violations("I-2", "SELECT Exm_Id AS key FROM exam_bad JOIN t_track ON Trk_Id = Exm_TrkId WHERE Trk_BrId <> Exm_BrId"))
def _(t):
    return audits.AUDITS["I-2"](req.bad_exams(_all_exams(t)), None)


@query(
    "i3_seat_student",
    _violations(
        "I-3",
        "SELECT SE_Id AS key FROM t_seat JOIN t_exam ON Exm_Id = SE_ExmId JOIN t_student ON St_Id = SE_StId "
        "WHERE St_IntId <> Exm_IntId OR St_BrId <> Exm_BrId OR St_TrkId <> Exm_TrkId",
    ),
)
def _(t):
    return audits.AUDITS["I-3"](t, None)


@query(
    "i4_exam_question_course",
    _violations(
        "I-4",
        "SELECT EQ_Id AS key FROM eq_bad JOIN all_exam ON Exm_Id = EQ_ExmId JOIN t_assignment ON Asg_Id = Exm_AsgId "
        "JOIN t_question ON Q_Id = EQ_QId WHERE Q_CrsId <> Asg_CrsId",
    ),
)
def _(t):
    return audits.AUDITS["I-4"](req.bad_exam_questions(_all_exams(t), t.file("part")), None)


@query(
    "i5_exam_max_degree",
    _violations(
        "I-5",
        "SELECT Exm_Id AS key FROM all_exam JOIN t_assignment ON Asg_Id = Exm_AsgId JOIN t_course c ON c.Crs_Id = Asg_CrsId "
        "WHERE (SELECT coalesce(sum(EQ_Degree), 0) FROM all_eq WHERE EQ_ExmId = Exm_Id) > Crs_MaxDeg",
    ),
)
def _(t):
    return audits.AUDITS["I-5"](_all_exams(t), None)


@query(
    "i6_question_author",
    _violations(
        "I-6",
        "SELECT Q_Id AS key FROM t_question LEFT JOIN t_assignment ON Asg_CrsId = Q_CrsId AND Asg_InsId = Q_CreatedBy WHERE Asg_Id IS NULL",
    ),
)
def _(t):
    return audits.AUDITS["I-6"](t, None)


@query(
    "i5_touched_exams",
    _violations(
        "I-5",
        """
SELECT Exm_Id AS key FROM t_exam JOIN t_assignment ON Asg_Id = Exm_AsgId JOIN t_course c ON c.Crs_Id = Asg_CrsId
WHERE Exm_Id IN (SELECT EQ_ExmId FROM t_slot WHERE Q_Type <> 'MCQ')
  AND (SELECT sum(CASE WHEN Q_Type = 'TF' THEN EQ_Degree * 3 ELSE EQ_Degree END) FROM t_slot WHERE EQ_ExmId = Exm_Id AND Q_Type <> 'Text') > Crs_MaxDeg""",
    ),
)
def _(t):
    """True/false questions come back at three times the degree and text questions go: which of
    the exams touched either way are over the limit now?"""
    old = t.slots
    kind = F.col("Q_Type")
    raised = old.where(kind == "TF").withColumn("EQ_Degree", F.col("EQ_Degree") * 3)
    after = old.where(kind == "MCQ").unionByName(raised.withColumn("EQ_Degree", F.col("EQ_Degree").cast("decimal(5,2)")))
    touched = audits.touched_exams(raised, old.where(kind == "Text"))
    return audits.AUDITS["I-5"](store.replace(t, ExamQuestion=after), touched)


@query("i2_exam_admits_nobody", "SELECT Exm_Id FROM all_exam WHERE epoch_us(Exm_Start) % 86400000000 >= epoch_us(Exm_End) % 86400000000")
def _(t):
    return audits.exams_without_window(_all_exams(t))


@query("i7_tf_type", _violations("I-7", "SELECT Q_Id AS key FROM t_question WHERE Q_Type = 'MCQ' AND Q_Id % 13 = 0"))
def _(t):
    return audits.AUDITS["I-7"](req.bad_tf(t), None)


@query("i8_text_type", _violations("I-8", "SELECT Q_Id AS key FROM t_question WHERE Q_Type = 'TF' AND Q_Id % 13 = 1"))
def _(t):
    return audits.AUDITS["I-8"](req.bad_text(t), None)


@query("i9_choice_type", _violations("I-9", "SELECT Ch_Id AS key FROM choice_bad JOIN t_question ON Q_Id = Ch_QId WHERE Q_Type <> 'MCQ'"))
def _(t):
    return audits.AUDITS["I-9"](req.bad_choices(t), None)


_I10 = f"""
SELECT error_code AS rule, key, {texts("I-10a I-10b I-10c").replace("error_message", "message")} FROM (
  SELECT a.Ans_Id AS key, CASE WHEN EQ_Id IS NULL THEN 'I-10a'
      WHEN q.Q_Type = 'MCQ' AND Ans_ChoiceId IS NOT NULL AND Ch_Id IS NULL THEN 'I-10b'
      WHEN q.Q_Type <> 'MCQ' AND Ans_ChoiceId IS NOT NULL OR q.Q_Type <> 'TF' AND Ans_BoolAns IS NOT NULL
        OR q.Q_Type <> 'Text' AND Ans_TextAns IS NOT NULL THEN 'I-10c' END AS error_code
  FROM answer_bad a JOIN t_seat ON SE_Id = Ans_SEId LEFT JOIN t_question q ON Q_Id = Ans_QId
  LEFT JOIN t_examquestion ON EQ_ExmId = SE_ExmId AND EQ_QId = Ans_QId
  LEFT JOIN t_choice ON Ch_Id = Ans_ChoiceId AND Ch_QId = Ans_QId) WHERE error_code IS NOT NULL"""


@query("i10_answer_fits", _I10)
def _(t):
    return audits.AUDITS["I-10"](req.bad_answers(t), None)


@query(
    "i10_batch_verdict",
    f"SELECT rule, message, count(*) AS n_rows, min(key) AS first_key FROM ({_I10}) GROUP BY rule, message",
)
def _(t):
    """All answers come in as one batch: is it refused, and why?"""
    tables = req.bad_answers(t)
    return audits.batch_verdict(audits.AUDITS["I-10"](tables, tables["StudentAnswer"]))


@query(
    "i11_check",
    """
SELECT 'Course' AS table_name, Crs_Id AS key, 'Crs_Degrees' AS check_name FROM t_course WHERE Crs_Id % 7 = 0
UNION ALL SELECT 'Question', Q_Id, 'Q_Type' FROM t_question WHERE Q_Id % 71 = 0
UNION ALL SELECT 'Exam', Exm_Id, 'Exm_Type' FROM t_exam WHERE Exm_Type NOT IN ('Exam', 'Corrective')
UNION ALL SELECT 'Exam', Exm_Id, 'Exm_Times' FROM t_exam WHERE Exm_End <= Exm_Start
UNION ALL SELECT 'Exam', Exm_Id, 'Exm_TotalTime' FROM t_exam WHERE Exm_TotalTime <= 0
UNION ALL SELECT 'ExamQuestion', EQ_Id, 'EQ_Degree' FROM t_examquestion WHERE EQ_Id % 73 = 0
UNION ALL SELECT 'StudentExam', SE_Id, 'SE_Times' FROM t_seat WHERE SE_End <= SE_Start
UNION ALL SELECT 'StudentExam', SE_Id, 'SE_Result' FROM t_seat WHERE SE_Id % 79 = 0
UNION ALL SELECT 'StudentAnswer', Ans_Id, 'Ans_Degree' FROM t_answer WHERE Ans_Id % 83 = 0""",
)
def _(t):
    return constraints.check_violations(req.broken_checks(t))


@query("i12_unique", unique_sql())
def _(t):
    return constraints.unique_violations(req.broken_keys(t))


@query(
    "i1_to_i10_summary",
    f"""
SELECT rule, message, count(*) AS n_rows, min(key) AS first_key FROM (
  {_violations("I-1", "SELECT St_Id AS key FROM t_student JOIN t_track ON Trk_Id = St_TrkId WHERE Trk_BrId <> St_BrId")}
  UNION ALL {_violations("I-3", "SELECT SE_Id AS key FROM t_seat JOIN t_exam ON Exm_Id = SE_ExmId JOIN t_student ON St_Id = SE_StId WHERE (St_IntId, St_BrId, St_TrkId) <> (Exm_IntId, Exm_BrId, Exm_TrkId)")}
  UNION ALL {_violations("I-5", "SELECT Exm_Id AS key FROM t_exam JOIN t_assignment ON Asg_Id = Exm_AsgId JOIN t_course c ON c.Crs_Id = Asg_CrsId WHERE (SELECT sum(EQ_Degree) FROM t_examquestion WHERE EQ_ExmId = Exm_Id) > Crs_MaxDeg")}
  UNION ALL {_violations("I-6", "SELECT Q_Id AS key FROM t_question WHERE (Q_CrsId, Q_CreatedBy) NOT IN (SELECT Asg_CrsId, Asg_InsId FROM t_assignment)")}
  UNION ALL {_violations("I-10b", "SELECT Ans_Id AS key FROM t_answer LEFT JOIN t_choice ON Ch_Id = Ans_ChoiceId WHERE Ans_ChoiceId IS NOT NULL AND Ch_QId IS DISTINCT FROM Ans_QId")}
) GROUP BY rule, message""",
)
def _(t):
    """All cross-table rules over the tables as they are; the rules not listed find nothing."""
    return audits.batch_verdict(audits.run_audits(t))


@query("i13_one_correct_choice", "SELECT Ch_QId, count(*) AS n_rows FROM choice_bad WHERE Ch_Correct GROUP BY Ch_QId HAVING count(*) > 1")
def _(t):
    return constraints.correct_choice_violations(req.bad_choices(t))


@query("i14_reference", reference_sql())
def _(t):
    return constraints.reference_violations(req.broken_references(t))


@query("i15_value", value_sql())
def _(t):
    return constraints.value_violations(req.broken_values(t))


def _batch(rule: str, of: str, tables):
    """All rows of the rule's table come in as one batch: is it refused, and why?"""

    @query(f"{rule.lower().replace('-', '')}_batch_verdict", f"SELECT rule, message, count(*) AS n_rows, min(key) AS first_key FROM ({BODY[of]}) GROUP BY rule, message")
    def verdict(t):
        now = tables(t)
        return audits.batch_verdict(audits.AUDITS[rule](now, now[audits.SUBJECT[rule]]))


_batch("I-1", "i1_student_track_branch", lambda t: t)
_batch("I-2", "i2_exam_track_branch", lambda t: req.bad_exams(_all_exams(t)))
_batch("I-3", "i3_seat_student", lambda t: t)
_batch("I-4", "i4_exam_question_course", lambda t: req.bad_exam_questions(_all_exams(t), t.file("part")))
_batch("I-5", "i5_exam_max_degree", _all_exams)
_batch("I-6", "i6_question_author", lambda t: t)
_batch("I-7", "i7_tf_type", req.bad_tf)
_batch("I-8", "i8_text_type", req.bad_text)
_batch("I-9", "i9_choice_type", req.bad_choices)


# -- functions ---------------------------------------------------------------------------


@query(
    "f1_exam_total_degree",
    """
SELECT e.Exm_Id, CAST(coalesce(sum(EQ_Degree), 0) AS DECIMAL(10,2)) AS TotalDegree
FROM all_exam e LEFT JOIN all_eq ON EQ_ExmId = e.Exm_Id GROUP BY e.Exm_Id""",
)
def _(t):
    """Over all exams, some of which have no question."""
    return views.exam_total_degree(_all_exams(t))


_KEEP_END = "regexp_replace(translate(lower(trim({})), chr(9) || chr(10) || chr(13), '   '), ' {{2,}}', ' ', 'g')"


@query("f2_normalize_answer", f"SELECT doc_id, {_KEEP_END.format('text')} AS normal FROM documents")
def _(t):
    return t.file("documents", "doc_id").select("doc_id", normalize_answer(F.col("text")).alias("normal"))


@query(
    "f3_is_answer_valid",
    f"""
SELECT doc_id, coalesce({NORM.format("given")} = {NORM.format("text")}, false) AS valid FROM (
  SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '  ' || translate(text, '{SMALL}', '{LARGE}') || ' '
    WHEN doc_id % 3 = 1 THEN text || '.' WHEN doc_id % 5 <> 0 THEN replace(text, ' ', '   ') END AS given FROM documents)""",
)
def _(t):
    text, key = F.col("text"), F.col("doc_id")
    given = (
        F.when(every(3, key), F.concat(F.lit("  "), F.translate(text, SMALL, LARGE), F.lit(" ")))
        .when(every(3, key, 1), F.concat(text, F.lit(".")))
        .when(~every(5, key), F.replace(text, F.lit(" "), F.lit("   ")))
    )
    return t.file("documents", "doc_id").select("doc_id", is_answer_valid(given, text).alias("valid"))


# -- request operators -------------------------------------------------------------------


@query("p1_create_question", "SELECT Q_Id, Q_CrsId, Q_Type, Q_Text, Q_CreatedBy FROM new1")
def _(t):
    return exams.create_questions(req.question_requests(t), t).questions.drop("req_id")


@query("p1_create_question_keys", "SELECT Q_Id, Q_Type, CASE WHEN Q_Type = 'TF' THEN false END AS TF_Correct, CASE WHEN Q_Type = 'Text' THEN '' END AS Txt_BestAnswer FROM new1 WHERE Q_Type <> 'MCQ'")
def _(t):
    new = exams.create_questions(req.question_requests(t), t)
    tf = new.tf.select(F.col("TF_QId").alias("Q_Id"), F.lit("TF").alias("Q_Type"), "TF_Correct", F.lit(None).cast("string").alias("Txt_BestAnswer"))
    text = new.text.select(F.col("Txt_QId").alias("Q_Id"), F.lit("Text").alias("Q_Type"), F.lit(None).cast("boolean").alias("TF_Correct"), "Txt_BestAnswer")
    return tf.unionByName(text)


@query("p1_create_question_rejected", rejected("j1", "50001 50002 I-15"))
def _(t):
    return exams.create_questions(req.question_requests(t), t).rejected


_EXAM = "Exm_Id, Exm_AsgId, Exm_Type, Exm_IntId, Exm_BrId, Exm_TrkId, CAST(Exm_Start AS VARCHAR) AS Exm_Start, CAST(Exm_End AS VARCHAR) AS Exm_End, Exm_TotalTime, Exm_Allowance"
_EXAM_COLUMNS = ["Exm_Id", *exams.EXAM_COLUMNS]


@query("p2_random_exam", f"SELECT {_EXAM} FROM new2")
def _(t):
    return exams.generate_random_exams(req.random_exam_requests(t), t, 7).exams.select(*_EXAM_COLUMNS)


@query(
    "p2_random_exam_questions",
    """
SELECT (SELECT max(EQ_Id) FROM t_examquestion) + row_number() OVER (ORDER BY EQ_ExmId, EQ_QId) AS EQ_Id, EQ_ExmId, EQ_QId, EQ_Degree
FROM eq2""",
)
def _(t):
    return exams.generate_random_exams(req.random_exam_requests(t), t, 7).questions


@query(
    "p2_random_exam_rejected",
    rejected("j2", "50010 50011 50012 50013 50014 50015 50016 50017 50018 50019 I-11 I-14 I-2"),
)
def _(t):
    return exams.generate_random_exams(req.random_exam_requests(t), t, 7).rejected


@query(
    "p2_random_exam_defaults_rejected",
    rejected("j2d", "50010 50011 50012 50013 50014 50015 50016 50017 50018 50019 I-11 I-14 I-2"),
)
def _(t):
    """Requests that give a number of choice questions and leave the rest to the defaults."""
    short = req.random_exam_requests(t).drop("n_tf", "n_text", "degree")
    return exams.generate_random_exams(short, t, 7).rejected


@query("p3_manual_exam", f"SELECT {_EXAM} FROM new3")
def _(t):
    return _manual(t).exams.select(*_EXAM_COLUMNS)


@query(
    "p3_manual_exam_questions",
    """
SELECT (SELECT max(EQ_Id) FROM t_examquestion) + row_number() OVER (ORDER BY Exm_Id, QId) AS EQ_Id, Exm_Id AS EQ_ExmId,
       QId AS EQ_QId, l3.degree AS EQ_Degree
FROM new3 JOIN l3 ON l3.req_id = new3.req_id""",
)
def _(t):
    return _manual(t).questions


@query("p3_manual_exam_rejected", rejected("j3", "50100 50101 50102 I-11 I-2 I-12"))
def _(t):
    return _manual(t).rejected


@query(
    "p4_assign_student",
    """
SELECT (SELECT max(SE_Id) FROM seated) + row_number() OVER (ORDER BY req_id) AS SE_Id, SE_ExmId, SE_StId,
       CAST(SE_Date AS VARCHAR) AS SE_Date, SE_Start, SE_End
FROM j4 WHERE error_code IS NULL""",
)
def _(t):
    return exams.assign_seats(req.seat_requests(t), req.seats_already(t)).seats.drop("req_id")


@query("p4_assign_student_rejected", rejected("j4", "50200 50201 50202 50203 I-12"))
def _(t):
    return exams.assign_seats(req.seat_requests(t), req.seats_already(t)).rejected


_SAVED = "SELECT * FROM saved5"
_REFUSED = rejected("j5", "50500 50501 I-14 I-10a I-10b I-10c")


@query("p5_save_answer", _SAVED)
def _(t):
    return answers.save_answers(req.answer_requests(t), req.some_answers(t)).answers


@query("p5_save_answer_rejected", _REFUSED)
def _(t):
    return answers.save_answers(req.answer_requests(t), req.some_answers(t)).rejected


@query("p5_two_batches", "SELECT * EXCLUDE (Ans_Id) FROM saved5")
def _(t):
    """The batch in two parts, the later half of each hour first: what is stored does not depend on it."""
    tables, requests = req.some_answers(t), req.answer_requests(t)
    late = F.minute("submitted_at") >= 30
    first = answers.save_answers(requests.where(late), tables, stamped=True).answers
    first = store.replace(tables, StudentAnswer=stage_dense(first, "first-batch"))
    return answers.save_answers(requests.where(~late), first).answers.drop("Ans_Id")


@query("p6_final_results", "SELECT SE_Id, FinalResult FROM results")
def _(t):
    return grading.final_results(t)


@query("p6_graded_answers", "SELECT Ans_Id, Ans_SEId, Ans_QId, Ans_Correct, Ans_Degree FROM graded")
def _(t):
    return grading.grade_answers(t).select("Ans_Id", "Ans_SEId", "Ans_QId", "Ans_Correct", "Ans_Degree")


@query(
    "p6_grade_requests",
    f"""
SELECT CAST(o_orderkey AS VARCHAR) AS req_id, '50300' AS error_code, '{message("50300")}' AS error_message
FROM orders WHERE o_orderkey % 43 = 3""",
)
def _(t):
    """Requests to grade one seat each, some of them for seats that do not exist."""
    return grading.grade_seats(t, req.grade_requests(t)).rejected


@query(
    "p6_grade_requests_answers",
    """
SELECT Ans_Id, Ans_SEId, Ans_QId, Ans_Correct, Ans_Degree FROM graded JOIN orders ON o_orderkey = Ans_SEId
WHERE o_orderkey % 43 <> 3""",
)
def _(t):
    graded = grading.grade_seats(t, req.grade_requests(t)).answers
    return graded.select("Ans_Id", "Ans_SEId", "Ans_QId", "Ans_Correct", "Ans_Degree")


@query("p6_grade_requests_results", "SELECT SE_Id, FinalResult FROM results WHERE SE_Id % 43 <> 3")
def _(t):
    return grading.grade_seats(t, req.grade_requests(t)).results


@query(
    "p6_overflowing_seats",
    f"""
SELECT CAST(Ans_SEId AS VARCHAR) AS req_id, 'OVERFLOW' AS error_code, '{message("OVERFLOW")}' AS error_message
FROM t_answer WHERE Ans_SEId % 7 = 0 GROUP BY Ans_SEId HAVING count(*) > 1""",
)
def _(t):
    """Answers off their exam that carry the largest degree: two of them are too much for a seat."""
    heavy = every(7, F.col("Ans_SEId"))
    answers_ = t["StudentAnswer"]
    changed = {"Ans_QId": -F.col("Ans_QId") - 1, "Ans_Degree": F.lit("999.99").cast("decimal(5,2)")}
    columns = [F.when(heavy, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in answers_.columns]
    return grading.overflowing_seats(grading.seat_totals(store.replace(t, StudentAnswer=answers_.select(*columns))))


def _marked(t):
    return grading.mark_answers(req.marks(t), _graded(t))


@query("p7_mark_answer", "SELECT Ans_Id, Ans_SEId, Ans_QId, Ans_TextAns, Ans_Correct, Ans_Degree, Ans_Comment FROM marked")
def _(t):
    return _marked(t).answers.drop("Ans_ChoiceId", "Ans_BoolAns")


@query("p7_mark_answer_results", "SELECT SE_Id, SE_Result FROM marked_seat")
def _(t):
    return _marked(t).seats.select("SE_Id", "SE_Result")


@query("p7_mark_answer_rejected", rejected("j7", "50400 50401"))
def _(t):
    judged = grading.judge_marks(req.marks(t), t)
    return with_messages(judged.where(F.col(ERROR).isNotNull()), grading.MARK_CODES).select(
        "req_id", "error_code", "error_message"
    )


@query(
    "p6_regrade_after_marks",
    """
SELECT m.Ans_Id, g.Ans_Correct, g.Ans_Degree, m.Ans_Comment FROM marked m JOIN graded g ON g.Ans_Id = m.Ans_Id""",
)
def _(t):
    """Grading again overwrites reviewers' marks, while their comments stay."""
    again = grading.grade_answers(store.replace(t, StudentAnswer=_marked(t).answers))
    return again.select("Ans_Id", "Ans_Correct", "Ans_Degree", "Ans_Comment")


def _added(key: str, columns: str, judged: str, table: str) -> str:
    return (
        f"SELECT (SELECT max({key}) FROM {table}) + row_number() OVER (ORDER BY req_id) AS {key}, {columns} "
        f"FROM {judged} WHERE error_code IS NULL"
    )


def _dimension(number: int, name: str, table: str, requests, base, operator, sql: str, codes: str):
    @query(f"p{number}_{name}", sql)
    def rows(t):
        return operator(requests(t), base(t), table).rows

    @query(f"p{number}_{name}_rejected", rejected(f"j{number}", codes))
    def refused(t):
        return operator(requests(t), base(t), table).rejected


def _changed(judged: str, table: str, key: str, columns: str) -> str:
    picks = ", ".join(f"CASE WHEN l.{key} IS NULL THEN b.{c} ELSE l.{c} END AS {c}" for c in columns.split())
    return f"""
SELECT b.* REPLACE ({picks}) FROM {table} b LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY req_id DESC) AS age FROM {judged} WHERE error_code IS NULL)
  WHERE age = 1) l ON l.{key} = b.{key}"""


def _same(t):
    return t


_dimension(8, "add_branch", "Branch", req.branch_requests, _same, dimensions.ingest,
           _added("Br_Id", "Br_Name, Br_Location", "j8", "t_branch"), "I-15 I-12")
_dimension(9, "update_branch", "Branch", req.branch_changes, req.more_branches, dimensions.merge,
           _changed("j9", "big_branch", "Br_Id", "Br_Name Br_Location"), "I-12")
_dimension(10, "add_track", "Track", req.track_requests, _same, dimensions.ingest,
           _added("Trk_Id", "Trk_Name, Trk_BrId", "j10", "t_track"), "50600 I-12")
_dimension(11, "update_track", "Track", req.track_changes, req.more_tracks, dimensions.merge,
           _changed("j11", "big_track", "Trk_Id", "Trk_Name Trk_BrId"), "I-14 I-12")
_dimension(12, "add_intake", "Intake", req.intake_requests, _same, dimensions.ingest,
           _added("Int_Id", "Int_Name, CAST(Int_StartDate AS VARCHAR) AS Int_StartDate", "j12", "t_intake"), "I-15 I-12")
_dimension(13, "add_student", "Student", req.student_requests, _same, dimensions.ingest,
           _added("St_Id", "St_User, St_Name, St_Email, St_Phone, St_BrId, St_TrkId, St_IntId", "j13", "t_student"),
           "I-14 I-1 I-12")
_dimension(14, "update_student", "Student", req.student_changes, _same, dimensions.merge,
           _changed("j14", "t_student", "St_Id", "St_Name St_Email St_Phone St_BrId St_TrkId St_IntId"),
           "I-14 I-1 I-12")


@query(
    "p11_stale_students",
    _violations(
        "I-1",
        f"SELECT St_Id AS key FROM t_student JOIN ({_changed('j11s', 't_track', 'Trk_Id', 'Trk_BrId')}) n ON n.Trk_Id = St_TrkId "
        "WHERE n.Trk_BrId <> St_BrId",
    ).replace("j11s", "(SELECT n_nationkey + 1 AS Trk_Id, 5 AS Trk_BrId, 1 AS req_id, NULL AS error_code FROM nation WHERE n_regionkey = 0)"),
)
def _(t):
    """Moving tracks to another branch leaves students behind; the whole-table audit finds them."""
    n = F.col("n_nationkey")
    moves = t.file("nation").where(F.col("n_regionkey") == 0).select(
        F.lit(1).cast("long").alias("req_id"), (n + 1).cast("long").alias("Trk_Id"), F.col("n_name").alias("Trk_Name"),
        F.lit(5).cast("long").alias("Trk_BrId"),
    )
    moved = dimensions.merge(moves, t, "Track").rows
    return audits.AUDITS["I-1"](store.replace(t, Track=moved), None)


@query(
    "p11_stale_exams",
    _violations(
        "I-2",
        "SELECT Exm_Id AS key FROM t_exam JOIN (SELECT CASE WHEN n_regionkey = 0 THEN 5 ELSE n_regionkey + 1 END AS branch, n_nationkey + 1 AS track "
        "FROM nation) ON track = Exm_TrkId WHERE branch <> Exm_BrId",
    ),
)
def _(t):
    """The same move leaves exams behind."""
    n = F.col("n_nationkey")
    moves = t.file("nation").where(F.col("n_regionkey") == 0).select(
        F.lit(1).cast("long").alias("req_id"), (n + 1).cast("long").alias("Trk_Id"), F.col("n_name").alias("Trk_Name"),
        F.lit(5).cast("long").alias("Trk_BrId"),
    )
    return audits.AUDITS["I-2"](store.replace(t, Track=dimensions.merge(moves, t, "Track").rows), None)


@query(
    "p14_stale_seats",
    _violations(
        "I-3",
        "SELECT SE_Id AS key FROM t_seat JOIN t_exam ON Exm_Id = SE_ExmId JOIN t_student ON St_Id = SE_StId "
        "WHERE Exm_BrId <> St_BrId OR Exm_TrkId <> St_TrkId OR CASE WHEN St_Id % 3 = 0 AND St_Id % 97 <> 0 THEN St_IntId % 5 + 1 ELSE St_IntId END <> Exm_IntId",
    ),
)
def _(t):
    """Students who change their intake leave their seats behind."""
    key = F.col("St_Id")
    moves = t.Student.where(every(3, key) & ~every(97, key)).select(
        key.alias("req_id"), key, "St_Name", "St_Email", "St_Phone",
        F.col("St_BrId").cast("long").alias("St_BrId"), F.col("St_TrkId").cast("long").alias("St_TrkId"),
        (F.col("St_IntId") % 5 + 1).cast("long").alias("St_IntId"),
    )
    return audits.AUDITS["I-3"](store.replace(t, Student=dimensions.merge(moves, t, "Student").rows), None)


_HARDER = "SELECT * REPLACE (CASE WHEN Crs_Id % 3 = 0 THEN CAST(Crs_MaxDeg / 2 AS DECIMAL(5,2)) ELSE Crs_MaxDeg END AS Crs_MaxDeg) FROM t_course"


@query(
    "i5_stale_degrees",
    _violations(
        "I-5",
        f"SELECT Exm_Id AS key FROM all_exam JOIN t_assignment ON Asg_Id = Exm_AsgId JOIN ({_HARDER}) c ON c.Crs_Id = Asg_CrsId "
        "WHERE c.Crs_Id % 3 = 0 AND (SELECT coalesce(sum(EQ_Degree), 0) FROM all_eq WHERE EQ_ExmId = Exm_Id) > c.Crs_MaxDeg",
    ),
)
def _(t):
    """Every third course now allows half its degrees: which of its exams are over?"""
    tables = _all_exams(t)
    key, most = F.col("Crs_Id"), F.col("Crs_MaxDeg")
    lower = tables["Course"].withColumn("Crs_MaxDeg", F.when(every(3, key), (most / 2).cast("decimal(5,2)")).otherwise(most))
    return stale.stale(tables, store.replace(tables, Course=lower), "Course")


@query(
    "i6_stale_authors",
    _violations(
        "I-6",
        "SELECT Q_Id AS key FROM t_question WHERE (Q_CrsId, Q_CreatedBy) IN (SELECT (Asg_CrsId, Asg_InsId) FROM t_assignment WHERE Asg_Id % 4 = 0) "
        "AND (Q_CrsId, Q_CreatedBy) NOT IN (SELECT (Asg_CrsId, Asg_InsId) FROM t_assignment WHERE Asg_Id % 4 <> 0)",
    ),
)
def _(t):
    """Assignments are taken away: whose questions have no assigned author left?"""
    kept = t["CourseAssignment"].where(F.col("Asg_Id") % 4 != 0)
    return stale.stale(t, store.replace(t, CourseAssignment=kept), "CourseAssignment", ["I-6"])


_RETYPED = "SELECT * REPLACE (CASE WHEN Q_Id % 13 = 5 THEN CASE Q_Type WHEN 'MCQ' THEN 'TF' WHEN 'TF' THEN 'Text' ELSE 'MCQ' END ELSE Q_Type END AS Q_Type) FROM t_question"


@query(
    "i7_stale_types",
    f"""
{_violations("I-7", f"SELECT TF_QId AS key FROM t_tf JOIN ({_RETYPED} WHERE Q_Id % 13 = 5) ON Q_Id = TF_QId WHERE Q_Type <> 'TF'")}
UNION ALL {_violations("I-8", f"SELECT Txt_QId AS key FROM t_text JOIN ({_RETYPED} WHERE Q_Id % 13 = 5) ON Q_Id = Txt_QId WHERE Q_Type <> 'Text'")}
UNION ALL {_violations("I-9", f"SELECT Ch_Id AS key FROM t_choice JOIN ({_RETYPED} WHERE Q_Id % 13 = 5) ON Q_Id = Ch_QId WHERE Q_Type <> 'MCQ'")}
UNION ALL {_I10.replace("answer_bad a", "t_answer a").replace("t_question q", f"({_RETYPED}) q").replace("WHERE error_code", "WHERE key IN (SELECT Ans_Id FROM t_answer WHERE Ans_QId % 13 = 5) AND error_code")}""",
)
def _(t):
    """Questions get another type: which keys, best answers, choices and answers do not fit any more?"""
    kind = F.col("Q_Type")
    other = F.when(kind == "MCQ", "TF").when(kind == "TF", "Text").otherwise("MCQ")
    retyped = t["Question"].withColumn("Q_Type", F.when(every(13, F.col("Q_Id"), 5), other).otherwise(kind))
    return stale.stale(t, store.replace(t, Question=retyped), "Question", ["I-7", "I-8", "I-9", "I-10"])


# -- searches ----------------------------------------------------------------------------


@query(
    "p15_search_students_brackets",
    """
SELECT St_Id, St_Name, St_Email, St_Phone, Br_Name, Trk_Name, Int_Name FROM t_student JOIN t_branch ON Br_Id = St_BrId
JOIN t_track ON Trk_Id = St_TrkId JOIN t_intake ON Int_Id = St_IntId WHERE regexp_matches(St_Name, '[13-5].[^0-6]')""",
)
def _(t):
    """Names with bracket classes: one of some digits, any character, none of others."""
    return searches.search_students(t, name="[13-5]_[^0-6]")


@query(
    "p15_search_students_backslash",
    """
SELECT St_Id, replace(St_Name, '#', chr(92)) AS St_Name FROM t_student
WHERE replace(St_Name, '#', chr(92)) LIKE '%' || chr(92) || '%1_5%'""",
)
def _(t):
    """Names that hold a backslash, looked for with one."""
    named = t["Student"].withColumn("St_Name", F.replace("St_Name", F.lit("#"), F.lit("\\")))
    return searches.search_students(store.replace(t, Student=named), name="\\%1_5").select("St_Id", "St_Name")


@query(
    "p15_search_students",
    """
SELECT St_Id, St_Name, St_Email, St_Phone, Br_Name, Trk_Name, Int_Name FROM t_student JOIN t_branch ON Br_Id = St_BrId
JOIN t_track ON Trk_Id = St_TrkId JOIN t_intake ON Int_Id = St_IntId
WHERE St_Name LIKE '%' || '#%1_5' || '%' AND St_BrId = 2""",
)
def _(t):
    return searches.search_students(t, name="#%1_5", branch=2)


@query(
    "p15_search_students_ci",
    """
SELECT St_Id, St_Name, St_Email, St_Phone, Br_Name, Trk_Name, Int_Name FROM t_student JOIN t_branch ON Br_Id = St_BrId
JOIN t_track ON Trk_Id = St_TrkId JOIN t_intake ON Int_Id = St_IntId WHERE St_Name ILIKE '%MER#%7%' AND St_IntId = 3""",
)
def _(t):
    return searches.search_students(t, name="MER#%7", intake=3, ci=True)


@query(
    "p15_search_students_all",
    """
SELECT St_Id, St_Name, St_Email, St_Phone, Br_Name, Trk_Name, Int_Name FROM t_student JOIN t_branch ON Br_Id = St_BrId
JOIN t_track ON Trk_Id = St_TrkId JOIN t_intake ON Int_Id = St_IntId""",
)
def _(t):
    return searches.search_students(t)


@query(
    "p16_search_exams",
    """
SELECT Exm_Id, Crs_Name, Exm_Type, Br_Name, Trk_Name, CAST(Exm_Start AS VARCHAR) AS Exm_Start, CAST(Exm_End AS VARCHAR) AS Exm_End,
       Exm_TotalTime
FROM all_exam JOIN t_assignment ON Asg_Id = Exm_AsgId JOIN t_course c ON c.Crs_Id = Asg_CrsId
JOIN t_branch ON Br_Id = Exm_BrId JOIN t_track ON Trk_Id = Exm_TrkId
WHERE Exm_Type = 'Corrective' AND CAST(Exm_Start AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-02-10'""",
)
def _(t):
    return searches.search_exams(
        _all_exams(t), exam_type="Corrective", from_date=dt.date(2024, 1, 5), to_date=dt.date(2024, 2, 10)
    )


def _by_day(t) -> store.Tables:
    """All exams and their questions by day; small files here, so that a day is some of many."""
    return ranges.lay_out_exams(_all_exams(t), new_folder(t.spark, "exams"), rows_per_file=2_000)


@query(
    "p16_search_one_day",
    """
SELECT Exm_Id, Crs_Name, Exm_Type, Br_Name, Trk_Name, CAST(Exm_Start AS VARCHAR) AS Exm_Start, CAST(Exm_End AS VARCHAR) AS Exm_End,
       Exm_TotalTime
FROM all_exam JOIN t_assignment ON Asg_Id = Exm_AsgId JOIN t_course c ON c.Crs_Id = Asg_CrsId
JOIN t_branch ON Br_Id = Exm_BrId JOIN t_track ON Trk_Id = Exm_TrkId WHERE CAST(Exm_Start AS DATE) = DATE '2024-02-10'""",
)
def _(t):
    day = dt.date(2024, 2, 10)
    return searches.search_exams(_by_day(t), from_date=day, to_date=day)


@query(
    "p17_search_questions",
    """
SELECT Q_Id, Crs_Name, Q_Type, Q_Text, Ins_Name FROM t_question JOIN t_course ON Crs_Id = Q_CrsId
JOIN t_instructor ON Ins_Id = Q_CreatedBy WHERE Q_CrsId = 7 AND Q_Type = 'Text'""",
)
def _(t):
    return searches.search_questions(t, course=7, question_type="Text")


# -- views -------------------------------------------------------------------------------


@query(
    "v1_question_pool",
    """
SELECT Q_Id, Q_CrsId, Crs_Name, Q_Type, Q_Text, Q_CreatedBy, Ins_Name FROM t_question JOIN t_course ON Crs_Id = Q_CrsId
JOIN t_instructor ON Ins_Id = Q_CreatedBy""",
)
def _(t):
    return views.question_pool(t)


@query(
    "v2_exam_details",
    """
SELECT Exm_Id, Exm_Type, Crs_Name, Ins_Name, Exm_IntId, Int_Name, Exm_BrId, Br_Name, Exm_TrkId, Trk_Name,
       CAST(Exm_Start AS VARCHAR) AS Exm_Start, CAST(Exm_End AS VARCHAR) AS Exm_End, Exm_TotalTime, Exm_Allowance,
       CAST((SELECT coalesce(sum(EQ_Degree), 0) FROM all_eq WHERE EQ_ExmId = Exm_Id) AS DECIMAL(10,2)) AS TotalDegree
FROM all_exam JOIN t_assignment ON Asg_Id = Exm_AsgId JOIN t_course c ON c.Crs_Id = Asg_CrsId
JOIN t_instructor ON Ins_Id = Asg_InsId JOIN t_intake ON Int_Id = Exm_IntId JOIN t_branch ON Br_Id = Exm_BrId
JOIN t_track ON Trk_Id = Exm_TrkId""",
)
def _(t):
    return views.exam_details(_all_exams(t))


@query(
    "v2_details_of_days",
    BODY["v2_exam_details"] + " WHERE CAST(Exm_Start AS DATE) BETWEEN DATE '2024-02-10' AND DATE '2024-02-11'",
)
def _(t):
    return views.exam_details(_by_day(t), dt.date(2024, 2, 10), dt.date(2024, 2, 11))


@query(
    "v3_student_results",
    """
SELECT SE_Id, St_Id, St_Name, Exm_Id, Crs_Name, Exm_Type, CAST(SE_Date AS VARCHAR) AS SE_Date, SE_Start, SE_End,
       FinalResult AS SE_Result
FROM t_seat JOIN results USING (SE_Id) JOIN t_student ON St_Id = SE_StId JOIN t_exam ON Exm_Id = SE_ExmId
JOIN t_assignment ON Asg_Id = Exm_AsgId JOIN t_course c ON c.Crs_Id = Asg_CrsId""",
)
def _(t):
    return views.student_results(_graded(t))


@query(
    "v4_text_answers_for_review",
    """
SELECT g.Ans_Id, SE_Id, St_Id, St_Name, Q_Id, Q_Text, a.Ans_TextAns, Txt_BestAnswer, g.Ans_Correct, g.Ans_Degree, EQ_Degree,
       a.Ans_Comment
FROM graded g JOIN t_answer a ON a.Ans_Id = g.Ans_Id JOIN t_seat ON SE_Id = g.Ans_SEId JOIN t_student ON St_Id = SE_StId
JOIN t_question ON Q_Id = g.Ans_QId JOIN t_text ON Txt_QId = Q_Id JOIN t_examquestion ON EQ_ExmId = SE_ExmId AND EQ_QId = Q_Id""",
)
def _(t):
    return views.text_answers_for_review(_graded(t))


@query(
    "v5_exam_questions",
    "SELECT EQ_Id, EQ_ExmId, EQ_QId, Q_Type, Q_Text, EQ_Degree FROM all_eq JOIN t_question ON Q_Id = EQ_QId",
)
def _(t):
    return views.exam_questions(_all_exams(t))


# -- stream ------------------------------------------------------------------------------


def _streamed(t):
    """The files of the incoming batch, in no order of time, a few files per micro-batch."""
    root = new_folder(t.spark, "stream")
    tables = req.some_answers(t)
    submissions = stream.read_submissions(t.spark, req.incoming(t), files_per_batch=3)
    stream.stream_answers(submissions, tables, f"{root}/log", f"{root}/checkpoint")
    return stream.collect_answers(t.spark, f"{root}/log", tables)


@query("st1_stream_answers", _SAVED)
def _(t):
    return _streamed(t).answers


@query("st1_stream_answers_rejected", _REFUSED)
def _(t):
    return _streamed(t).rejected


@query("st1_merged_log", "SELECT * EXCLUDE (Ans_Id) FROM saved5")
def _(t):
    """The log's files reach the stored answers a few at a time, in whatever order they were written."""
    root = new_folder(t.spark, "stream")
    tables = req.some_answers(t)
    submissions = stream.read_submissions(t.spark, req.incoming(t), files_per_batch=3)
    stream.stream_answers(submissions, tables, f"{root}/log", f"{root}/checkpoint")
    stored_answers = _answer_store(t, tables["StudentAnswer"])
    stream.merge_log(f"{root}/log", stored_answers, f"{root}/merged", files_per_batch=24)
    return stored_answers.rows().drop("Ans_Id", "submitted_at", "req_id")
