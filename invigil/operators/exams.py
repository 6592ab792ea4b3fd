"""Questions, exams and seats from batches of requests."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invigil.functions.clock import micros_of_day
from invigil.functions.numbering import append_with_ids
from invigil.functions.rules import ERROR, Outcome, Rule, judge, split, violates_checks, violates_required
from invigil.operators.sampling import draw_questions
from invigil.schema import DEGREE, MCQ, TEXT, TF
from invigil.session import stage
from invigil.sources.tables import Tables, conform


def known(requests: DataFrame, column: str, table: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """``requests`` with a flag for whether ``column`` names a row of ``table``."""
    flag = f"_has_{column}"
    there = table.select(F.col(key).alias(flag))
    return requests.join(there, F.col(column) == F.col(flag), "left"), F.col(flag).isNotNull()


def lost(column: str, found: Column) -> Rule:
    return "I-14", F.col(column).isNotNull() & ~found


# -- questions --------------------------------------------------------------------------

QUESTION_CODES = ["50001", "50002", "I-15"]


class NewQuestions(NamedTuple):
    questions: DataFrame
    tf: DataFrame
    text: DataFrame
    rejected: DataFrame


def judge_questions(requests: DataFrame, tables: Tables) -> DataFrame:
    """``requests(req_id, Q_CrsId, Q_Type, Q_Text, Q_CreatedBy)`` with ``error_code``."""
    assigned = (
        tables["CourseAssignment"].select(F.col("Asg_CrsId").alias("_crs"), F.col("Asg_InsId").alias("_ins")).distinct()
    )
    mine = (F.col("Q_CrsId") == F.col("_crs")) & (F.col("Q_CreatedBy") == F.col("_ins"))
    joined = requests.join(assigned, mine, "left")
    rules = [
        ("50001", F.col("_crs").isNull()),
        ("50002", ~F.col("Q_Type").isin(MCQ, TF, TEXT)),
        violates_required("Question", ["Q_Type", "Q_Text"]),
    ]
    return judge(joined, rules).drop("_crs", "_ins")


def create_questions(requests: DataFrame, tables: Tables) -> NewQuestions:
    """New questions with ids, and the empty key rows that true/false and text ones start with."""
    outcome = split(judge_questions(requests, tables), QUESTION_CODES)
    questions = append_with_ids(tables["Question"], outcome.accepted, "Q_Id", "req_id")
    tf = questions.where(F.col("Q_Type") == TF).select(F.col("Q_Id").alias("TF_QId"), F.lit(False).alias("TF_Correct"))
    text = questions.where(F.col("Q_Type") == TEXT).select(
        F.col("Q_Id").alias("Txt_QId"), F.lit("").alias("Txt_BestAnswer")
    )
    return NewQuestions(questions, tf, text, outcome.rejected)


# -- exams ------------------------------------------------------------------------------

EXAM_COLUMNS = [
    "Exm_AsgId", "Exm_Type", "Exm_IntId", "Exm_BrId", "Exm_TrkId", "Exm_Start", "Exm_End", "Exm_TotalTime",
    "Exm_Allowance",
]


class NewExams(NamedTuple):
    exams: DataFrame
    questions: DataFrame
    rejected: DataFrame


def _with_course(requests: DataFrame, tables: Tables) -> DataFrame:
    """``requests`` with the course of their assignment and its highest total degree."""
    assignment = tables["CourseAssignment"].select("Asg_Id", "Asg_CrsId")
    course = tables["Course"].select("Crs_Id", "Crs_MaxDeg")
    return requests.join(assignment, F.col("Exm_AsgId") == F.col("Asg_Id"), "left").join(
        course, F.col("Asg_CrsId") == F.col("Crs_Id"), "left"
    )


def _header_rules(requests: DataFrame, tables: Tables) -> tuple[DataFrame, list[Rule]]:
    """What storing the exam row itself demands, after the codes of the operator."""
    requests, has_intake = known(requests, "Exm_IntId", tables["Intake"], "Int_Id")
    requests, has_branch = known(requests, "Exm_BrId", tables["Branch"], "Br_Id")
    tracks = tables["Track"].select("Trk_Id", "Trk_BrId")
    requests = requests.join(tracks, F.col("Exm_TrkId") == F.col("Trk_Id"), "left")
    return requests, [
        violates_required("Exam", EXAM_COLUMNS),
        violates_checks("Exam", EXAM_COLUMNS),
        lost("Exm_IntId", has_intake),
        lost("Exm_BrId", has_branch),
        lost("Exm_TrkId", F.col("Trk_Id").isNotNull()),
        ("I-2", F.col("Trk_BrId") != F.col("Exm_BrId")),
    ]


RANDOM_CODES = [f"500{i}" for i in range(10, 20)] + ["I-15", "I-11", "I-14", "I-2"]
# Request column of each question type.
COUNTS = {MCQ: "n_mcq", TF: "n_tf", TEXT: "n_text"}


def pool_sizes(tables: Tables) -> DataFrame:
    """Questions of each type per course, one row per course."""
    counts = [F.count_if(F.col("Q_Type") == kind).alias(f"has_{column}") for kind, column in COUNTS.items()]
    return tables["Question"].groupBy(F.col("Q_CrsId").alias("_pool")).agg(*counts)


def judge_random_exams(requests: DataFrame, tables: Tables) -> DataFrame:
    """``requests(req_id, <exam columns>, n_mcq, n_tf, n_text, degree)`` with ``error_code``."""
    joined = _with_course(requests, tables).join(
        pool_sizes(tables), F.col("Asg_CrsId") == F.col("_pool"), "left"
    )
    for column in COUNTS.values():
        joined = joined.withColumn(f"has_{column}", F.coalesce(f"has_{column}", F.lit(0)))
    joined, header = _header_rules(joined, tables)
    n = {kind: F.col(column) for kind, column in COUNTS.items()}
    total = n[MCQ] + n[TF] + n[TEXT]
    rules = [
        ("50010", F.col("Asg_CrsId").isNull()),
        ("50011", (n[MCQ] < 0) | (n[TF] < 0) | (n[TEXT] < 0)),
        ("50012", F.col("degree") <= 0),
        ("50013", F.col("Exm_Start") >= F.col("Exm_End")),
        ("50014", F.col("Exm_TotalTime") <= 0),
        ("50015", total == 0),
        ("50016", total * F.col("degree") > F.col("Crs_MaxDeg")),
        ("50017", F.col("has_n_mcq") < n[MCQ]),
        ("50018", F.col("has_n_tf") < n[TF]),
        ("50019", F.col("has_n_text") < n[TEXT]),
        ("I-15", total.isNull() | F.col("degree").isNull()),
        *header,
    ]
    judged = judge(joined, rules)
    return judged.select(*requests.columns, "Asg_CrsId", *[f"has_{c}" for c in COUNTS.values()], ERROR)


# What a column that is left out counts as.
RANDOM_DEFAULTS = {"n_mcq": "0", "n_tf": "0", "n_text": "0", "degree": "cast(1 as decimal(5,2))"}


def with_random_defaults(requests: DataFrame) -> DataFrame:
    """``requests`` with the declared defaults in place of columns that are left out altogether."""
    missing = {c: F.expr(sql) for c, sql in RANDOM_DEFAULTS.items() if c not in requests.columns}
    return requests.withColumns(missing) if missing else requests


def generate_random_exams(requests: DataFrame, tables: Tables, seed: int | str = 0) -> NewExams:
    """Exams with random questions of each type from the course's pool.

    Counts that are left out as columns are 0, a degree that is left out is 1.

    The draw depends on the seed, the request and the pool alone.  A request whose counts
    are missing cannot be stored and is rejected like any missing value.
    """
    outcome = split(judge_random_exams(with_random_defaults(requests), tables), RANDOM_CODES)
    exams = stage(append_with_ids(tables["Exam"], outcome.accepted, "Exm_Id", "req_id"), "exams")
    wanted = F.array(
        *[
            F.struct(F.lit(kind).alias("type"), F.col(column).alias("n"), F.col(f"has_{column}").alias("size"))
            for kind, column in COUNTS.items()
        ]
    )
    draws = (
        exams.select("req_id", "Exm_Id", "Asg_CrsId", "degree", F.inline(wanted))
        .withColumnsRenamed({"Asg_CrsId": "Q_CrsId", "type": "Q_Type"})
        .where(F.col("n") > 0)
        .withColumn(
            "draw_seed", F.concat_ws("-", F.lit(str(seed)), F.col("req_id").cast("string"), F.col("Q_Type"))
        )
    )
    drawn = draw_questions(draws, tables["Question"], ["Q_CrsId", "Q_Type"], "Q_Id")
    rows = drawn.select(
        F.col("Exm_Id").alias("EQ_ExmId"), F.col("Q_Id").alias("EQ_QId"), F.col("degree").cast(DEGREE).alias("EQ_Degree")
    )
    counts = exams.select(
        F.col("Exm_Id").alias("EQ_ExmId"), sum((F.col(c) for c in COUNTS.values()), F.lit(0)).alias("n")
    )
    questions = append_with_ids(tables["ExamQuestion"], rows, "EQ_Id", "EQ_ExmId", ["EQ_QId"], counts)
    return NewExams(exams, conform(questions, "ExamQuestion"), outcome.rejected)


MANUAL_CODES = ["50100", "50101", "50102", "I-15", "I-11", "I-14", "I-2", "I-12"]


def judge_manual_exams(requests: DataFrame, lists: DataFrame, tables: Tables) -> DataFrame:
    """``requests(req_id, <exam columns>)`` and ``lists(req_id, QId, degree)`` with ``error_code``.

    Whatever a rule needs to know about a list is summed up per request before the two meet;
    a list that names one question twice is found by counting (request, question) pairs.
    The list's own columns are required, so a gap there comes before all else.
    """
    course_of = tables["Question"].select("Q_Id", "Q_CrsId")
    pairs = lists.groupBy("req_id", "QId").agg(
        F.sum("degree").alias("total"), F.min("degree").alias("least"), F.count("*").alias("n"),
        F.count_if(F.col("degree").isNull()).alias("gaps"),
    )
    summary = (
        pairs.join(course_of, F.col("QId") == F.col("Q_Id"), "left")
        .groupBy(F.col("req_id").alias("_req"))
        .agg(
            F.sum("total").alias("total"),
            F.min("least").alias("least"),
            F.max("n").alias("most"),
            F.sum("n").alias("n_listed"),
            F.sum(F.col("gaps") + F.when(F.col("QId").isNull(), 1).otherwise(0)).alias("gaps"),
            F.bool_or(F.col("Q_Id").isNull()).alias("unknown"),
            F.min("Q_CrsId").alias("low"),
            F.max("Q_CrsId").alias("high"),
        )
    )
    joined = _with_course(requests, tables).join(summary, F.col("req_id") == F.col("_req"), "left")
    joined, header = _header_rules(joined, tables)
    foreign = F.col("unknown") | (F.col("low") != F.col("Asg_CrsId")) | (F.col("high") != F.col("Asg_CrsId"))
    rules = [
        ("I-15", F.col("gaps") > 0),
        ("50100", F.col("Asg_CrsId").isNull()),
        ("50101", F.col("total") > F.col("Crs_MaxDeg")),
        ("50102", foreign),
        *header,
        ("I-11", F.col("least") <= 0),
        ("I-12", F.col("most") > 1),
    ]
    judged = judge(joined, rules).withColumn("n_listed", F.coalesce("n_listed", F.lit(0)))
    return judged.select(*requests.columns, "n_listed", ERROR)


def create_manual_exams(requests: DataFrame, lists: DataFrame, tables: Tables) -> NewExams:
    """Exams with the questions their requests list; an empty list makes an empty exam."""
    outcome = split(judge_manual_exams(requests, lists, tables), MANUAL_CODES)
    exams = stage(append_with_ids(tables["Exam"], outcome.accepted, "Exm_Id", "req_id"), "exams")
    rows = lists.join(exams.select("req_id", "Exm_Id"), "req_id").select(
        F.col("Exm_Id").alias("EQ_ExmId"), F.col("QId").alias("EQ_QId"), F.col("degree").cast(DEGREE).alias("EQ_Degree")
    )
    counts = exams.select(F.col("Exm_Id").alias("EQ_ExmId"), F.col("n_listed").alias("n"))
    questions = append_with_ids(tables["ExamQuestion"], rows, "EQ_Id", "EQ_ExmId", ["EQ_QId"], counts)
    return NewExams(exams, conform(questions, "ExamQuestion"), outcome.rejected)


# -- seats ------------------------------------------------------------------------------

SEAT_CODES = ["50200", "50201", "50202", "50203", "I-15", "I-12"]


class NewSeats(NamedTuple):
    seats: DataFrame
    rejected: DataFrame


def first_per_key(
    judged: DataFrame, keys: Iterable[str], held: DataFrame | None = None, owner: str = "req_id"
) -> DataFrame:
    """Reject (I-12) each request still in the race that is not the first for its key, or
    whose key is in ``held``, a table with the columns ``keys``.

    The winners are the least ``owner`` per key, combined before the exchange; one per key
    is left to compare with ``held``, and it meets the requests again on the unique
    ``req_id``.  So one key may hold any share of the requests.
    """
    keys = list(keys)
    winners = judged.where(F.col(ERROR).isNull()).groupBy(*keys).agg(F.min(owner).alias("_winner"))
    if held is not None:
        taken = held.select(*[F.col(k).alias(f"_held_{k}") for k in keys])
        winners = winners.join(taken, [F.col(k) == F.col(f"_held_{k}") for k in keys], "left_anti")
    marked = judged.join(winners.select("_winner"), F.col(owner) == F.col("_winner"), "left")
    late = F.col(ERROR).isNull() & F.col("_winner").isNull()
    return marked.withColumn(ERROR, F.when(late, "I-12").otherwise(F.col(ERROR))).drop("_winner")


def judge_seats(requests: DataFrame, tables: Tables) -> DataFrame:
    """``requests(req_id, SE_ExmId, SE_StId, SE_Date, SE_Start, SE_End)`` with ``error_code``."""
    exams = tables["Exam"].select("Exm_Id", "Exm_IntId", "Exm_BrId", "Exm_TrkId", "Exm_Start", "Exm_End")
    students = tables["Student"].select("St_Id", "St_IntId", "St_BrId", "St_TrkId")
    joined = requests.join(exams, F.col("SE_ExmId") == F.col("Exm_Id"), "left").join(
        students, F.col("SE_StId") == F.col("St_Id"), "left"
    )
    belongs = (
        (F.col("St_IntId") == F.col("Exm_IntId"))
        & (F.col("St_BrId") == F.col("Exm_BrId"))
        & (F.col("St_TrkId") == F.col("Exm_TrkId"))
    )
    start, end = F.col("SE_Start"), F.col("SE_End")
    outside = (
        (F.col("Exm_Start").cast("date") != F.col("SE_Date"))
        | (start < micros_of_day(F.col("Exm_Start")))
        | (end > micros_of_day(F.col("Exm_End")))
    )
    rules = [
        ("50200", F.col("Exm_Start").isNull()),
        ("50201", ~F.coalesce(belongs, F.lit(False))),
        ("50202", end <= start),
        ("50203", outside),
        violates_required("StudentExam", ["SE_Date", "SE_Start", "SE_End"]),
    ]
    judged = judge(joined, rules).select(*requests.columns, ERROR)
    return first_per_key(stage(judged, "seat-requests"), ["SE_ExmId", "SE_StId"], tables["StudentExam"])


def assign_seats(requests: DataFrame, tables: Tables) -> NewSeats:
    """New seats with ids; of several requests for one student and exam the first wins."""
    outcome = split(judge_seats(requests, tables), SEAT_CODES)
    seats = append_with_ids(tables["StudentExam"], outcome.accepted, "SE_Id", "req_id")
    return NewSeats(seats, outcome.rejected)
