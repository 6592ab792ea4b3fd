"""Cross-table integrity rules, over a whole table or over the rows of one batch.

A rule looks at its *subject* rows, by default the whole table.  To audit a batch, apply
it to the tables first and pass the batch's rows as ``subject``: the same code then gives
what a check at the time of the change would have given.  Every rule returns
``(rule, key, message)`` with the key of the violating row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invigil.functions.clock import micros_of_day
from invigil.functions.rules import first_failing_rule, message_of
from invigil.messages import RULES, message
from invigil.schema import MCQ, TEXT, TF
from invigil.sources.tables import Tables

Audit = Callable[[Tables, DataFrame | None], DataFrame]

AUDITS: dict[str, Audit] = {}
# Which table a rule watches.
SUBJECT: dict[str, str] = {}


def _audit(rule: str, table: str):
    def add(function):
        def run(tables: Tables, subject: DataFrame | None = None) -> DataFrame:
            return function(tables, tables[table] if subject is None else subject)

        AUDITS[rule], SUBJECT[rule] = run, table
        run.__doc__, run.__name__ = function.__doc__, function.__name__
        return run

    return add


def _found(rows: DataFrame, rule: str, key: str) -> DataFrame:
    return rows.select(
        F.lit(rule).alias("rule"), F.col(key).cast("long").alias("key"), F.lit(message(rule)).alias("message")
    )


@_audit("I-1", "Student")
def student_track_branch(tables: Tables, subject: DataFrame) -> DataFrame:
    """The student's track belongs to another branch."""
    joined = subject.join(tables["Track"], F.col("St_TrkId") == F.col("Trk_Id"))
    return _found(joined.where(F.col("Trk_BrId") != F.col("St_BrId")), "I-1", "St_Id")


@_audit("I-2", "Exam")
def exam_track_branch(tables: Tables, subject: DataFrame) -> DataFrame:
    """The exam's track belongs to another branch."""
    joined = subject.join(tables["Track"], F.col("Exm_TrkId") == F.col("Trk_Id"))
    return _found(joined.where(F.col("Trk_BrId") != F.col("Exm_BrId")), "I-2", "Exm_Id")


@_audit("I-3", "StudentExam")
def seat_student(tables: Tables, subject: DataFrame) -> DataFrame:
    """The student's intake, branch or track is not the exam's."""
    joined = subject.join(tables["Exam"], F.col("SE_ExmId") == F.col("Exm_Id")).join(
        tables["Student"], F.col("SE_StId") == F.col("St_Id")
    )
    differs = (
        (F.col("St_IntId") != F.col("Exm_IntId"))
        | (F.col("St_BrId") != F.col("Exm_BrId"))
        | (F.col("St_TrkId") != F.col("Exm_TrkId"))
    )
    return _found(joined.where(differs), "I-3", "SE_Id")


def _exam_course(tables: Tables) -> DataFrame:
    return (
        tables["Exam"]
        .join(tables["CourseAssignment"], F.col("Exm_AsgId") == F.col("Asg_Id"))
        .select("Exm_Id", "Asg_CrsId")
    )


@_audit("I-4", "ExamQuestion")
def exam_question_course(tables: Tables, subject: DataFrame) -> DataFrame:
    """The question belongs to another course than the exam."""
    joined = subject.join(_exam_course(tables), F.col("EQ_ExmId") == F.col("Exm_Id")).join(
        tables["Question"], F.col("EQ_QId") == F.col("Q_Id")
    )
    return _found(joined.where(F.col("Q_CrsId") != F.col("Asg_CrsId")), "I-4", "EQ_Id")


@_audit("I-5", "ExamQuestion")
def exam_max_degree(tables: Tables, subject: DataFrame) -> DataFrame:
    """The degrees of a touched exam add up to more than its course allows; key is the exam.

    ``subject`` names the touched exams by ``EQ_ExmId``: pass inserted and deleted rows
    together.
    """
    questions = tables["ExamQuestion"]
    if subject is not questions:
        questions = questions.join(subject.select("EQ_ExmId").distinct(), "EQ_ExmId", "left_semi")
    totals = questions.groupBy("EQ_ExmId").agg(F.sum("EQ_Degree").alias("total"))
    joined = totals.join(_exam_course(tables), F.col("EQ_ExmId") == F.col("Exm_Id")).join(
        tables["Course"], F.col("Asg_CrsId") == F.col("Crs_Id")
    )
    return _found(joined.where(F.col("total") > F.col("Crs_MaxDeg")), "I-5", "Exm_Id")


def touched_exams(inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The exams whose questions a batch adds or takes away, each once."""
    return inserted.select("EQ_ExmId").union(deleted.select("EQ_ExmId")).distinct()


def exams_without_window(tables: Tables) -> DataFrame:
    """Exams no seat fits into: windows compare times of day, so one that runs past midnight
    ends before it starts."""
    exams = tables["Exam"]
    return exams.where(micros_of_day(F.col("Exm_Start")) >= micros_of_day(F.col("Exm_End"))).select("Exm_Id")


@_audit("I-6", "Question")
def question_author(tables: Tables, subject: DataFrame) -> DataFrame:
    """The author was never assigned to the question's course."""
    assigned = tables["CourseAssignment"].select("Asg_CrsId", "Asg_InsId")
    mine = (F.col("Q_CrsId") == F.col("Asg_CrsId")) & (F.col("Q_CreatedBy") == F.col("Asg_InsId"))
    return _found(subject.join(assigned, mine, "left_anti"), "I-6", "Q_Id")


def _wrong_type(tables: Tables, subject: DataFrame, rule: str, question: str, key: str, kind: str) -> DataFrame:
    joined = subject.join(tables["Question"], F.col(question) == F.col("Q_Id"))
    return _found(joined.where(F.col("Q_Type") != kind), rule, key)


@_audit("I-7", "TFQuestion")
def tf_type(tables: Tables, subject: DataFrame) -> DataFrame:
    """A true/false key on a question of another type."""
    return _wrong_type(tables, subject, "I-7", "TF_QId", "TF_QId", TF)


@_audit("I-8", "TextQuestion")
def text_type(tables: Tables, subject: DataFrame) -> DataFrame:
    """A best answer on a question of another type."""
    return _wrong_type(tables, subject, "I-8", "Txt_QId", "Txt_QId", TEXT)


@_audit("I-9", "MCQChoice")
def choice_type(tables: Tables, subject: DataFrame) -> DataFrame:
    """A choice on a question of another type."""
    return _wrong_type(tables, subject, "I-9", "Ch_QId", "Ch_Id", MCQ)


ANSWER_CODES = ["I-10a", "I-10b", "I-10c"]


def answer_rules(tables: Tables, answers: DataFrame, seat_known: bool = False) -> tuple[DataFrame, list]:
    """``answers`` beside what the answer rules look at, and the rules in order.

    Columns of ``answers`` are left alone; ``seat_known`` says that it has the seat's
    ``SE_Id`` and ``SE_ExmId`` already.  The looked-up tables have unique keys (I-12) and go
    straight into their joins, which lets Spark split the partition of a hot key.  An answer without a choice can match none, so
    those rows are spread by their own key instead of meeting in one partition.  Answers are exchanged by choice and
    then by question, where they find both its type and the paper; a hot question alone costs a further exchange, by paper.
    """
    if not seat_known:
        seats = tables["StudentExam"].select("SE_Id", "SE_ExmId")
        answers = answers.join(seats, F.col("Ans_SEId") == F.col("SE_Id"), "left")
    on_paper = tables["ExamQuestion"].select("EQ_ExmId", "EQ_QId")
    types = tables["Question"].select("Q_Id", "Q_Type")
    choices = tables["MCQChoice"].select("Ch_Id", "Ch_QId")
    spread = F.coalesce("Ans_ChoiceId", F.xxhash64("Ans_SEId", "Ans_QId"))
    picked = answers.join(choices, (spread == F.col("Ch_Id")) & F.col("Ans_ChoiceId").isNotNull(), "left")
    picked = picked.withColumn("choice_known", F.col("Ch_Id").isNotNull()).withColumn("choice_elsewhere", F.col("Ch_QId") != F.col("Ans_QId"))
    joined = (
        picked.drop("Ch_Id", "Ch_QId")
        .join(types, F.col("Ans_QId") == F.col("Q_Id"), "left")
        .join(on_paper, (F.col("SE_ExmId") == F.col("EQ_ExmId")) & (F.col("Ans_QId") == F.col("EQ_QId")), "left")
    )
    foreign = ~F.col("choice_known") | F.col("choice_elsewhere")
    choice, boolean, text = (F.col(c).isNotNull() for c in ("Ans_ChoiceId", "Ans_BoolAns", "Ans_TextAns"))
    kind = F.col("Q_Type")
    misfit = (
        ((kind == MCQ) & (boolean | text)) | ((kind == TF) & (choice | text)) | ((kind == TEXT) & (choice | boolean))
    )
    return joined, [
        ("I-10a", F.col("SE_Id").isNotNull() & F.col("EQ_QId").isNull()),
        ("I-10b", (kind == MCQ) & choice & foreign),
        ("I-10c", misfit),
    ]


@_audit("I-10", "StudentAnswer")
def answer_fits(tables: Tables, subject: DataFrame) -> DataFrame:
    """The answer is off the exam, picks a foreign choice, or fills the wrong column."""
    joined, rules = answer_rules(tables, subject)
    return (
        joined.select(first_failing_rule(rules).alias("rule"), F.col("Ans_Id").alias("key"))
        .where(F.col("rule").isNotNull())
        .select("rule", "key", message_of(F.col("rule"), ANSWER_CODES).alias("message"))
    )


def run_audits(tables: Tables, rules: Iterable[str] | None = None) -> DataFrame:
    """All violations of the given rules over whole tables."""
    found = None
    for rule in rules or AUDITS:
        part = AUDITS[rule](tables)
        found = part if found is None else found.unionByName(part)
    return found


def batch_verdict(violations: DataFrame) -> DataFrame:
    """One row per rule that a batch breaks: a batch with any row here is refused whole."""
    return violations.groupBy("rule", "message").agg(F.count("*").alias("n_rows"), F.min("key").alias("first_key"))


assert set(AUDITS) <= {r.rstrip("abc") for r in RULES}
