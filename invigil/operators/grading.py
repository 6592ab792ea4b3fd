"""Grading all seats at once, and applying reviewers' marks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invigil.functions.rules import ERROR, Outcome, judge, split, with_messages
from invigil.functions.text import comparable_answer
from invigil.operators.constraints import require_keys
from invigil.schema import DEGREE
from invigil.session import stage
from invigil.sources.tables import Tables, replace, update_from_join


class Graded(NamedTuple):
    answers: DataFrame
    results: DataFrame
    rejected: DataFrame


def exam_key(tables: Tables) -> DataFrame:
    """Per exam question: its degree and the key of its true/false or text subtype.

    Small next to the answers, so the subtypes and the canonical best answer are settled
    here once instead of once per answer.
    """
    tf = tables["TFQuestion"].select("TF_QId", "TF_Correct")
    text = tables["TextQuestion"].select("Txt_QId", comparable_answer(F.col("Txt_BestAnswer")).alias("best"))
    return (
        tables["ExamQuestion"]
        .select("EQ_ExmId", "EQ_QId", "EQ_Degree")
        .join(tf, F.col("EQ_QId") == F.col("TF_QId"), "left")
        .join(text, F.col("EQ_QId") == F.col("Txt_QId"), "left")
    )


def _with_keys(answers: DataFrame, tables: Tables) -> DataFrame:
    """``answers`` (with their seat's ``SE_ExmId``) beside whatever is needed to grade them."""
    choices = tables["MCQChoice"].select("Ch_Id", "Ch_Correct")
    on_exam = (F.col("SE_ExmId") == F.col("EQ_ExmId")) & (F.col("Ans_QId") == F.col("EQ_QId"))
    # An answer without a choice can match none: spread those rows over all partitions
    # instead of sending every NULL to the same one.
    spread = F.coalesce("Ans_ChoiceId", F.xxhash64("Ans_SEId", "Ans_QId"))
    on_choice = (spread == F.col("Ch_Id")) & F.col("Ans_ChoiceId").isNotNull()
    # Texts are compared where they meet, so that the verdict goes to the choices and not two texts.
    said = answers.join(exam_key(tables), on_exam, "left").withColumn("said", _said())
    return said.join(choices, on_choice, "left")


def _said() -> Column:
    """The verdict by text or true/false; NULL where it is left to a choice.

    Text decides over true/false.  Blank answers are wrong.
    """
    on_exam = F.col("EQ_QId").isNotNull()
    text_right = F.coalesce(comparable_answer(F.col("Ans_TextAns")) == F.col("best"), F.lit(False))
    tf_right = F.coalesce(F.col("TF_Correct") == F.col("Ans_BoolAns"), F.lit(False))
    return F.when(on_exam & F.col("Txt_QId").isNotNull(), text_right).when(on_exam & F.col("TF_QId").isNotNull(), tf_right)


def _graded(keyed: DataFrame) -> DataFrame:
    """``keyed`` plus ``right``: the verdict on an answer, NULL where it is not graded.

    An answer is graded by every subtype its question has; text and true/false decide over a
    choice.  A blank or unknown choice is left as it was, and so is an answer that is not on the exam.
    """
    by_choice = F.col("EQ_QId").isNotNull() & F.col("Ch_Id").isNotNull()
    right = F.coalesce(F.col("said"), F.when(by_choice, F.coalesce(F.col("Ch_Correct"), F.lit(False))))
    return keyed.withColumn("right", right)


def _correct() -> Column:
    return F.coalesce("right", "Ans_Correct")


def _degree() -> Column:
    won = F.when(F.col("right"), F.col("EQ_Degree")).when(~F.col("right"), F.lit(0).cast(DEGREE))
    return won.otherwise(F.col("Ans_Degree")).cast(DEGREE)


def grade_answers(tables: Tables) -> DataFrame:
    """The answer table with ``Ans_Correct`` and ``Ans_Degree`` set for every seat."""
    answers = tables["StudentAnswer"]
    seats = tables["StudentExam"].select("SE_Id", "SE_ExmId")
    keyed = _with_keys(answers.join(seats, F.col("Ans_SEId") == F.col("SE_Id"), "left"), tables)
    new = {"Ans_Correct": _correct(), "Ans_Degree": _degree()}
    return _graded(keyed).select(*[new.get(c, F.col(c)).alias(c) for c in answers.columns])


def seat_totals(tables: Tables, graded: DataFrame | None = None) -> DataFrame:
    """``(SE_Id, total)`` of every seat, 0 without answers; degrees as grading sets them.

    Seats lead the join, so each side is exchanged once on the seat and the sum finds its
    rows in place.  Where ``graded``, all answers as ``grade_answers`` leaves them, is at hand, its
    degrees are summed up and nothing is graded again.
    """
    if graded is not None:
        seats = tables["StudentExam"].select("SE_Id").distinct()
        sums = graded.groupBy(F.col("Ans_SEId").alias("_seat")).agg(_total("Ans_Degree").alias("total"))
        found = seats.join(sums, F.col("SE_Id") == F.col("_seat"), "left")
        return found.select("SE_Id", F.coalesce("total", F.lit(0)).alias("total"))
    seats = tables["StudentExam"].select("SE_Id", "SE_ExmId")
    keyed = _with_keys(seats.join(tables["StudentAnswer"], F.col("SE_Id") == F.col("Ans_SEId"), "left"), tables)
    return _graded(keyed).select("SE_Id", _degree().alias("d")).groupBy("SE_Id").agg(_total("d").alias("total"))


def _total(degree: str) -> Column:
    return F.coalesce(F.sum(degree), F.lit(0))


def final_results(tables: Tables, graded: DataFrame | None = None) -> DataFrame:
    """``(SE_Id, FinalResult)`` of every seat, none left out.

    NULL stands for a total that does not fit the result column; ``overflowing_seats`` names
    those seats.  ``graded`` as for ``seat_totals``.
    """
    return _results(seat_totals(tables, graded))


def _results(totals: DataFrame) -> DataFrame:
    return totals.select("SE_Id", F.col("total").try_cast(DEGREE).alias("FinalResult"))


def overflowing_seats(totals: DataFrame) -> DataFrame:
    """``(req_id, error_code, error_message)`` of the seats whose total does not fit."""
    too_big = totals.where(F.col("total").try_cast(DEGREE).isNull())
    seats = too_big.select(F.col("SE_Id").cast("string").alias("req_id"), F.lit("OVERFLOW").alias(ERROR))
    return with_messages(seats, ["OVERFLOW"])


#: Keys that grading joins and sums by: one that occurs twice would count degrees twice.
GRADED_BY = {
    "ExamQuestion": [("EQ_ExmId", "EQ_QId")],
    "TFQuestion": [("TF_QId",)],
    "TextQuestion": [("Txt_QId",)],
    "MCQChoice": [("Ch_Id",)],
    "StudentExam": [("SE_Id",)],
    "StudentAnswer": [("Ans_SEId", "Ans_QId")],
}


def grade_seats(tables: Tables, requests: DataFrame | None = None) -> Graded:
    """Grade every seat, or the seats named by ``requests(req_id, SE_Id)``.

    A request for an unknown seat is rejected with 50300.  A total beyond the result
    column rejects that seat alone.  Raises if a key that grading joins on occurs twice.
    Graded answers are written once; totals and results are sums over them.
    """
    require_keys(tables, GRADED_BY)
    scope = tables
    rejected = None
    if requests is not None:
        known = tables["StudentExam"].select(F.col("SE_Id").alias("_seat"))
        asked = requests.join(known, F.col("SE_Id") == F.col("_seat"), "left")
        judged = judge(asked, [("50300", F.col("_seat").isNull())])
        rejected = split(judged, ["50300"]).rejected.withColumn("req_id", F.col("req_id").cast("string"))
        wanted = requests.select("SE_Id").distinct()
        answers = tables["StudentAnswer"]
        scope = replace(
            tables,
            StudentExam=tables["StudentExam"].join(wanted, "SE_Id", "left_semi"),
            StudentAnswer=answers.join(wanted, F.col("Ans_SEId") == F.col("SE_Id"), "left_semi"),
        )
    graded = stage(grade_answers(scope), "graded")
    sums = graded.groupBy(F.col("Ans_SEId").alias("_seat")).agg(_total("Ans_Degree").alias("total"))
    seats = scope["StudentExam"].select("SE_Id").join(sums, F.col("SE_Id") == F.col("_seat"), "left")
    totals = stage(seats.select("SE_Id", F.coalesce("total", F.lit(0)).alias("total")), "totals")
    too_big = overflowing_seats(totals)
    rejected = too_big if rejected is None else rejected.unionByName(too_big)
    return Graded(graded, _results(totals).where(F.col("FinalResult").isNotNull()), rejected)


def store_results(seats: DataFrame, results: DataFrame) -> DataFrame:
    """The seat table with ``SE_Result`` taken from ``results(SE_Id, FinalResult)``."""
    changes = results.select("SE_Id", F.col("FinalResult").alias("SE_Result"))
    return update_from_join(seats, changes, ["SE_Id"], ["SE_Result"])


# -- reviewers' marks -------------------------------------------------------------------


class Marked(NamedTuple):
    answers: DataFrame
    seats: DataFrame
    outcome: Outcome


MARK_CODES = ["50400", "50401", "I-15", "OVERFLOW"]


def judge_marks(marks: DataFrame, tables: Tables) -> DataFrame:
    """``marks(req_id, Ans_Id, degree, comment)`` with ``error_code`` and the answer's limits."""
    # Lookups are cut to what the batch names, so that a small batch meets small tables.
    asked = marks.select(F.col("Ans_Id").alias("_asked")).distinct()
    answers = tables["StudentAnswer"].select(F.col("Ans_Id").alias("_ans"), "Ans_SEId", "Ans_QId")
    answers = answers.join(asked, F.col("_ans") == F.col("_asked"), "left_semi")
    seats = tables["StudentExam"].select("SE_Id", "SE_ExmId")
    questions = tables["ExamQuestion"].select("EQ_ExmId", "EQ_QId", "EQ_Degree")
    on_exam = (F.col("SE_ExmId") == F.col("EQ_ExmId")) & (F.col("Ans_QId") == F.col("EQ_QId"))
    found = (
        marks.join(answers, F.col("Ans_Id") == F.col("_ans"), "left")
        .join(seats, F.col("Ans_SEId") == F.col("SE_Id"), "left")
        .join(questions, on_exam, "left")
    )
    degree = F.col("degree")
    return judge(
        found,
        [
            ("50400", F.col("EQ_QId").isNull()),
            ("50401", (degree < 0) | (degree > F.col("EQ_Degree"))),
            ("I-15", F.coalesce(F.length("comment") > 500, F.lit(False))),
        ],
    ).select("req_id", "Ans_Id", "degree", "comment", "Ans_SEId", "EQ_Degree", ERROR)


def mark_answers(marks: DataFrame, tables: Tables) -> Marked:
    """Store reviewers' marks and recompute the results of the seats they touch.

    Of several marks for one answer the last by ``req_id`` counts.  A missing degree is
    neither below 0 nor above the limit: it is stored, and the answer is open again.
    """
    judged = stage(judge_marks(marks, tables), "marks")
    last = (
        judged.where(F.col(ERROR).isNull())
        .groupBy("Ans_SEId", "Ans_Id")
        .agg(F.max(F.struct("req_id", "degree", "comment", "EQ_Degree")).alias("m"))
        .select("Ans_SEId", "Ans_Id", "m.*")
    )
    full, none = F.col("degree") == F.col("EQ_Degree"), F.col("degree") == 0
    changes = last.select(
        "Ans_SEId",
        "Ans_Id",
        F.col("degree").cast(DEGREE).alias("Ans_Degree"),
        F.when(full, True).when(none, False).alias("Ans_Correct"),
        F.col("comment").alias("Ans_Comment"),
    )
    changes = stage(changes, "mark-changes")

    # The answers of touched seats first: on their bucket column that needs no exchange of theirs.
    touched = changes.select(F.col("Ans_SEId").alias("_touched")).distinct()
    own = tables["StudentAnswer"].select(*MARK_KEYS, "Ans_Degree")
    own = own.join(touched, F.col("Ans_SEId") == F.col("_touched"), "left_semi")
    sums = update_from_join(own, changes, MARK_KEYS, ["Ans_Degree"]).groupBy("Ans_SEId").agg(_total("Ans_Degree").alias("total"))
    sums = stage(sums.select(F.col("Ans_SEId").alias("SE_Id"), F.col("total").try_cast(DEGREE).alias("FinalResult")), "mark-sums")

    # A seat whose total does not fit keeps its answers; its marks are refused.
    over = sums.where(F.col("FinalResult").isNull()).select(F.col("SE_Id").alias("_over"))
    judged = judged.join(over, F.col("Ans_SEId") == F.col("_over"), "left")
    refused = F.when(F.col(ERROR).isNull() & F.col("_over").isNotNull(), "OVERFLOW").otherwise(F.col(ERROR))
    outcome = split(judged.withColumn(ERROR, refused).drop("_over"), MARK_CODES)
    changes = changes.join(over, F.col("Ans_SEId") == F.col("_over"), "left_anti")
    answers = update_from_join(
        tables["StudentAnswer"], changes, MARK_KEYS, ["Ans_Degree", "Ans_Correct", "Ans_Comment"]
    )
    results = sums.where(F.col("FinalResult").isNotNull())
    return Marked(answers, store_results(tables["StudentExam"], results), outcome)


MARK_KEYS = ["Ans_SEId", "Ans_Id"]
