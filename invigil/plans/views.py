"""The five reporting views and the total degree of exams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invigil.functions.filters import within_days
from invigil.schema import TOTAL
from invigil.sources.ranges import EXAM_DAY
from invigil.sources.tables import Tables, replace


def exam_total_degree(tables: Tables) -> DataFrame:
    """``(Exm_Id, TotalDegree)`` of every exam, 0 for an exam without questions."""
    totals = tables["ExamQuestion"].groupBy("EQ_ExmId").agg(F.sum("EQ_Degree").alias("total"))
    return (
        tables["Exam"]
        .select("Exm_Id")
        .join(totals, F.col("Exm_Id") == F.col("EQ_ExmId"), "left")
        .select("Exm_Id", F.coalesce("total", F.lit(0)).cast(TOTAL).alias("TotalDegree"))
    )


def question_pool(tables: Tables) -> DataFrame:
    return (
        tables["Question"]
        .join(tables["Course"], F.col("Q_CrsId") == F.col("Crs_Id"))
        .join(tables["Instructor"], F.col("Q_CreatedBy") == F.col("Ins_Id"))
        .select("Q_Id", "Q_CrsId", "Crs_Name", "Q_Type", "Q_Text", "Q_CreatedBy", "Ins_Name")
    )


def exam_details(tables: Tables, from_date: dt.date | None = None, to_date: dt.date | None = None) -> DataFrame:
    """All exams, or those that start on a day from ``from_date`` to ``to_date``.

    Where exam questions carry their exam's day (``lay_out_exams``), those of other days are not read.
    """
    exams, questions = tables["Exam"], tables["ExamQuestion"]
    if from_date or to_date:
        exams = within_days(exams, "Exm_Start", from_date, to_date, EXAM_DAY["Exam"])
        if (day := EXAM_DAY["ExamQuestion"]) in questions.columns:
            questions = within_days(questions, day, from_date, to_date, day)
        tables = replace(tables, Exam=exams, ExamQuestion=questions)
    totals = exam_total_degree(tables).withColumnRenamed("Exm_Id", "_exam")
    return (
        tables["Exam"]
        .join(tables["CourseAssignment"], F.col("Exm_AsgId") == F.col("Asg_Id"))
        .join(tables["Course"], F.col("Asg_CrsId") == F.col("Crs_Id"))
        .join(tables["Instructor"], F.col("Asg_InsId") == F.col("Ins_Id"))
        .join(tables["Intake"], F.col("Exm_IntId") == F.col("Int_Id"))
        .join(tables["Branch"], F.col("Exm_BrId") == F.col("Br_Id"))
        .join(tables["Track"], F.col("Exm_TrkId") == F.col("Trk_Id"))
        .join(totals, F.col("Exm_Id") == F.col("_exam"))
        .select(
            "Exm_Id", "Exm_Type", "Crs_Name", "Ins_Name", "Exm_IntId", "Int_Name", "Exm_BrId", "Br_Name",
            "Exm_TrkId", "Trk_Name", "Exm_Start", "Exm_End", "Exm_TotalTime", "Exm_Allowance", "TotalDegree",
        )
    )


def student_results(tables: Tables) -> DataFrame:
    return (
        tables["StudentExam"]
        .join(tables["Student"], F.col("SE_StId") == F.col("St_Id"))
        .join(tables["Exam"], F.col("SE_ExmId") == F.col("Exm_Id"))
        .join(tables["CourseAssignment"], F.col("Exm_AsgId") == F.col("Asg_Id"))
        .join(tables["Course"], F.col("Asg_CrsId") == F.col("Crs_Id"))
        .select(
            "SE_Id", "St_Id", "St_Name", "Exm_Id", "Crs_Name", "Exm_Type", "SE_Date", "SE_Start", "SE_End", "SE_Result"
        )
    )


def text_answers_for_review(tables: Tables) -> DataFrame:
    """Text answers beside their best answer.

    The question side is put together first: the answers then meet it, and are cut down to
    text questions, in one join.
    """
    texts = tables["TextQuestion"].join(tables["Question"], F.col("Txt_QId") == F.col("Q_Id"))
    questions = tables["ExamQuestion"].join(texts, F.col("EQ_QId") == F.col("Q_Id"))
    on_exam = (F.col("SE_ExmId") == F.col("EQ_ExmId")) & (F.col("Ans_QId") == F.col("EQ_QId"))
    return (
        tables["StudentAnswer"]
        .join(tables["StudentExam"], F.col("Ans_SEId") == F.col("SE_Id"))
        .join(questions, on_exam)
        .join(tables["Student"], F.col("SE_StId") == F.col("St_Id"))
        .select(
            "Ans_Id", "SE_Id", "St_Id", "St_Name", "Q_Id", "Q_Text", "Ans_TextAns", "Txt_BestAnswer",
            "Ans_Correct", "Ans_Degree", "EQ_Degree", "Ans_Comment",
        )
    )


def exam_questions(tables: Tables) -> DataFrame:
    return (
        tables["ExamQuestion"]
        .join(tables["Question"], F.col("EQ_QId") == F.col("Q_Id"))
        .select("EQ_Id", "EQ_ExmId", "EQ_QId", "Q_Type", "Q_Text", "EQ_Degree")
    )


# Names of the views.
VIEWS = {
    "QuestionPool": question_pool,
    "ExamDetails": exam_details,
    "StudentResults": student_results,
    "TextAnswersForReview": text_answers_for_review,
    "ExamQuestions": exam_questions,
}


def register_views(tables: Tables) -> None:
    """Expose the views to ``spark.sql`` as temp views."""
    for name, view in VIEWS.items():
        view(tables).createOrReplaceTempView(name)
