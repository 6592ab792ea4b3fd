"""Searches with optional arguments; an argument left out does not filter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invigil.functions.filters import optional_filters, within_days
from invigil.functions.text import like_anywhere, text_key
from invigil.sources.ranges import EXAM_DAY
from invigil.sources.tables import Tables


def _equals(column: str):
    return lambda value: F.col(column) == F.lit(value)


def _same_text(column: str, ci: bool):
    def predicate(value: str) -> Column:
        return text_key(F.col(column), ci) == text_key(F.lit(value), ci)

    return predicate


def search_students(
    tables: Tables,
    name: str | None = None,
    branch: int | None = None,
    track: int | None = None,
    intake: int | None = None,
    ci: bool = False,
) -> DataFrame:
    students = optional_filters(
        tables["Student"],
        (name, lambda part: like_anywhere(F.col("St_Name"), part, ci)),
        (branch, _equals("St_BrId")),
        (track, _equals("St_TrkId")),
        (intake, _equals("St_IntId")),
    )
    return (
        students.join(tables["Branch"], F.col("St_BrId") == F.col("Br_Id"))
        .join(tables["Track"], F.col("St_TrkId") == F.col("Trk_Id"))
        .join(tables["Intake"], F.col("St_IntId") == F.col("Int_Id"))
        .select("St_Id", "St_Name", "St_Email", "St_Phone", "Br_Name", "Trk_Name", "Int_Name")
    )


def search_exams(
    tables: Tables,
    course: int | None = None,
    branch: int | None = None,
    track: int | None = None,
    exam_type: str | None = None,
    from_date: dt.date | None = None,
    to_date: dt.date | None = None,
    ci: bool = False,
) -> DataFrame:
    """Exams whose start falls on a day from ``from_date`` to ``to_date``, both included."""
    exams = optional_filters(
        tables["Exam"],
        (branch, _equals("Exm_BrId")),
        (track, _equals("Exm_TrkId")),
        (exam_type, _same_text("Exm_Type", ci)),
    )
    exams = within_days(exams, "Exm_Start", from_date, to_date, EXAM_DAY["Exam"])
    assignments = optional_filters(tables["CourseAssignment"], (course, _equals("Asg_CrsId")))
    return (
        exams.join(assignments, F.col("Exm_AsgId") == F.col("Asg_Id"))
        .join(tables["Course"], F.col("Asg_CrsId") == F.col("Crs_Id"))
        .join(tables["Branch"], F.col("Exm_BrId") == F.col("Br_Id"))
        .join(tables["Track"], F.col("Exm_TrkId") == F.col("Trk_Id"))
        .select(
            "Exm_Id", "Crs_Name", "Exm_Type", "Br_Name", "Trk_Name", "Exm_Start", "Exm_End", "Exm_TotalTime"
        )
    )


def search_questions(
    tables: Tables,
    course: int | None = None,
    question_type: str | None = None,
    created_by: int | None = None,
    ci: bool = False,
) -> DataFrame:
    questions = optional_filters(
        tables["Question"],
        (course, _equals("Q_CrsId")),
        (question_type, _same_text("Q_Type", ci)),
        (created_by, _equals("Q_CreatedBy")),
    )
    return (
        questions.join(tables["Course"], F.col("Q_CrsId") == F.col("Crs_Id"))
        .join(tables["Instructor"], F.col("Q_CreatedBy") == F.col("Ins_Id"))
        .select("Q_Id", "Crs_Name", "Q_Type", "Q_Text", "Ins_Name")
    )
