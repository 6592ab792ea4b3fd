"""Rows that a change of another table leaves behind."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import D, frame
from invigil.operators import stale
from invigil.operators.audits import AUDITS
from invigil.schema import TABLES


def found(df):
    return sorted((r.rule, r.key) for r in df.collect())


#: A change of each parent, as SQL on its watched column, or None: rows go.
CHANGES = {
    "Track": [("Trk_BrId", "CASE WHEN Trk_Id < 3 THEN Trk_BrId % 3 + 1 ELSE Trk_BrId END")],
    "Student": [("St_IntId", "3 - St_IntId"), ("St_BrId", "CASE WHEN St_Id = 1 THEN 3 ELSE St_BrId END")],
    "Exam": [("Exm_BrId", "Exm_BrId + 1"), ("Exm_AsgId", "CASE WHEN Exm_Id = 1 THEN 2 ELSE Exm_AsgId END")],
    "Course": [("Crs_MaxDeg", "CASE WHEN Crs_Id = 1 THEN 60 ELSE Crs_MaxDeg END")],
    "CourseAssignment": [("Asg_CrsId", "CASE WHEN Asg_Id = 1 THEN 3 ELSE Asg_CrsId END"), (None, "Asg_Id <> 2"), (None, "Asg_Id > 3")],
    "Question": [("Q_Type", "CASE Q_Type WHEN 'MCQ' THEN 'Text' WHEN 'TF' THEN 'MCQ' ELSE 'TF' END"), ("Q_CrsId", "CASE WHEN Q_Id = 2 THEN 3 ELSE Q_CrsId END")],
    "MCQChoice": [("Ch_QId", "CASE WHEN Ch_Id = 2 THEN 6 ELSE Ch_QId END"), (None, "Ch_Id <> 3")],
    "StudentExam": [("SE_ExmId", "3")],
    "ExamQuestion": [(None, "EQ_QId <> 2"), ("EQ_QId", "CASE WHEN EQ_QId = 3 THEN 8 ELSE EQ_QId END")],
}


@pytest.mark.parametrize(("parent", "number"), [(p, i) for p, cases in CHANGES.items() for i in range(len(cases))])
def test_what_rests_on_a_change(spark, seed, parent, number):
    """Every violation that is new is found, and nothing that the audit of whole tables does not find."""
    column, sql = CHANGES[parent][number]
    rows = seed[parent]
    rows = rows.where(sql) if column is None else rows.withColumn(column, F.expr(sql).cast(rows.schema[column].dataType))
    after = {**seed, parent: rows}
    rules = {path.rule for path in stale.PATHS if path.parent == parent}
    now, before = ({v for rule in rules for v in found(AUDITS[rule](tables))} for tables in (after, seed))
    left_behind = found(stale.stale(seed, after, parent))
    assert len(left_behind) == len(set(left_behind))
    assert now - before <= set(left_behind) <= now


def test_something_is_left_behind(spark, seed):
    lower = frame(spark, "Course", [(1, "Baking", None, D(60), D(45)), (2, "Sailing", None, D(60), D(30)), (3, "Weaving", None, D(40), D(20))])
    assert found(stale.stale(seed, {**seed, "Course": lower}, "Course")) == [("I-5", 1)]
    none = seed["CourseAssignment"].where("Asg_Id <> 2")
    assert found(stale.stale(seed, {**seed, "CourseAssignment": none}, "CourseAssignment", ["I-6"])) == [("I-6", 5), ("I-6", 6)]


def test_an_unchanged_table_leaves_nothing_behind(seed):
    for parent in CHANGES:
        assert stale.stale(seed, seed, parent).collect() == []


def test_every_column_that_a_rule_reads_is_watched():
    for path in stale.PATHS:
        assert set(path.watched) <= set(TABLES[path.parent].names)
        assert path.steps[0].child != path.parent


def test_a_table_that_nothing_rests_on(seed):
    with pytest.raises(ValueError):
        stale.stale(seed, seed, "Admin")
