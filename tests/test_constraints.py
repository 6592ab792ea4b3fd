"""Declared constraints: each case adds one row and looks for exactly its violation."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest

from conftest import DAY, SEED, at, frame, moment
from invigil.operators import constraints
from invigil.schema import TABLES


def plus(spark, seed, table, row):
    return {**seed, table: seed[table].unionByName(frame(spark, table, [row]))}


CHECKS = [
    ("Course", (9, "C", None, D(50), D(80)), "Crs_Degrees"),
    ("Course", (9, "C", None, D(100), D(50)), None),
    ("Course", (9, "C", None, None, D(50)), None),  # unknown passes
    ("Exam", (9, 1, "Exam", 1, 1, 1, moment(9), moment(8), 60, None), "Exm_Times"),
    ("Exam", (9, 1, "Exam", 1, 1, 1, moment(9), moment(11), 0, None), "Exm_TotalTime"),
    ("Exam", (9, 1, "Quiz", 1, 1, 1, moment(9), moment(11), 60, None), "Exm_Type"),
    ("Question", (9, 1, "Essay", "q", 1), "Q_Type"),
    ("ExamQuestion", (9, 1, 5, D(0)), "EQ_Degree"),
    ("StudentExam", (9, 2, 3, DAY, at(10), at(9), None), "SE_Times"),
    ("StudentExam", (9, 2, 3, DAY, at(9), at(10), D(-1)), "SE_Result"),
    ("StudentAnswer", (9, 2, 3, None, None, "t", None, D(-5), None), "Ans_Degree"),
    ("StudentAnswer", (9, 2, 3, None, None, "t", None, None, None), None),
]


@pytest.mark.parametrize("table,row,check", CHECKS)
def test_checks(spark, seed, table, row, check):
    found = constraints.check_violations(plus(spark, seed, table, row), [table]).collect()
    assert [(r.table_name, r.key, r.check_name) for r in found] == ([(table, 9, check)] if check else [])


UNIQUE = [
    ("ExamQuestion", (9, 1, 1, D(10)), "EQ_ExmId EQ_QId", "1|1"),
    ("StudentExam", (9, 2, 1, DAY, at(9), at(10), None), "SE_ExmId SE_StId", "2|1"),
    ("StudentAnswer", (9, 2, 2, None, False, None, None, None, None), "Ans_SEId Ans_QId", "2|2"),
    ("Admin", (9, "root", "x"), "Adm_User", "root"),
    ("TrainingManager", (9, "lead", "x"), "Mgr_User", "lead"),
    ("Instructor", (9, "kim", "x", "x@example.org", None), "Ins_User", "kim"),
    ("Instructor", (9, "x", "x", "lou@example.org", None), "Ins_Email", "lou@example.org"),
    ("Branch", (9, "Hill  ", None), "Br_Name", "Hill"),  # blanks at the end do not count
    ("Intake", (9, "July", dt.date(2028, 1, 1)), "Int_Name", "July"),
    ("Course", (9, "Weaving", None, D(5), D(1)), "Crs_Name", "Weaving"),
    ("Track", (9, "Cloth", 3), "Trk_Name Trk_BrId", "Cloth|3"),
    ("Student", (9, "p4", "x", "x@example.org", None, 1, 1, 1), "St_User", "p4"),
    ("Student", (9, "x", "x", "p2@example.org", None, 1, 1, 1), "St_Email", "p2@example.org"),
    ("CourseAssignment", (9, 3, 2, 2027), "Asg_CrsId Asg_Year", "3|2027"),
    ("Question", (1, 1, "TF", "again", 1), "Q_Id", "1"),
]


@pytest.mark.parametrize("table,row,key,value", UNIQUE)
def test_unique(spark, seed, table, row, key, value):
    found = constraints.unique_violations(plus(spark, seed, table, row), [table]).collect()
    assert [(r.key_columns, r.key_value, r.n_rows) for r in found] == [(key, value, 2)]


def test_unique_case_blind_on_request(spark, seed):
    tables = plus(spark, seed, "Branch", (9, "MILL", None))
    assert constraints.unique_violations(tables, ["Branch"]).isEmpty()
    assert constraints.unique_violations(tables, ["Branch"], ci=True).count() == 1


def test_track_name_may_repeat_in_another_branch(spark, seed):
    assert constraints.unique_violations(plus(spark, seed, "Track", (9, "Cloth", 2)), ["Track"]).isEmpty()


def test_one_correct_choice(spark, seed):
    second = plus(spark, seed, "MCQChoice", (9, 2, "spelt", True))
    assert [tuple(r) for r in constraints.correct_choice_violations(second).collect()] == [(2, 2)]
    first = plus(spark, seed, "MCQChoice", (9, 4, "the top", True))
    assert constraints.correct_choice_violations(first).isEmpty()


def test_every_reference_is_checked(spark, seed):
    for table, spec in TABLES.items():
        for column, target in spec.references.items():
            row = list(SEED[table][0])
            row[spec.names.index(column)] = 777
            tables = plus(spark, seed, table, tuple(row))
            found = constraints.reference_violations(tables, [table]).collect()
            assert (table, column, target, 777) in {(r.table_name, r.column_name, r.target, r.value) for r in found}
    assert constraints.reference_violations(seed).isEmpty()  # NULL references among them


def test_values(spark, seed):
    assert constraints.value_violations(seed).isEmpty()
    tables = plus(spark, seed, "Branch", (9, "n" * 101, None))
    assert [(r.key, r.problem) for r in constraints.value_violations(tables, ["Branch"]).collect()] == [(9, "Br_Name is too long")]
    tables = plus(spark, seed, "Intake", (9, None, None))
    found = {r.problem for r in constraints.value_violations(tables, ["Intake"]).collect()}
    assert found == {"Int_Name is missing", "Int_StartDate is missing"}


def test_seed_is_clean(seed):
    assert constraints.check_violations(seed).isEmpty()
    assert constraints.unique_violations(seed).isEmpty()
    constraints.require_unique(seed, ["ExamQuestion", "StudentExam"])


def test_require_unique_raises(spark, seed):
    with pytest.raises(ValueError, match="duplicate key"):
        constraints.require_unique(plus(spark, seed, "ExamQuestion", (9, 1, 1, D(1))), ["ExamQuestion"])


def test_declared_counts():
    assert len(TABLES) == 17
    assert sum(len(t.unique) for t in TABLES.values()) == 14
    assert sum(len(t.references) for t in TABLES.values()) == 22
    assert sum(len(t.checks) for t in TABLES.values()) == 9
