"""Cross-table rules: a bad row each, and a good one."""

from __future__ import annotations

from decimal import Decimal as D

import pytest

from conftest import DAY, at, frame, moment
from invigil.messages import message
from invigil.operators.audits import AUDITS, SUBJECT, batch_verdict, run_audits

SEAT = (9, 2, 2, DAY, at(13), at(14), None)

CASES = [
    ("I-1", (9, "n", "n", "n@example.org", None, 1, 2, 1), "I-1"),
    ("I-1", (9, "n", "n", "n@example.org", None, 3, 3, 2), None),
    ("I-2", (9, 1, "Exam", 1, 1, 2, moment(9), moment(11), 60, None), "I-2"),
    ("I-2", (9, 1, "Exam", 1, 3, 3, moment(9), moment(11), 60, None), None),
    ("I-3", (9, 2, 3, DAY, at(13), at(14), None), "I-3"),
    ("I-3", SEAT, None),
    ("I-4", (9, 2, 6, D(5)), "I-4"),
    ("I-4", (9, 2, 4, D(10)), None),
    ("I-5", (9, 2, 4, D(64)), "I-5"),
    ("I-5", (9, 2, 4, D("63.50")), None),  # the limit itself is allowed
    ("I-6", (9, 1, "MCQ", "q", 2), "I-6"),
    ("I-6", (9, 3, "MCQ", "q", 3), None),
    ("I-7", (2, True), "I-7"),
    ("I-8", (2, "best"), "I-8"),
    ("I-9", (9, 3, "c", False), "I-9"),
    ("I-10", (9, 2, 4, None, None, "off the exam", None, None, None), "I-10a"),
    ("I-10", (9, 2, 2, 4, None, None, None, None, None), "I-10b"),
    ("I-10", (9, 2, 2, 2, None, "text on a choice", None, None, None), "I-10c"),
    ("I-10", (9, 2, 1, None, True, None, None, None, None), "I-10c"),
    ("I-10", (9, 2, 2, 5, True, None, None, None, None), "I-10b"),  # the first hit decides
    ("I-10", (9, 2, 2, 1, None, None, None, None, None), None),
    ("I-10", (9, 2, 7, None, None, None, None, None, None), None),
]


@pytest.mark.parametrize("rule,row,expected", CASES)
def test_rule_on_batch_and_table(spark, seed, rule, row, expected):
    table = SUBJECT[rule]
    batch = frame(spark, table, [row])
    after = {**seed, table: seed[table].unionByName(batch)}
    found = [(r.rule, r.message) for r in AUDITS[rule](after, batch).collect()]
    assert found == ([(expected, message(expected))] if expected else [])
    everything = {tuple(r) for r in AUDITS[rule](after, None).collect()}
    assert {tuple(r) for r in AUDITS[rule](after, batch).collect()} <= everything


def test_seed_is_clean(seed):
    assert run_audits(seed).isEmpty()


def test_deleting_a_question_keeps_the_total_in_range(spark, seed):
    gone = seed["ExamQuestion"].where("EQ_Id = 6")
    after = {**seed, "ExamQuestion": seed["ExamQuestion"].where("EQ_Id <> 6")}
    assert AUDITS["I-5"](after, gone).isEmpty()


def test_changes_elsewhere_leave_violations_that_only_a_whole_table_audit_sees(spark, seed):
    moved = {**seed, "Track": frame(spark, "Track", [(1, "Bread", 2), (2, "Ropes", 2), (3, "Cloth", 3)])}
    assert {r.key for r in AUDITS["I-1"](moved, None).collect()} == {1, 2}
    assert {r.key for r in AUDITS["I-2"](moved, None).collect()} == {1, 2}


def test_batch_verdict(spark, seed):
    rows = [(9, 2, 4, None, None, "t", None, None, None), (10, 2, 4, None, None, "u", None, None, None)]
    batch = frame(spark, "StudentAnswer", rows)
    after = {**seed, "StudentAnswer": seed["StudentAnswer"].unionByName(batch)}
    verdict = batch_verdict(AUDITS["I-10"](after, batch)).collect()
    assert [(r.rule, r.n_rows, r.first_key) for r in verdict] == [("I-10a", 2, 9)]
