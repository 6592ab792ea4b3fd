"""Grading: known results, missing answers, order of the subtypes, marks and regrading."""

from __future__ import annotations

import random
from decimal import Decimal as D

import pytest

from conftest import DAY, at, codes, frame
from invigil.operators import grading


def with_answers(spark, seed, rows, **more):
    return {**seed, "StudentAnswer": frame(spark, "StudentAnswer", rows), **more}


def verdicts(tables):
    return {r.Ans_Id: (r.Ans_Correct, r.Ans_Degree) for r in grading.grade_answers(tables).collect()}


def results(tables):
    return {r.SE_Id: r.FinalResult for r in grading.final_results(tables).collect()}


# The afternoon: the wrong flour, the wrong rest, and why salt is added.
SECOND = [
    (4, 2, 2, 3, None, None, None, None, None),
    (5, 2, 1, None, None, "Until it is warm.", None, None, None),
    (6, 2, 7, None, None, "it slows the YEAST. ", None, None, None),
]


def test_known_results(spark, seed):
    first = [tuple(r) for r in seed["StudentAnswer"].where("Ans_SEId = 1").collect()]
    tables = with_answers(spark, seed, first + SECOND)
    assert results(tables) == {1: D("40.00"), 2: D("6.50")}


def test_missing_answers(spark, seed):
    rows = [
        (1, 1, 2, None, None, None, None, None, None),  # no choice: not graded
        (2, 1, 3, None, None, None, None, None, None),  # no flag: wrong
        (3, 1, 1, None, None, None, None, None, None),  # no text: wrong
        (4, 2, 2, None, None, None, True, D(3), "old"),  # no choice: the old grade stays
        (5, 2, 1, None, None, None, True, D(3), "old"),
    ]
    tables = with_answers(spark, seed, rows)
    assert verdicts(tables) == {
        1: (None, None), 2: (False, D(0)), 3: (False, D(0)), 4: (True, D(3)), 5: (False, D(0)),
    }
    assert results(tables) == {1: D(0), 2: D(3)}


def test_blank_text_wins_against_an_unset_best_answer(spark, seed):
    tables = with_answers(
        spark, seed, [(1, 1, 1, None, None, "  ", None, None, None)], TextQuestion=frame(spark, "TextQuestion", [(1, "")])
    )
    assert verdicts(tables) == {1: (True, D(25))}


def test_text_decides_over_flag_and_flag_over_choice(spark, seed):
    tables = with_answers(
        spark,
        seed,
        [(1, 1, 2, 2, True, "yes", None, None, None), (2, 1, 3, 2, False, None, None, None, None)],
        TFQuestion=frame(spark, "TFQuestion", [(2, True), (3, True)]),
        TextQuestion=frame(spark, "TextQuestion", [(2, "no")]),
    )
    assert verdicts(tables) == {1: (False, D(0)), 2: (False, D(0))}


def test_choice_counts_by_its_own_flag_and_off_exam_degrees_still_add_up(spark, seed):
    rows = [
        (1, 1, 2, 4, None, None, None, None, None),  # right choice of another question
        (2, 1, 4, None, None, "x", None, D(4), None),  # not on the exam, but has a degree
        (3, 777, 2, 2, None, None, None, D(2), None),  # no such seat
    ]
    tables = with_answers(spark, seed, rows)
    assert verdicts(tables) == {1: (True, D(15)), 2: (None, D(4)), 3: (None, D(2))}
    assert results(tables) == {1: D(19), 2: D(0)}


def test_grading_twice_changes_nothing(spark, seed):
    once = grading.grade_answers(seed)
    twice = grading.grade_answers({**seed, "StudentAnswer": once})
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_requests(spark, seed):
    requests = spark.createDataFrame([(1, 1), (2, 9999), (3, 1)], "req_id long, SE_Id long")
    graded = grading.grade_seats(seed, requests)
    assert codes(graded.rejected) == {"2": "50300"}
    assert [tuple(r) for r in graded.results.collect()] == [(1, D(40))]
    assert {r.Ans_SEId for r in graded.answers.collect()} == {1}
    stored = grading.store_results(seed["StudentExam"], graded.results)
    assert {r.SE_Id: r.SE_Result for r in stored.collect()} == {1: D(40), 2: None}


def test_one_seat_beyond_the_result_column_does_not_stop_the_others(spark, seed):
    rows = [(i, 2, 100 + i, None, None, None, None, D("999.99"), None) for i in range(2)]
    first = [tuple(r) for r in seed["StudentAnswer"].where("Ans_SEId = 1").collect()]
    rows = [(r[0] + 50, *r[1:]) for r in first] + rows
    tables = with_answers(spark, seed, rows)
    graded = grading.grade_seats(tables)
    assert {r.SE_Id: r.FinalResult for r in graded.results.collect()} == {1: D(40)}
    assert codes(graded.rejected) == {"2": "OVERFLOW"}
    assert results(tables) == {1: D(40), 2: None}  # no seat is left out
    assert codes(grading.overflowing_seats(grading.seat_totals(tables))) == {"2": "OVERFLOW"}


def test_a_question_twice_on_an_exam_is_not_counted_twice(spark, seed):
    twice = seed["ExamQuestion"].unionByName(frame(spark, "ExamQuestion", [(9, 1, 1, D(25))]))
    with pytest.raises(ValueError, match="duplicate key"):
        grading.grade_seats({**seed, "ExamQuestion": twice})


def test_random_seats_like_one_after_the_other(spark, seed):
    rng = random.Random(8)
    n_seats = 40
    seats = [(s, 1 + s % 2, s, DAY, at(9), at(11), None) for s in range(n_seats)]
    rows, key = [], 0
    for s in range(n_seats):
        for q in rng.sample([1, 2, 3, 7], rng.randint(0, 4)):
            key += 1
            old = rng.choice([None, D(1)])
            choice = rng.choice([None, 2, 3, 4, 777]) if q == 2 else None
            flag = rng.choice([None, True, False]) if q == 3 else None
            text = rng.choice([None, "x", " UNTIL  it has doubled. "]) if q in (1, 7) else None
            rows.append((key, s, q, choice, flag, text, None, old, None))
    degree = {1: D(25), 2: D(12)}
    expected = {s: D(0) for s in range(n_seats)}
    for _, s, q, choice, flag, text, _, old, _ in rows:
        full, got = degree[1 + s % 2], old or D(0)
        if q == 2 and choice in (2, 3, 4):
            got = full if choice in (2, 4) else D(0)
        elif q == 3:
            got = full if flag else D(0)
        elif q == 1:
            got = full if text and text.startswith(" UNTIL") else D(0)
        expected[s] += got
    degrees = [(e * 3 + q, e + 1, q, degree[e + 1]) for e in range(2) for q in (1, 2, 3)]
    tables = with_answers(
        spark, seed, rows, StudentExam=frame(spark, "StudentExam", seats), ExamQuestion=frame(spark, "ExamQuestion", degrees)
    )
    assert results(tables) == expected


MARK = "req_id long, Ans_Id long, degree decimal(5,2), comment string"


def marked(spark, seed, marks):
    tables = with_answers(spark, seed, SECOND)
    tables = {**tables, "StudentAnswer": grading.grade_answers(tables)}
    tables["StudentExam"] = grading.store_results(tables["StudentExam"], grading.final_results(tables))
    return tables, grading.mark_answers(spark.createDataFrame(marks, MARK), tables)


def test_marks(spark, seed):
    marks = [
        (1, 9999, D(5), None),
        (2, 5, D(999), None),
        (3, 5, D(-1), None),
        (4, 5, D(1), "first thought"),
        (5, 5, D(9), "mostly"),  # the last mark counts
        (6, 6, D(0), None),  # any question may be marked
    ]
    tables, done = marked(spark, seed, marks)
    assert codes(done.outcome.rejected) == {1: "50400", 2: "50401", 3: "50401"}
    rows = {r.Ans_Id: r for r in done.answers.collect()}
    assert (rows[5].Ans_Degree, rows[5].Ans_Correct, rows[5].Ans_Comment) == (D(9), None, "mostly")
    assert (rows[6].Ans_Degree, rows[6].Ans_Correct) == (D(0), False)
    assert {r.SE_Id: r.SE_Result for r in done.seats.collect()} == {1: D(0), 2: D(9)}


def test_full_and_missing_marks(spark, seed):
    tables, done = marked(spark, seed, [(1, 5, D(12), None), (2, 4, None, "look again")])
    rows = {r.Ans_Id: r for r in done.answers.collect()}
    assert (rows[5].Ans_Degree, rows[5].Ans_Correct) == (D(12), True)
    assert (rows[4].Ans_Degree, rows[4].Ans_Correct, rows[4].Ans_Comment) == (None, None, "look again")
    assert {r.SE_Id: r.SE_Result for r in done.seats.collect()}[2] == D("18.50")


def test_grading_again_overwrites_marks_but_not_comments(spark, seed):
    tables, done = marked(spark, seed, [(1, 5, D(9), "mostly")])
    again = grading.grade_answers({**tables, "StudentAnswer": done.answers}).where("Ans_Id = 5").first()
    assert (again.Ans_Correct, again.Ans_Degree, again.Ans_Comment) == (False, D(0), "mostly")


def test_marks_of_a_seat_that_would_overflow_are_refused_alone(spark, seed):
    rows = [(1, 1, 1, None, None, "x", None, None, None), (5, 2, 1, None, None, "x", None, None, None)]
    rows.append((6, 2, 4, None, None, None, None, D("999.99"), None))
    tables = with_answers(spark, seed, rows)
    done = grading.mark_answers(spark.createDataFrame([(1, 1, D(25), None), (2, 5, D(1), None)], MARK), tables)
    assert codes(done.outcome.rejected) == {2: "OVERFLOW"}
    assert {r.Ans_Id: r.Ans_Degree for r in done.answers.collect()} == {1: D(25), 5: None, 6: D("999.99")}
    assert {r.SE_Id: r.SE_Result for r in done.seats.collect()} == {1: D(25), 2: None}


def test_texts_are_compared_before_the_choices(spark, seed):
    """What meets the choices carries the verdict by text, not the two texts."""
    graded = grading.grade_answers(seed).select("Ans_Id", "Ans_Correct", "Ans_Degree")
    top = graded._jdf.queryExecution().optimizedPlan()
    while not top.nodeName().startswith("Join"):
        top = top.children().apply(0)
    carried = top.children().apply(0).output().mkString(" ")
    assert "said" in carried
    assert "best" not in carried and "Ans_TextAns" not in carried


def test_results_from_graded_answers(spark, seed):
    """The same results, summed up from answers that are graded already, also where a seat comes twice."""
    first = [tuple(r) for r in seed["StudentAnswer"].where("Ans_SEId = 1").collect()]
    once = with_answers(spark, seed, first + SECOND)
    for tables in (once, {**once, "StudentExam": once["StudentExam"].unionByName(once["StudentExam"].where("SE_Id = 1"))}):
        again = grading.final_results(tables, grading.grade_answers(tables))
        assert {tuple(r) for r in again.collect()} == {tuple(r) for r in grading.final_results(tables).collect()}
        assert again.count() == 2
        assert again.schema == grading.final_results(tables).schema
