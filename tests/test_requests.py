"""Request operators: every error code, the good cases, and requests that collide."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from conftest import DAY, at, codes, frame, moment
from invigil.functions import turns
from invigil.messages import message
from invigil.operators import dimensions, exams
from invigil.schema import TABLES
from invigil.session import stage

EXAM = "req_id long, Exm_AsgId long, Exm_Type string, Exm_IntId long, Exm_BrId long, Exm_TrkId long, Exm_Start timestamp_ntz, Exm_End timestamp_ntz, Exm_TotalTime int, Exm_Allowance string"


def header(req, asg=1, kind="Exam", intake=1, branch=1, track=1, start=moment(9), end=moment(11), time=60):
    return (req, asg, kind, intake, branch, track, start, end, time, None)


# -- questions


def test_create_question(spark, seed):
    schema = "req_id long, Q_CrsId long, Q_Type string, Q_Text string, Q_CreatedBy long"
    requests = spark.createDataFrame(
        [
            (1, 1, "MCQ", "q", 2),  # not this instructor's course
            (2, 1, "Essay", "q", 2),  # the first rule decides
            (3, 1, "Essay", "q", 1),
            (4, 1, "TF", "q", 1),
            (5, 1, "Text", "q", 1),
            (6, 2, "MCQ", "q", 2),
            (7, 1, "MCQ", None, 1),
        ],
        schema,
    )
    new = exams.create_questions(requests, seed)
    assert codes(new.rejected) == {1: "50001", 2: "50001", 3: "50002", 7: "I-15"}
    assert {r.req_id: r.Q_Id for r in new.questions.collect()} == {4: 9, 5: 10, 6: 11}
    assert [tuple(r) for r in new.tf.collect()] == [(9, False)]
    assert [tuple(r) for r in new.text.collect()] == [(10, "")]
    assert {r.error_message for r in new.rejected.where("req_id = 3").collect()} == {message("50002")}


# -- random exams

RANDOM = [
    (dict(asg=9999), (1, 0, 0), 5, "50010"),
    ({}, (-1, 0, 0), 5, "50011"),
    ({}, (1, 0, 0), 0, "50012"),
    (dict(start=moment(11), end=moment(9)), (1, 0, 0), 5, "50013"),
    (dict(time=0), (1, 0, 0), 5, "50014"),
    ({}, (0, 0, 0), 5, "50015"),
    ({}, (1, 1, 1), 40, "50016"),
    ({}, (50, 0, 0), 1, "50017"),
    ({}, (0, 50, 0), 1, "50018"),
    ({}, (0, 0, 50), 1, "50019"),
    (dict(asg=9999, time=0), (-1, 0, 0), 0, "50010"),
    (dict(kind="Quiz"), (1, 0, 0), 5, "I-11"),
    (dict(intake=99), (1, 0, 0), 5, "I-14"),
    (dict(track=2), (1, 0, 0), 5, "I-2"),
    ({}, (None, 1, 1), 5, "I-15"),
    ({}, (1, 0, 0), None, "I-15"),
    (dict(end=None), (1, 0, 0), 5, "I-15"),
    ({}, (1, 0, 0), 5, None),
    ({}, (2, 1, 2), 18, None),  # exactly the course's limit
]


def test_random_exam(spark, seed):
    rows = [(*header(i, **head), *n, None if d is None else D(d)) for i, (head, n, d, _) in enumerate(RANDOM)]
    requests = spark.createDataFrame(rows, EXAM + ", n_mcq int, n_tf int, n_text int, degree decimal(5,2)")
    new = exams.generate_random_exams(requests, seed, seed=1)
    assert codes(new.rejected) == {i: code for i, (*_, code) in enumerate(RANDOM) if code}
    ids = {r.req_id: r.Exm_Id for r in new.exams.collect()}
    assert ids == {17: 4, 18: 5}
    drawn = [(r.EQ_ExmId, r.EQ_QId, r.EQ_Degree) for r in new.questions.collect()]
    assert {q for e, q, _ in drawn if e == 5} == {1, 2, 3, 4, 7}
    assert [d for e, _, d in drawn if e == 4] == [D(5)]
    assert sorted(r.EQ_Id for r in new.questions.collect()) == [8, 9, 10, 11, 12, 13]


def test_random_exams_draw_the_right_questions(spark, seed):
    bank = [(i, i % 3 + 1, ("MCQ", "TF", "Text")[i % 5 % 3], "q", 1) for i in range(1, 400)]
    tables = {
        **seed,
        "Question": frame(spark, "Question", bank),
        "Course": frame(spark, "Course", [(c, f"c{c}", None, D(100), D(50)) for c in (1, 2, 3)]),
        "CourseAssignment": frame(spark, "CourseAssignment", [(c, c, 1, 2026) for c in (1, 2, 3)]),
    }
    rng = random.Random(9)
    wants = {i: (i % 3 + 1, rng.randint(0, 9), rng.randint(0, 9), rng.randint(1, 9)) for i in range(60)}
    rows = [(*header(i, asg=c), a, b, t, D(1)) for i, (c, a, b, t) in wants.items()]
    requests = spark.createDataFrame(rows, EXAM + ", n_mcq int, n_tf int, n_text int, degree decimal(5,2)")
    kind = {q[0]: (q[1], q[2]) for q in bank}
    runs = []
    for parts in (1, 6):
        new = exams.generate_random_exams(requests.repartition(parts), tables, seed="x")
        request_of = {r.Exm_Id: r.req_id for r in new.exams.collect()}
        papers = {}
        for r in new.questions.collect():
            papers.setdefault(request_of[r.EQ_ExmId], []).append(r.EQ_QId)
        runs.append(papers)
    assert {k: set(v) for k, v in runs[0].items()} == {k: set(v) for k, v in runs[1].items()}
    for i, (course, *counts) in wants.items():
        paper = runs[0][i]
        assert len(paper) == len(set(paper)) == sum(counts)
        assert {kind[q][0] for q in paper} == {course}
        assert [sum(kind[q][1] == t for q in paper) for t in ("MCQ", "TF", "Text")] == counts


# -- manual exams

MANUAL = [
    (dict(asg=9999), [(1, 10)], "50100"),
    ({}, [(1, 50), (2, 41)], "50101"),
    ({}, [(6, 10)], "50102"),
    ({}, [(1, 10), (777, 10)], "50102"),
    ({}, [(1, 10), (1, 10)], "I-12"),
    ({}, [(1, 10), (2, 0)], "I-11"),
    (dict(end=moment(9)), [(1, 10)], "I-11"),
    (dict(track=2), [(1, 10)], "I-2"),
    ({}, [(1, None)], "I-15"),
    ({}, [(1, 10), (2, 10)], None),
    ({}, [], None),  # an empty list makes an empty exam
    ({}, [(1, 50), (2, 40)], None),
]


def test_manual_exam(spark, seed):
    requests = spark.createDataFrame([header(i, **head) for i, (head, _, _) in enumerate(MANUAL)], EXAM)
    items = [(i, q, None if d is None else D(d)) for i, (_, qs, _) in enumerate(MANUAL) for q, d in qs]
    lists = spark.createDataFrame(items, "req_id long, QId long, degree decimal(5,2)")
    new = exams.create_manual_exams(requests, lists, seed)
    assert codes(new.rejected) == {i: code for i, (*_, code) in enumerate(MANUAL) if code}
    assert {r.req_id: r.Exm_Id for r in new.exams.collect()} == {9: 4, 10: 5, 11: 6}
    got = [tuple(r) for r in new.questions.orderBy("EQ_Id").collect()]
    assert got == [(8, 4, 1, D(10)), (9, 4, 2, D(10)), (10, 6, 1, D(50)), (11, 6, 2, D(40))]


# -- seats

SEATS = [
    ((9999, 2, DAY, at(13), at(14)), "50200"),
    ((2, 3, DAY, at(13), at(14)), "50201"),
    ((2, 777, DAY, at(13), at(14)), "50201"),
    ((2, 2, DAY, at(15), at(14)), "50202"),
    ((2, 2, DAY, at(11), at(12)), "50203"),
    ((2, 2, DAY, at(13), at(16, 1)), "50203"),
    ((2, 2, dt.date(2027, 3, 9), at(13), at(14)), "50203"),
    ((2, 1, DAY, at(13), at(14)), "I-12"),  # has a seat already
    ((2, 2, DAY, None, at(14)), "I-15"),
    ((2, 2, DAY, at(13), at(16)), None),
    ((2, 2, DAY, at(14), at(15)), "I-12"),  # the request before took the seat
    ((1, 2, DAY, at(10), at(12)), None),
]


def test_assign_seats(spark, seed):
    rows = [(i, *r) for i, (r, _) in enumerate(SEATS)]
    schema = "req_id long, SE_ExmId long, SE_StId long, SE_Date date, SE_Start long, SE_End long"
    new = exams.assign_seats(spark.createDataFrame(rows, schema).repartition(3), seed)
    assert codes(new.rejected) == {i: code for i, (_, code) in enumerate(SEATS) if code}
    assert {r.req_id: r.SE_Id for r in new.seats.collect()} == {9: 3, 11: 4}


def test_exam_past_midnight_admits_nobody(spark, seed):
    night = (7, 1, "Exam", 1, 1, 1, moment(22), moment(1, day=9), 60, None)
    tables = {**seed, "Exam": frame(spark, "Exam", [night])}
    schema = "req_id long, SE_ExmId long, SE_StId long, SE_Date date, SE_Start long, SE_End long"
    rows = [(1, 7, 2, DAY, at(22), at(23)), (2, 7, 2, DAY, at(0), at(1))]
    assert codes(exams.assign_seats(spark.createDataFrame(rows, schema), tables).rejected) == {1: "50203", 2: "50203"}


# -- dimensions


def entry(spark, table, rows, key=False):
    spec = dimensions.CHANGE[table] if key else dimensions.ADD[table]
    names = ["req_id", *([TABLES[table].key] if key else []), *spec.columns]
    types = {f.name: f.dataType.simpleString() for f in TABLES[table].struct}
    return spark.createDataFrame(rows, ", ".join(f"{n} {types.get(n, 'long')}" for n in names))


def test_add_branch(spark, seed):
    rows = [(1, "Mill", None), (2, "East", "e"), (3, "East ", "late"), (4, None, None), (5, "West", None)]
    new = dimensions.ingest(entry(spark, "Branch", rows), seed, "Branch")
    assert codes(new.rejected) == {1: "I-12", 3: "I-12", 4: "I-15"}
    assert sorted(tuple(r) for r in new.rows.collect()) == [(4, "East", "e"), (5, "West", None)]


def test_add_branch_case_blind(spark, seed):
    rows = [(1, "MILL", None), (2, "East", None), (3, "EAST", None)]
    new = dimensions.ingest(entry(spark, "Branch", rows), seed, "Branch", ci=True)
    assert codes(new.rejected) == {1: "I-12", 3: "I-12"}


def test_add_track(spark, seed):
    rows = [(1, "T", 9999), (2, "T", 1), (3, "T", 2), (4, "T", 1), (5, "Bread", 1), (6, "T", None)]
    new = dimensions.ingest(entry(spark, "Track", rows), seed, "Track")
    assert codes(new.rejected) == {1: "50600", 4: "I-12", 5: "I-12", 6: "50600"}
    assert sorted(tuple(r) for r in new.rows.collect()) == [(4, "T", 1), (5, "T", 2)]


def test_add_intake(spark, seed):
    rows = [(1, "Winter", DAY), (2, "July", DAY), (3, "Autumn", None)]
    new = dimensions.ingest(entry(spark, "Intake", rows), seed, "Intake")
    assert codes(new.rejected) == {2: "I-12", 3: "I-15"}


def student(req, user, mail, br=1, trk=1, intake=1):
    return (req, user, "n", mail, None, br, trk, intake)


def test_add_student(spark, seed):
    rows = [
        student(1, "n1", "m1"),
        student(2, "n1", "m2"),  # loses on the user name, so m2 stays free
        student(3, "n3", "m2"),
        student(4, "n4", "m1"),
        student(5, "n5", "m5", br=1, trk=2),
        student(6, "n6", "m6", intake=99),
        student(7, "p1", "m7"),
        student(8, "n6", "m5"),  # 5 and 6 were refused and hold nothing
    ]
    new = dimensions.ingest(entry(spark, "Student", rows), seed, "Student")
    assert codes(new.rejected) == {2: "I-12", 4: "I-12", 5: "I-1", 6: "I-14", 7: "I-12"}
    assert sorted((r.St_Id, r.St_User, r.St_Email) for r in new.rows.collect()) == [
        (5, "n1", "m1"),
        (6, "n3", "m2"),
        (7, "n6", "m5"),
    ]


def test_add_students_like_one_after_the_other(spark, seed):
    rng = random.Random(1)
    rows = [student(i, f"u{rng.randint(0, 25)}", f"m{rng.randint(0, 25)}") for i in range(120)]
    rows += [student(200 + i, f"chain{(i + 1) // 2}", f"link{i // 2}") for i in range(9)]
    users, mails, expected = set(), set(), {}
    for row in rows:
        if row[1] in users or row[3] in mails:
            expected[row[0]] = "I-12"
        else:
            users.add(row[1])
            mails.add(row[3])
    new = dimensions.ingest(entry(spark, "Student", rows).repartition(4), seed, "Student")
    assert codes(new.rejected) == expected


@pytest.mark.parametrize("n", [16, 1000])
def test_chained_students_take_few_rounds(spark, seed, n, monkeypatch):
    """Every request has one rival before it: first by user, then by mail, then by user again."""
    rows = [student(i, f"u{i // 2}", f"m{(i + 1) // 2}") for i in range(n)]
    stored = []
    monkeypatch.setattr(turns, "stage", lambda df, purpose: stored.append(purpose) or stage(df, purpose))
    new = dimensions.ingest(entry(spark, "Student", rows).repartition(4), seed, "Student")
    assert set(codes(new.rejected)) == set(range(1, n, 2))
    assert len(stored) <= n.bit_length() + 3


def crowd(kind, n=10_000):
    """(user, mail) numbers of a batch of ``n`` students."""
    rng = random.Random(8)
    if kind == "sparse":
        return [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
    if kind == "crowded":
        return [(rng.randrange(n // 20), rng.randrange(n // 20)) for _ in range(n)]
    if kind == "one user":
        return [(0 if i % 3 else i, rng.randrange(n)) for i in range(n)]
    # Every request has a rival on each key, right before it and two before it.
    return [(i // 2, i // 3) for i in range(n)]


@pytest.mark.parametrize(("kind", "most"), [("sparse", 4), ("crowded", 8), ("one user", 4), ("steps", 4)])
def test_ten_thousand_students_take_few_rounds(spark, kind, most):
    pairs = crowd(kind)
    rows = [(i, f"u{u}", f"m{m}", None) for i, (u, m) in enumerate(pairs)]
    judged = spark.createDataFrame(rows, "req_id long, St_User string, St_Email string, error_code string").repartition(4)
    rounds = []
    found = dimensions._in_turn(judged, dimensions.ADD["Student"], False, rounds)
    refused = {r.req_id for r in found.where("error_code = 'I-12'").collect()}
    users, mails, expected = set(), set(), set()
    for i, (u, m) in enumerate(pairs):
        if u in users or m in mails:
            expected.add(i)
        else:
            users.add(u)
            mails.add(m)
    assert refused == expected
    assert len(rounds) <= most, len(rounds)


def test_update_branch(spark, seed):
    rows = [
        (1, 1, "Hill", None),  # held by the other branch
        (2, 1, "Harbour", "kept its name"),
        (3, 777, "Hill", None),  # no such branch: nothing happens, nothing is refused
        (4, 2, "East", None),
        (5, 1, "East", None),  # claimed by request 4
    ]
    changed = dimensions.merge(entry(spark, "Branch", rows, key=True), seed, "Branch")
    assert codes(changed.rejected) == {1: "I-12", 5: "I-12"}
    assert sorted(tuple(r) for r in changed.rows.collect()) == [(1, "Harbour", "kept its name"), (2, "East", None), (3, "Mill", None)]


def test_update_track_knows_no_own_code_for_a_missing_branch(spark, seed):
    rows = [(1, 1, "Bread", 9999), (2, 2, "Bread", 1)]
    changed = dimensions.merge(entry(spark, "Track", rows, key=True), seed, "Track")
    assert codes(changed.rejected) == {1: "I-14", 2: "I-12"}


def test_update_student(spark, seed):
    def change(req, key, mail, br=1, trk=1):
        return (req, key, "new", mail, "1", br, trk, 1)

    rows = [
        change(1, 1, "p3@example.org"),
        change(2, 1, "one@example.org"),
        change(3, 1, "last@example.org"),  # the last change of a row counts
        change(4, 3, "x@example.org", trk=2),
    ]
    changed = dimensions.merge(entry(spark, "Student", rows, key=True), seed, "Student")
    assert codes(changed.rejected) == {1: "I-12", 4: "I-1"}
    row = changed.rows.where("St_Id = 1").first()
    assert (row.St_User, row.St_Name, row.St_Email, row.St_Phone) == ("p1", "new", "last@example.org", "1")
    assert changed.rows.where("St_Id = 3").first().St_Email == "p3@example.org"


@pytest.mark.parametrize("table", ["Branch", "Track", "Intake", "Student"])
def test_empty_batches(spark, seed, table):
    new = dimensions.ingest(entry(spark, table, []), seed, table)
    assert new.rows.isEmpty() and new.rejected.isEmpty()
