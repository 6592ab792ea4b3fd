"""Requests that take what earlier ones of the batch gave up, against a replay one by one."""

from __future__ import annotations

import random

import pytest

from conftest import codes
from invigil.functions import timelines, turns
from invigil.operators import dimensions
from invigil.session import stage
from test_requests import entry


def replay(requests, held):
    holders = {}
    for row, value in sorted(held, reverse=True):
        holders[value] = row
    out = {}
    for number, row, value in sorted(requests):
        out[number] = holders.get(value) in (None, row)
        if out[number]:
            holders = {v: r for v, r in holders.items() if r != row}
            holders[value] = row
    return out


def decided(spark, requests, held, rounds=None):
    given = spark.createDataFrame(requests, "req_id long, row long, value string").repartition(3)
    found = timelines.decide(given, spark.createDataFrame(held, "row long, value string"), rounds)
    return {r.req_id: r.accepted for r in found.collect()}


@pytest.mark.parametrize(("n", "rows", "values"), [(60, 5, 6), (250, 40, 45), (1500, 300, 400)])
def test_verdicts_are_those_of_a_replay(spark, n, rows, values):
    rnd = random.Random(n)
    held = [(r, f"v{r}") for r in range(rows)]
    requests = [(i, rnd.randrange(rows + 2), f"v{rnd.randrange(values)}") for i in range(n)]
    assert decided(spark, requests, held) == replay(requests, held)


def test_ten_thousand_requests_take_few_rounds(spark):
    rnd = random.Random(5)
    held = [(r, f"v{r}") for r in range(2000)]
    requests = [(i, rnd.randrange(2000), f"v{rnd.randrange(20_000)}") for i in range(10_000)]
    rounds = []
    assert decided(spark, requests, held, rounds) == replay(requests, held)
    assert len(rounds) <= 4


@pytest.mark.parametrize("free", [True, False])
def test_a_long_rotation_takes_one_round(spark, free):
    """Each row takes what the one before it gave up; the first takes a value that is free, or is refused, and so are all."""
    n, rounds = 1000, []
    held = [(r, f"v{r}") for r in range(n)] + ([] if free else [(n, "spare")])
    requests = [(0, 0, "spare")] + [(i, i, f"v{i - 1}") for i in range(1, n)] + [(n, 0, f"v{n - 1}")]
    found = decided(spark, requests, held, rounds)
    assert found == replay(requests, held) and found[n - 1] is free
    assert len(rounds) == 1


def test_a_crowded_value_changes_hands(spark):
    """One value that all requests want, given up again and again."""
    requests, rounds = [], []
    for i in range(0, 3000, 3):
        requests += [(i, i % 7, "best"), (i + 1, (i + 1) % 7, "best"), (i + 2, i % 7, f"own{i}")]
    assert decided(spark, requests, [(0, "best"), (3, "x")], rounds) == replay(requests, [(0, "best"), (3, "x")])
    assert len(rounds) <= 3


def test_no_requests(spark):
    assert decided(spark, [], [(1, "a")]) == {}


# -- in the tables -------------------------------------------------------------------------


def branches(spark, seed, rows):
    changed = dimensions.merge(entry(spark, "Branch", rows, key=True).repartition(3), seed, "Branch")
    return codes(changed.rejected), {r.Br_Id: r.Br_Name for r in changed.rows.collect()}


def test_two_branches_swap_names(spark, seed):
    rows = [(1, 1, "for now", None), (2, 2, "Harbour", None), (3, 1, "Hill", None)]
    assert branches(spark, seed, rows) == ({}, {1: "Hill", 2: "Harbour", 3: "Mill"})


def test_without_a_spare_name_a_swap_is_refused(spark, seed):
    rows = [(1, 1, "Hill", None), (2, 2, "Harbour", None)]
    assert branches(spark, seed, rows) == ({1: "I-12", 2: "I-12"}, {1: "Harbour", 2: "Hill", 3: "Mill"})


def test_three_branches_rotate(spark, seed):
    rows = [(1, 3, "for now", None), (2, 2, "Mill", None), (3, 1, "Hill", None), (4, 3, "Harbour", None), (5, 1, "Mill", None)]
    assert branches(spark, seed, rows) == ({5: "I-12"}, {1: "Hill", 2: "Mill", 3: "Harbour"})


def test_a_refused_change_gives_nothing_up(spark, seed):
    rows = [(1, 1, None, None), (2, 2, "Harbour", None)]
    assert branches(spark, seed, rows)[0] == {1: "I-15", 2: "I-12"}


def test_settled_steps_do_not_meet(spark, monkeypatch):
    """Steps without a parent take no part in the join, where their NULLs would all be one key."""
    written = []
    monkeypatch.setattr(turns, "stage", lambda df, purpose: written.append(df) or stage(df, purpose))
    rows = [(n, None, n % 2 == 0, False, False) for n in range(50)] + [(50, None, True, False, True)]
    rows += [(100, 0, False, True, False), (101, 100, False, True, False), (102, 50, True, False, False), (103, 7, True, False, False)]
    found = {r.id: r.accepted for r in turns.settle(spark.createDataFrame(rows, timelines.STEP)).collect()}
    assert found == {**{n: n % 2 == 0 for n in range(50)}, 100: False, 101: True, 103: False}
    joined = [df._jdf.queryExecution().optimizedPlan() for df in written[1:]]
    assert joined
    for plan in joined:
        while not plan.nodeName().startswith("Join"):
            plan = plan.children().apply(0)
        assert "isnotnull(parent" in plan.children().apply(0).toString()
