from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import at
from invigil.functions.clock import at_time, micros_of_day
from invigil.functions.filters import optional_filters
from invigil.functions.numbering import BLOCK_BITS, append_with_ids, running_total
from invigil.functions.rules import first_failing_rule
from invigil.functions.text import is_answer_valid, like_anywhere, like_expression, normalize_answer, text_key
from invigil.operators.sampling import draw, sample_n_per_group


def by_hand(text):
    """The canonical form, one step after the other."""
    if text is None:
        return None
    result = text.strip(" ").lower()
    for blank in "\t\n\r":
        result = result.replace(blank, " ")
    while "  " in result:
        result = result.replace("  ", " ")
    return result


def test_normalize_known_values(spark):
    cases = {
        "  Primary   Key  ": "primary key",
        "\tx": " x",
        "x\t": "x ",
        "a\r\n b": "a b",
        "": "",
        "   ": "",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", normalize_answer(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases


def test_normalize_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB é\t\n\r   ") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_answer(F.col("t")).alias("n"))
    assert all(r.n == by_hand(r.t) for r in df.collect())


def test_answer_validity(spark):
    best = "It names one row of a table."
    cases = {
        ("  IT NAMES one ROW of a   table.  ", best): True,
        ("something else", best): False,
        (None, best): False,
        (best, None): False,
        ("", ""): True,
        ("   ", ""): True,
        ("x\t", "x"): True,  # a blank left at the end does not count
        ("\tx", "x"): False,  # a blank left at the start does
    }
    df = spark.createDataFrame(list(cases), "a string, b string")
    got = {(r.a, r.b): r.v for r in df.select("a", "b", is_answer_valid(F.col("a"), F.col("b")).alias("v")).collect()}
    assert got == cases


def test_text_keys_and_patterns(spark):
    df = spark.createDataFrame([("Ann 50%",), ("ann 505",), ("Ann 50% ",)], "t string")
    assert df.where(like_anywhere(F.col("t"), "Ann_50")).count() == 2
    assert df.where(like_anywhere(F.col("t"), "ann_50", ci=True)).count() == 3
    assert df.groupBy(text_key(F.col("t")).alias("k")).count().count() == 2
    two = spark.createDataFrame([("Ab",), ("aB ",), ("c",)], "t string")
    assert two.groupBy(text_key(F.col("t"), ci=True).alias("k")).count().count() == 2


def test_time_of_day(spark):
    times = [dt.datetime(2026, 1, 1, 0, 0), dt.datetime(2026, 1, 1, 23, 59, 59, 999999), dt.datetime(2026, 5, 5, 9, 30, 0, 5)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = [r.m for r in df.select(micros_of_day(F.col("t")).alias("m")).collect()]
    assert got == [0, 24 * at(1) - 1, at(9, 30) + 5]
    back = df.select("t", at_time(F.to_date("t"), micros_of_day(F.col("t"))).alias("b")).collect()
    assert all(r.t == r.b for r in back)


def test_first_rule_wins_and_null_does_not_fail(spark):
    df = spark.createDataFrame([(1, 5), (5, 5), (1, 1), (None, 1), (None, 9)], "a int, b int")
    rules = [("A", F.col("a") > 3), ("B", F.col("b") > 3)]
    got = [r.c for r in df.select(first_failing_rule(rules).alias("c")).collect()]
    assert got == ["B", "A", None, None, "B"]


def test_absent_filters_add_nothing(spark):
    df = spark.range(10)
    assert optional_filters(df, (None, lambda v: F.col("id") == v)) is df
    assert optional_filters(df, (3, lambda v: F.col("id") > v), (None, None)).count() == 6


def _plain_totals(rows):
    totals, out = {}, {}
    for group, key, weight in sorted(rows):
        out[group, key] = totals.get(group, 0)
        totals[group] = out[group, key] + weight
    return out


def test_running_total_across_blocks(spark):
    rng = random.Random(3)
    far = 1 << (2 * BLOCK_BITS)
    keys = rng.sample(range(50), 30) + [rng.randrange(-far, 3 * far) for _ in range(300)]
    rows = [(rng.choice("xy"), k, rng.randint(0, 4)) for k in dict.fromkeys(keys)]
    df = spark.createDataFrame(rows, "g string, k long, w long").repartition(7)
    got = running_total(df, "k", "before", F.col("w"), ["g"]).collect()
    assert {(r.g, r.k): r.before for r in got} == _plain_totals(rows)
    alone = running_total(df, "k", "before").collect()
    assert sorted(r.before for r in alone) == list(range(len(rows)))


def test_append_follows_the_last_id(spark):
    old = spark.createDataFrame([(7,), (41,)], "id long")
    new = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "r long, v string")
    got = append_with_ids(old, new, "id", "r").collect()
    assert {r.v: r.id for r in got} == {"a": 42, "b": 43, "c": 44}
    assert [r.id for r in append_with_ids(old.limit(0), new, "id", "r").orderBy("id").collect()] == [1, 2, 3]
    twice = spark.createDataFrame([(10, 2), (10, 1), (5, 9)], "r long, q long")
    got = {(r.r, r.q): r.id for r in append_with_ids(old, twice, "id", "r", ["q"]).collect()}
    assert got == {(5, 9): 42, (10, 1): 43, (10, 2): 44}


def test_sample_takes_n_of_each_group_whatever_the_partitions(spark):
    df = spark.range(200).selectExpr("id", "id % 7 as g").where("g < 6 or id < 9")
    picks = [
        {(r.g, r.id) for r in sample_n_per_group(df.repartition(n), ["g"], "id", 5, "s").collect()} for n in (1, 5)
    ]
    assert picks[0] == picks[1]
    sizes = Counter(g for g, _ in picks[0])
    assert sizes == {0: 5, 1: 5, 2: 5, 3: 5, 4: 5, 5: 5} | ({6: 1} if 6 in sizes else {})
    other = {(r.g, r.id) for r in sample_n_per_group(df, ["g"], "id", 5, "t").collect()}
    assert other != picks[0]


def test_draw_gives_every_set_its_share(spark):
    runs = 3000
    df = spark.range(runs).select("id", F.lit(5).alias("size"), F.lit(2).alias("n"), F.concat(F.lit("s"), F.col("id")).alias("seed"))
    drawn = draw(df, "size", "n", "seed", "d").groupBy("id").agg(F.collect_set("d").alias("d"))
    sets = Counter(frozenset(r.d) for r in drawn.collect())
    assert all(len(s) == 2 and s <= {1, 2, 3, 4, 5} for s in sets)
    assert len(sets) == 10
    assert all(abs(n - runs / 10) < 5 * (runs / 10) ** 0.5 for n in sets.values())


def test_draw_edges(spark):
    sizes = [(i, s, n) for i, (s, n) in enumerate([(3, 3), (1, 1), (2, 2), (100, 99), (101, 101), (37, 37), (10, 1), (9, 9), (1000, 990)])]
    df = spark.createDataFrame(sizes, "id int, size int, n int").withColumn("seed", F.lit("x"))
    found = {r.id: r.d for r in draw(df, "size", "n", "seed", "d").groupBy("id").agg(F.collect_list("d").alias("d")).collect()}
    for i, size, n in sizes:
        assert len(set(found[i])) == n == len(found[i]) and all(1 <= x <= size for x in found[i])


def test_a_large_draw_is_linear(spark):
    """A hundred thousand questions of one request, each once."""
    df = spark.createDataFrame([(120_011, 100_000, "big")], "size long, n long, seed string")
    found = draw(df, "size", "n", "seed", "d").agg(F.count_distinct("d").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).first()
    assert found.n == 100_000 and 1 <= found.low < 50 and 119_900 < found.high <= 120_011


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("b[a-c]t", "bat bct", "bdt bt b-t"),
        ("b[^a-c]t", "bdt b^t", "bat"),
        ("[-a]x", "-x ax", "bx"),
        ("[a-]x", "-x ax", "bx"),
        ("[a^]x", "ax ^x", "bx"),
        ("[.]x", ".x", "ax"),
        ("[%]_", "%a", "aa"),
        ("[[]a", "[a", "a"),
        ("a]", "a]", "a"),
        ("[]a", "", "a []a"),
        ("[^]a", "ba ]a", "a"),
        ("[c-a]b", "", "ab bb"),
        ("a[bc", "", "ab a[bc abc"),
        ("%[0-9]%", "a1 1", "a"),
        ("a.[b]", "a.b", "axb"),
        (r"a\[d]", r"a\d", "a1"),
    ],
)
def test_bracket_classes(spark, pattern, yes, no):
    rows = [(t, True) for t in yes.split()] + [(t, False) for t in no.split()]
    df = spark.createDataFrame(rows, "t string, match boolean")
    assert df.where(F.col("t").rlike(like_expression(pattern)) != F.col("match")).collect() == []


def test_bracket_search(spark):
    df = spark.createDataFrame([("Ann 50%",), ("ANN 57",), ("Ann [5]",)], "t string")
    assert df.where(like_anywhere(F.col("t"), "n 5[0-6]")).count() == 1
    assert df.where(like_anywhere(F.col("t"), "N 5[0-7]", ci=True)).count() == 2
    plan = df.where(like_anywhere(F.col("t"), "nn"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan
