"""The registered queries and the pipeline on the given tables."""

from __future__ import annotations

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from checks.compare import compare, database
from invigil.llm import queries
from invigil.session import stage

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no given data here")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_agrees_with_sql(llm, name):
    assert compare(llm, database(DIR), name, queries.QUERIES[name], queries.SQL[name], DIR)


def test_all_operators_are_registered():
    names = [n for n in registered.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in registered.queries()


@pytest.fixture(scope="module")
def stages(llm):
    docs = llm.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(llm, out[-1], DIR), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_language_stage_keeps_prose(stages):
    given, found = texts(stages[0]), texts(stages[1])
    assert all(re.search(r"[^\W\d_]", given[i]) for i in found)
    assert len(found) >= 0.98 * len(given)


def test_near_stage_leaves_one_of_each_group(stages):
    from tests.llm.test_operators import grouped

    given, found = texts(stages[1]), texts(stages[2])
    expected = grouped(sorted(given.items()), corpus_pipeline.NEAR_PERCENT)
    assert set(found) == {root for _, root in expected.values()}


def test_passages_do_not_repeat_in_what_the_cutting_stage_saw(stages):
    given, found = texts(stages[2]), texts(stages[3])
    size = corpus_pipeline.REPEATED
    counts = Counter()
    for t in given.values():
        data = t.encode()
        counts.update(data[p : p + size] for p in range(len(data) - size + 1))
    for i, t in given.items():
        data, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(data) - size + 1):
            if counts[data[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        if b"\1" not in gone:
            assert found[i] == t
        else:
            kept = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
            assert abs(len(found[i]) - len(kept)) <= 2 * len(re.findall(b"\1+", bytes(gone)))


def test_no_personal_data_is_left(stages):
    from invigil.llm.pii import find

    assert not any(find(t)[1] for t in texts(stages[4]).values())
    for df in stages[3:5]:
        assert df.where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_everything_left_is_packed(stages):
    ids = {r.doc_id for r in stages[5].select("doc_id").distinct().collect()}
    assert ids == set(texts(stages[4]))


def test_run_gives_the_last_stage(llm, stages):
    run = corpus_pipeline.run(llm, DIR)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(run.select(*columns).collect()) == sorted(stages[5].select(*columns).collect())
