"""Odd rows, no rows, and columns with the operators' own names."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from invigil.llm import bpe, chat, fingerprints, language, near, packing, pii, sentence_pieces, sharding, substrings, topk
from tests.llm.conftest import ODD

ON_DOCUMENTS = {
    "op2": language.predictions,
    "op3": fingerprints.edits,
    "op3 fingerprints": fingerprints.fingerprints,
    "op4": pii.spans,
    "op4 redacted": pii.redacted,
    "op6": bpe.round_trips,
    "op6 ids": lambda docs: bpe.decode(bpe.encode(docs)),
    "op7": near.groups,
    "op8": lambda docs: packing.pack(docs).where("piece = 0"),
    "op9": sharding.places,
    "op9 shards": sharding.shards,
    "op10": substrings.deduplicated,
    "op10 cut": substrings.cut,
    "op11": sentence_pieces.round_trips,
    "op11 ids": lambda docs: sentence_pieces.decode(sentence_pieces.encode(docs)),
}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_odd_rows_and_names(table, crowded, name):
    found = ON_DOCUMENTS[name](crowded(table(ODD))).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in ODD)


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_table(table, crowded, name):
    assert ON_DOCUMENTS[name](crowded(table([]))).collect() == []


def test_empty_conversations_and_vectors(llm):
    turns = llm.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(turns).collect() == []
    assert chat.digests(turns.unionByName(chat.hostile(llm))).first().identical
    vectors = llm.createDataFrame([(50, [1.0], "x"), (51, [2.0], "y")], "vec_id long, embedding array<float>, slab string")
    assert [r.score for r in topk.top_k(vectors, F.col("vec_id") == 50).collect()] == [256 * 512]


@pytest.mark.parametrize(("name", "function"), corpus_pipeline.STAGES)
@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_take_odd_documents(llm, table, crowded, name, function, rows):
    docs = crowded(table(rows))
    out = function(llm, docs, "")
    found = out.collect()
    if name == "packing":
        assert {r.doc_id for r in found} == {i for i, _ in rows}
        return
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert not Counter(r.doc_id for r in found) - Counter(i for i, _ in rows)
