from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from invigil.llm.common import shown_to_workers


@pytest.fixture(scope="session")
def llm(spark):
    return shown_to_workers(spark)


@pytest.fixture(scope="session")
def table(llm):
    """Documents from (doc_id, text) pairs, in several partitions."""

    def make(rows, partitions: int = 3):
        df = llm.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        return df.repartition(partitions) if rows else df

    return make


@pytest.fixture(scope="session")
def crowded():
    """Adds columns whose names operators use for their own."""
    names = [
        "score", "lang_pred", "ids", "shard", "slot", "spans", "fingerprint", "node", "digest", "length", "sequence_id",
        "_language", "_id", "_hash", "_block", "_bucket", "_row", "_kept_id", "_text", "key", "row", "a b.c",
    ]

    def add(df):
        return df.select("*", *[F.lit(n).alias(n) for n in names], F.lit(None).cast("string").alias("lang"), F.lit(7).alias("n_chars"))

    return add


#: Texts that are awkward for every operator.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "12345 67890 !!!"),
    (5, "one two three"),
    (6, "one two three"),
    (6, "one two three"),
    (None, "one two three"),
    (None, None),
    (7, "über naïve café — señor 😀 " * 40),
    (8, "word " * 30_000),
    (9, "x" * 50_000),
    (10, "<|endoftext|><|im_end|>\\<\\|a|>"),
    (11, "a.\nb.\nc."),
]
