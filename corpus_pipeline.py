"""A training corpus from raw documents: identified, deduplicated, cut, redacted and packed.

Each stage takes what the one before kept and calls one operator of ``invigil.llm``.  All but the
last return the columns of documents; where a stage changes ``text``, ``n_chars`` follows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invigil.llm import language, near, packing, pii, substrings
from invigil.llm.common import read, shown_to_workers
from invigil.session import stage, tune

NEAR_PERCENT = 80
#: Bytes.  Fifty short words: a passage of more words than that is longer in any of the languages.
REPEATED = 256

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    return docs.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those without letters, or with none likely, go."""
    shown_to_workers(tune(spark))
    return language.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    shown_to_workers(tune(spark))
    return near.kept(docs, NEAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    shown_to_workers(tune(spark))
    return _counted(substrings.cut(docs, REPEATED))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    shown_to_workers(tune(spark))
    return _counted(pii.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences."""
    shown_to_workers(tune(spark))
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

# Language models, sketches and the packing of a histogram are beyond SQL; tests hold the stages
# against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
