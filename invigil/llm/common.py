"""What the operators share: tables, batches of bounded size, memories of bounded size."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def shown_to_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, too.

    Elsewhere than on one machine it is installed on every node or handed over with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in parts whose ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def over_slices(function: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text"):
    """A mapInArrow function that applies ``function`` to every slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield function(part)

    return run


def fresh(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns that carry the name of one that an operator adds."""
    taken = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in taken])


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or something like it that is no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(docs: DataFrame, *needed: str) -> DataFrame:
    """The named columns, and all of ``docs`` as one struct, whatever its columns are called."""
    return docs.select(F.struct(*[F.col(field(c)) for c in docs.columns]).alias("row"), *needed)


def back(df: DataFrame, columns: list[str], **changed: str) -> DataFrame:
    """The columns of the struct again, those named in ``changed`` taken from that column."""
    kept = [F.col(changed[c]).alias(c) if c in changed else F.col("row")[c].alias(c) for c in columns]
    return df.select(*kept, *[F.col(v).alias(c) for c, v in changed.items() if c not in columns])


def field(name: str) -> str:
    """A column as SQL quotes it."""
    return "`" + name.replace("`", "``") + "`"


class Memo(dict):
    """Results by argument; emptied when ``size`` are held, and none for arguments longer than ``longest``, so that
    a worker's memory is bounded in bytes, too."""

    def __init__(self, function: Callable, size: int = 400_000, longest: int = 64):
        super().__init__()
        self.function, self.size, self.longest = function, size, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value
