"""Exact top-k search by inner product, pruning block by block.

A vector's components, as whole numbers (``floor(256 x)``), are its terms.  Vectors are cut into
blocks of 64, halved again and again along the widest component so that a block holds like
vectors.  A block keeps each component's largest and smallest value, which bound any query's
score in it, and a forward index: the vectors themselves.  In each pack of vectors a query takes the
blocks in its own order, the best bound first, and scores them through the forward index until the bounds fall
below its k-th best score; a bound equal to it is still followed, so ties go to the smaller id.
Queries that want the same block in a turn share the work.

Both sides travel in packs of bounded size.  The index is written once.  Packs of queries and of vectors are
dealt into cells, a range of one against a range of the other, whose bytes are bounded; a cell is one cogroup, in which a
query's k-th score goes on from pack to pack.  The number of cells follows the data, nothing is broadcast, and only
k results per query and cell are exchanged afterwards.

Scores are exact: in floating point only where every sum is a whole number below 2^53, else in 64-bit or
in Python's whole numbers, bounds as well.

Defined cases: vectors that are null or hold a null or non-finite component (or one that is not finite times
256), and rows without an id, take no part.  Missing components of a shorter vector count as 0.  Rows that share
the query's id are its own; rows that repeat another id are candidates each.  Scores beyond 64 bits count as the nearest
long, as that is the type of the result.  No rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invigil.session import stage

BLOCK = 64
PACK = 4096
QUERIES = 256
#: Bytes of vectors, and of queries, in a cell.
CELL, ASKED = 32 << 20, 8 << 20
_LARGEST = 2**63 - 1


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part, and their components, whole numbers that a double holds."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(256.0 * values.to_numpy(zero_copy_only=False).astype(np.float64))
    bad = ~np.isfinite(scaled)
    if values.null_count:
        bad |= values.is_null().to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(bad)])
    good = upto[offsets[1:]] == upto[offsets[:-1]]
    if vectors.null_count:
        good &= ~vectors.is_null().to_numpy(zero_copy_only=False)
    return good, [scaled[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(good)]


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out.astype(np.int32) if np.abs(out).max(initial=0) < 2**31 else out


def _packs(size: int, blocks: bool):
    """A mapInArrow function that turns (vec_id, embedding) into packs of ``size`` vectors."""

    def pack(ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        numbers, matrix = np.array(ids, np.int64), _matrix(rows)
        if blocks:
            order = np.concatenate(_halved(matrix, np.arange(len(matrix))))
            numbers, matrix = numbers[order], matrix[order]
        return pa.record_batch(
            [
                pa.array([len(numbers)], pa.int32()),
                pa.array([matrix.shape[1]], pa.int32()),
                pa.array([matrix.dtype == np.float64]),
                pa.array([numbers.tobytes()], pa.binary()),
                pa.array([matrix.tobytes()], pa.binary()),
            ],
            names=["n", "width", "long", "ids", "vectors"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []
        for batch in batches:
            good, own = whole_numbers(batch.column("embedding"))
            ids += batch.column("vec_id").filter(pa.array(good)).to_pylist()
            rows += own
            while len(ids) >= size:
                yield pack(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if ids:
            yield pack(ids, rows)

    return run


def _halved(matrix: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows in blocks of at most ``BLOCK``, split at the median of the widest component."""
    if len(rows) <= BLOCK or not matrix.shape[1]:
        return [rows]
    own = matrix[rows]
    order = rows[np.argsort(own[:, own.std(axis=0).argmax()], kind="stable")]
    half = max(1, len(order) // BLOCK // 2) * BLOCK
    return [*_halved(matrix, order[:half]), *_halved(matrix, order[half:])]


PACKED = "n int, width int, long boolean, ids binary, vectors binary"


class Search:
    """The best candidates so far of one pack of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.blocks_scored = self.blocks_seen = 0

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """A row of scores and ids of candidates for each of some queries; own ids and scores of -inf do not count."""
        if self.scores.dtype == object:
            for row, own, others in zip(rows, scores.tolist(), ids.tolist()):
                given = [(s, i) for s, i in zip(own, others) if i != self.ids[row] and s != -np.inf]
                held = [(s, i) for s, i in zip(self.scores[row], self.found[row].tolist()) if s != -np.inf]
                best = sorted(held + given, key=lambda c: (-c[0], c[1]))[: self.k]
                self.scores[row, : len(best)] = [s for s, _ in best]
                self.found[row, : len(best)] = [i for _, i in best]
            return
        scores = np.where(ids == self.ids[rows, None], -np.inf, scores)
        better = scores.max(axis=1, initial=-np.inf) >= self.scores[rows, -1]
        rows, scores = rows[better], scores[better]
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.found[rows], ids[better]], axis=1)
        all_ids = np.where(np.isneginf(all_scores), np.iinfo(np.int64).max, all_ids)
        best = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, best, axis=1)
        self.found[rows] = np.take_along_axis(all_ids, best, axis=1)

    def visit(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Go through one pack of vectors: every query through its blocks, best bounds first, until none can matter."""
        width = min(vectors.shape[1], self.queries.shape[1])
        queries, vectors = self.queries[:, :width], vectors[:, :width]
        # Python's numbers: their product does not overflow.
        largest = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, width)
        kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64 if largest < 2**62 else object
        exact = kind in (np.int64, object)
        if exact:
            self.scores = self.scores.astype(object)
        queries, vectors = _as(kind, queries), _as(kind, vectors)
        starts = np.arange(0, len(ids), BLOCK)
        high = np.stack([vectors[s : s + BLOCK].max(axis=0) for s in starts])
        low = np.stack([vectors[s : s + BLOCK].min(axis=0) for s in starts])
        bounds = np.maximum(queries, kind(0) if kind is not object else 0) @ high.T
        bounds = bounds + np.minimum(queries, kind(0) if kind is not object else 0) @ low.T
        bounds = bounds.astype(object if exact else np.float64)
        order = np.argsort(-bounds, axis=1, kind="stable")
        every = np.arange(len(self.ids))
        self.blocks_seen += bounds.size
        # Blocks side by side, the last one filled up; queries that want the same block in a turn share a product.
        missing = len(starts) * BLOCK - len(ids)
        blocks = np.concatenate([vectors, np.zeros((missing, width), vectors.dtype)]).reshape(len(starts), BLOCK, width)
        numbers = np.concatenate([ids, np.zeros(missing, np.int64)]).reshape(len(starts), BLOCK)
        filled = (np.arange(len(starts) * BLOCK) < len(ids)).reshape(len(starts), BLOCK)
        for turn in range(len(starts)):
            wanted = order[:, turn]
            rows = np.flatnonzero((bounds[every, wanted] >= self.scores[:, -1]).astype(bool))
            if not len(rows):
                break
            wanted = wanted[rows]
            scores = np.empty((len(rows), BLOCK), kind)
            for block in np.unique(wanted):
                here = np.flatnonzero(wanted == block)
                scores[here] = queries[rows[here]] @ blocks[block].T
            if kind is object:
                scores = np.clip(scores, -_LARGEST, _LARGEST)
            scores = scores.astype(self.scores.dtype)
            scores[~filled[wanted]] = -np.inf
            self.offer(rows, scores, numbers[wanted])
            self.blocks_scored += len(rows)

    def rows(self, pack: int) -> pa.RecordBatch:
        at, place = np.nonzero(self.scores != -np.inf)
        score = [int(s) for s in self.scores[at, place]]
        return pa.record_batch(
            [
                pa.array(np.full(len(at), pack), pa.int64()),
                pa.array(at, pa.int64()),
                pa.array(self.ids[at], pa.int64()),
                pa.array(self.found[at, place], pa.int64()),
                pa.array(score, pa.int64()),
            ],
            schema=FOUND,
        )


def _as(kind: type, numbers: np.ndarray) -> np.ndarray:
    if kind is not object:
        return numbers.astype(kind)
    return np.array([[int(x) for x in row] for row in numbers.tolist()], object).reshape(numbers.shape)


def _unpacked(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    n, width, long, ids, vectors = (table.column(c)[i].as_py() for c in ("n", "width", "long", "ids", "vectors"))
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64 if long else np.int32).reshape(n, width)


def _ranges(packs: DataFrame, number: str, limit: int, least: int = 1) -> tuple[DataFrame, int]:
    """``packs`` with the range of about ``limit`` bytes (one pack at least) that each is in, and how many there are:
    ``least``, if there are as many packs."""
    size = F.octet_length("vectors") + F.octet_length("ids")
    count, most = packs.agg(F.count("*"), F.max(size)).first()
    parts = max(1, -(-count // max(1, limit // (most or 1))), min(least, count))
    return packs.withColumn("part", F.pmod(F.xxhash64(number), F.lit(parts)).cast("int")), parts


def top_k(embeddings: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``asks`` holds, the k best others."""
    known = embeddings.select("vec_id", "embedding", asks.alias("asks")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    known = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "asks")
    index = known.select("vec_id", "embedding").mapInArrow(_packs(PACK, True), PACKED)
    index = stage(index.withColumn("slab", F.monotonically_increasing_id()), "vector-index")
    asked = known.where("asks").select("vec_id", "embedding").mapInArrow(_packs(QUERIES, False), PACKED)
    asked = stage(asked.withColumn("pack", F.monotonically_increasing_id()), "queries")

    queries, n_left = _ranges(asked, "pack", ASKED)
    slabs, n_right = _ranges(index, "slab", CELL, embeddings.sparkSession.sparkContext.defaultParallelism // n_left)
    left = queries.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = slabs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))

    def cell(asked_here: pa.Table, vectors: pa.Table) -> pa.Table:
        found = []
        packs = [_unpacked(vectors, i) for i in range(vectors.num_rows)]
        for i in range(asked_here.num_rows):
            search = Search(*_unpacked(asked_here, i), k)
            for pack in packs:
                search.visit(*pack)
            found.append(search.rows(asked_here.column("pack")[i].as_py()))
        return pa.Table.from_batches(found, schema=FOUND)

    cells = left.groupBy("part", "other").cogroup(right.groupBy("other", "part"))
    found = cells.applyInArrow(cell, "pack long, row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("pack", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


FOUND = pa.schema([(n, pa.int64()) for n in ("pack", "row", "query_id", "vec_id", "score")])
