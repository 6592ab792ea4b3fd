"""Suffix-array deduplication: bytes covered by a long string that occurs elsewhere.

A byte goes if a string of ``length`` bytes that covers it also starts at another place, in the
same document or in another.  Strings are judged on the input, and overlaps count.

Not all suffixes are sorted.  Every window of ``length`` bytes holds one anchor, the position in
its first half whose following half window hashes smallest; equal windows have equal anchors.  An
aggregate over the anchors' hashes leaves those that occur again.  Where all occurrences of an
anchor agree in everything its windows cover, that settles them.  For the others a sparse suffix
array is merged:

* the suffixes that start at the anchors, one of each content, are sorted where they are and
  front-coded: each as the length of the prefix it shares with the one before, and the rest;
* these runs are exchanged by the anchor, and a loser tree merges them.  It knows each head's
  common prefix with the last suffix given out, so a known prefix is never compared again, and
  the merged order comes with its array of common prefixes;
* neighbours that share the anchor's half window form a class.  Two members of it have a window in
  common wherever their common suffix beyond, and their common text before the anchor, together
  are long enough.

A class of more than ``full`` members (a passage that many documents share, each with another
text around it) is not brought together.  Its windows are dealt out by what all windows of a block of distances have
in common, so that equal windows meet and those of a member mostly stay together, many to a packed row.  Each task first
finds equal ones among its own and sends one of each on, so a window that very many share is no burden.
Both ways are exact.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; repeated rows
are occurrences of each other, so they lose everything that is long enough; rows without an id
count like others.  Texts of any length are read in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invigil.llm.common import field, slices
from invigil.llm.near import mixed
from invigil.session import stage

LENGTH = 400
FULL = 1000
STRETCH = 1 << 19
PAIRWISE = 40
RUN_BYTES = 32 << 20
BUCKET_ROWS = 4000
#: Distances that are dealt out together; windows of full classes per part, and the fewest parts.
BLOCK = 32
PART_WINDOWS = 1 << 18
LEAST_PARTS = 64

_rng = np.random.default_rng(3)
_LETTER = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(2**62, 2**63)) | 1
_PLACE = np.uint64((1 << 21) - 1)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(size).bit_length()))


class Hashes:
    """Hashes of any substring, from sums over prefixes."""

    def __init__(self, data: bytes):
        self.up, self.down = _table(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[np.frombuffer(data, np.uint8)] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int, n: int) -> np.ndarray:
        """Of the first ``n`` windows of ``size``."""
        return mixed((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(position, nearest, farthest, anchor's hash, hash of all its windows) for one text.

    The windows of an anchor start between ``farthest`` and ``nearest`` bytes before it.
    """
    half = length // 2
    span = length - half + 1
    parts = []
    for begin in range(0, max(0, len(data) - length + 1), STRETCH):
        part = data[begin : begin + STRETCH + length - 1]
        hashes = Hashes(part)
        n_windows, n = len(part) - length + 1, len(part) - half + 1
        grams = hashes.windows(half, n)
        # The place in the low bits makes the leftmost of equal ones the smallest.
        key = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
        key[:n] = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64)
        rows = key.reshape(-1, span)
        upto = np.minimum.accumulate(rows, axis=1).ravel()
        onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(onward[:n_windows], upto[span - 1 : span - 1 + n_windows]) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        last = np.append(first[1:], n_windows) - 1
        at = chosen[first]
        nearest, farthest = at - last, at - first
        region = hashes.of(first, last + length) + mixed((farthest * 1024 + nearest).astype(np.uint64))
        parts.append((at + begin, nearest, farthest, grams[at], region))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*parts))


# -- runs --------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are not looked at."""
    end = min(len(a), len(b))
    differ = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
    return end - (differ.bit_length() + 7) // 8


_RUN = pa.schema(
    [
        ("shared", pa.int32()),
        ("rest", pa.binary()),
        ("before", pa.binary()),
        ("nearest", pa.int32()),
        ("farthest", pa.int32()),
        ("n", pa.int64()),
        ("gram", pa.int64()),
        ("region", pa.int64()),
    ]
)


def front_coded(entries: list[tuple]) -> bytes:
    """A sorted run of (suffix, before, nearest, farthest, n, gram, region), compressed."""
    entries.sort(key=lambda e: e[0])
    shared, rest, last = [], [], b""
    for entry in entries:
        k = common_prefix(last, entry[0])
        shared.append(k)
        rest.append(entry[0][k:])
        last = entry[0]
    columns = [shared, rest, *(list(c) for c in list(zip(*entries))[1:])]
    batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _RUN)], schema=_RUN)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _RUN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Run:
    """Reads a front-coded run; ``head`` is the current suffix, None at the end."""

    def __init__(self, data: bytes):
        with pa.ipc.open_stream(data) as reader:
            table = reader.read_all()
        self.rows = zip(*(table.column(n).to_pylist() for n in _RUN.names))
        self.head: bytes | None = b""
        self.shared, self.row = 0, ()
        self.advance()

    def advance(self) -> None:
        row = next(self.rows, None)
        if row is None:
            self.head, self.shared = None, -1
            return
        self.shared = row[0]
        self.head = self.head[: row[0]] + row[1]
        self.row = row[2:]


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, tuple]]:
    """All suffixes in order, each with its common prefix with the one before.

    Every run in the tree knows how long a prefix its head shares with the last suffix given out.
    The one that shares more is smaller; only equals are compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    known = [r.shared if r.head is not None else -1 for r in runs]
    losers: list[int] = [-1] * size

    def beats(a: int, b: int) -> bool:
        """Whether ``a`` goes before ``b``; the loser's known prefix is then one with the winner."""
        if b < 0 or runs[b].head is None:
            return True
        if a < 0 or runs[a].head is None:
            return False
        if known[a] != known[b]:
            return known[a] > known[b]
        x, y = runs[a].head, runs[b].head
        k = common_prefix(x, y, known[a])
        first = k == len(x) or (k < len(y) and x[k] < y[k])
        known[b if first else a] = k
        return first

    def play(node: int) -> int:
        if node >= size:
            return node - size if node - size < len(runs) else -1
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    # Before anything is given out nothing is shared.
    known = [0] * len(runs)
    winner = play(1)
    while winner >= 0 and runs[winner].head is not None:
        run = runs[winner]
        yield run.head, known[winner], run.row
        run.advance()
        known[winner] = run.shared
        node = (winner + size) // 2
        while node:
            if losers[node] >= 0 and not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


# -- classes -----------------------------------------------------------------------------

Member = tuple[int, int, int, bytes, int, int, int]  # shared with the member before, nearest, farthest, before, n, gram, region


def _joined(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of whole numbers, both ends included, those that meet put together."""
    spans.sort()
    start, end = spans[0]
    for a, b in spans[1:]:
        if a <= end + 1:
            end = max(end, b)
        else:
            yield start, end
            start, end = a, b
    yield start, end


def _pairwise(members: list[Member], length: int) -> Iterator[tuple[int, int, int, int]]:
    found: list[list[tuple[int, int]]] = [[] for _ in members]
    for i, (_, near_i, far_i, before_i, *_rest) in enumerate(members):
        after = length
        for j in range(i + 1, len(members)):
            shared, near_j, far_j, before_j = members[j][:4]
            after = min(after, shared)
            low = max(length - after, near_i, near_j)
            high = min(far_i, far_j)
            if low > high:
                continue
            high = min(high, common_prefix(before_i, before_j))
            if low <= high:
                found[i].append((low, high))
                found[j].append((low, high))
    for member, spans in zip(members, found):
        if spans:
            for low, high in _joined(spans):
                yield member[5], member[6], low, high


def _by_distance(members: list[Member], length: int) -> Iterator[tuple[int, int, int, int]]:
    """The same for many members: for each distance, those that agree on both sides are counted."""
    m = len(members)
    shared = np.array([x[0] for x in members])
    near, far = np.array([x[1] for x in members]), np.array([x[2] for x in members])
    width = int(far.max())
    before = np.zeros((m, width), np.uint8)
    for i, x in enumerate(members):
        before[i, : len(x[3])] = np.frombuffer(x[3], np.uint8)
    up = _table(width + 1)[0]
    left = np.zeros((m, width + 1), np.uint64)
    np.cumsum(_LETTER[before] * up[None, :width], axis=1, out=left[:, 1:])
    again = np.zeros((m, width + 2), bool)
    for distance in range(int(near.min()), width + 1):
        group = np.cumsum(shared < length - distance).astype(np.uint64)
        here = np.flatnonzero((near <= distance) & (far >= distance))
        key = mixed(left[here, distance] + mixed(group[here]))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        again[here, distance] = counts[inverse] > 1
    for i, x in enumerate(members):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], again[i]]).astype(np.int8)))
        for low, end in zip(edges[::2], edges[1::2]):
            yield x[5], x[6], int(low), int(end) - 1


def repeated(blobs: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(gram, region, low, high): at which distances before the anchor repeated windows start."""
    half = length // 2
    members: list[Member] = []

    def settle() -> Iterator[tuple[int, int, int, int]]:
        if len(members) > 1:
            yield from (_pairwise if len(members) <= PAIRWISE else _by_distance)(members, length)

    for _, shared, (before, nearest, farthest, n, gram, region) in merged([Run(b) for b in blobs]):
        if shared < half:
            yield from settle()
            members = []
        members.append((shared, nearest, farthest, before, n, gram, region))
    yield from settle()


# -- full classes ------------------------------------------------------------------------

_WINDOWS = pa.schema([(n, pa.int64()) for n in ("window", "check", "gram", "region")] + [("distance", pa.int32()), ("known", pa.bool_())])


def windows_of(data: bytes, hits: list[dict], length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each window of the anchors a number by which equal ones meet, and the columns of ``_WINDOWS``."""
    block = max(1, min(BLOCK, length // 2))
    sizes = [h["farthest"] - h["nearest"] + 1 for h in hits]
    distance = np.concatenate([np.arange(h["nearest"], h["farthest"] + 1) for h in hits])
    at, gram, region = (np.repeat(np.array([h[c] for h in hits], np.int64), sizes) for c in ("at", "gram", "region"))
    hashes, turned = Hashes(data), Hashes(data[::-1])
    start = at - distance
    # What lies in all windows of the block, whichever of them a member has.
    place = distance // block
    core = hashes.of(at - place * block, at - (place * block + block - 1) + length)
    meet = mixed(core + mixed(place.astype(np.uint64)))
    # Two hashes of each window, read from either end.
    window = hashes.of(start, start + length).view(np.int64)
    check = turned.of(len(data) - start - length, len(data) - start).view(np.int64)
    return meet, [window, check, gram, region, distance.astype(np.int32), np.zeros(len(start), bool)]


def twice(window: np.ndarray, check: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are there again, or known to be, and which are the first of their kind."""
    order = np.lexsort((check, window))
    w, c = window[order], check[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])])
    kind = np.cumsum(new) - 1
    again = (np.bincount(kind) > 1) | (np.bincount(kind, known[order]) > 0)
    repeated, first = np.zeros(len(w), bool), np.zeros(len(w), bool)
    repeated[order], first[order] = again[kind], new
    return repeated, first


def ranges(gram: np.ndarray, region: np.ndarray, distance: np.ndarray) -> list[np.ndarray]:
    """(gram, region, low, high): distances of one content that follow each other put together."""
    order = np.lexsort((distance, region, gram))
    g, r, d = gram[order], region[order], distance[order]
    new = (g[1:] != g[:-1]) | (r[1:] != r[:-1]) | (d[1:] != d[:-1] + 1)
    first = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(g) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(g)) - 1 if len(g) else first
    return [g[first], r[first], d[first], d[last]]


def packed(columns: list[np.ndarray]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _WINDOWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _WINDOWS)], schema=_WINDOWS))
    return sink.getvalue().to_pybytes()


def met(blobs: list[bytes], length: int) -> list[np.ndarray]:
    """(gram, region, low, high) of the windows that turn out to be repeated where those of several tasks meet."""
    tables = []
    for blob in blobs:
        with pa.ipc.open_stream(blob) as reader:
            tables.append(reader.read_all())
    window, check, gram, region, distance, known = (c.to_numpy() for c in pa.concat_tables(tables).itercolumns())
    found = twice(window, check, known)[0] & ~known
    return ranges(gram[found], region[found], distance[found])


# -- tables ------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id`` and ``_hash``, which tell texts apart and are never null."""
    return docs.withColumns(_keys())


def _keys() -> dict[str, Column]:
    return {
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))),
        "_hash": F.xxhash64(F.coalesce("text", F.lit(""))),
    }


def _anchors(keyed: DataFrame, length: int) -> DataFrame:
    names = ["_id", "_hash", "at", "nearest", "farthest", "gram", "region"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, counts = [], []
            for text in part.column("text").to_pylist():
                rows.append(anchors((text or "").encode(), length))
                counts.append(len(rows[-1][0]))
            place = pa.array(np.repeat(np.arange(len(counts)), counts))
            at, near, far, gram, region = (np.concatenate(c) for c in zip(*rows))
            arrays = [part.column("_id").take(place), part.column("_hash").take(place), pa.array(at)]
            arrays += [pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32))]
            arrays += [pa.array(gram.view(np.int64)), pa.array(region.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "_id long, _hash long, at long, nearest int, farthest int, gram long, region long"
    return keyed.select("_id", "_hash", "text").mapInArrow(run, schema)


_LEFT = "kind int, bucket int, run binary, gram long, region long, low int, high int"


def _suffixes(wanted: DataFrame, length: int, buckets: int, parts: int) -> DataFrame:
    """Runs of the classes' suffixes (kind 0), packed windows of full classes (kind 1), and those of their windows that
    a task finds repeated by itself (kind 2)."""
    schema = pa.schema(
        [("kind", pa.int32()), ("bucket", pa.int32()), ("run", pa.binary())]
        + [("gram", pa.int64()), ("region", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]
    )

    def rows(kind: int, n: int, given: dict) -> pa.RecordBatch:
        given = {"kind": np.full(n, kind, np.int32), **given}
        return pa.record_batch([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    def blobs(kind: int, by_bucket: dict[int, bytes]) -> pa.RecordBatch:
        return rows(kind, len(by_bucket), {"bucket": list(by_bucket), "run": list(by_bucket.values())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        loose: list[tuple[np.ndarray, list[np.ndarray]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield blobs(0, {b: front_coded(held[b]) for b in sorted(held)})
                held.clear()
            if loose:
                part = np.concatenate([p for p, _ in loose])
                columns = [np.concatenate(c) for c in zip(*(c for _, c in loose))]
                loose.clear()
                columns[5], first = twice(*columns[:2], columns[5])
                found = ranges(*(columns[i][columns[5]] for i in (2, 3, 4)))
                yield rows(2, len(found[0]), dict(zip(("gram", "region", "low", "high"), found)))
                places = np.flatnonzero(first)
                places = places[np.argsort(part[places], kind="stable")]
                cuts = np.flatnonzero(np.diff(part[places])) + 1
                yield blobs(1, {int(part[p[0]]): packed([c[p] for c in columns]) for p in np.split(places, cuts)})

        for part in slices(batches):
            for text, hits in zip(part.column("text").to_pylist(), part.column("hits").to_pylist()):
                data = (text or "").encode()
                full = [h for h in hits if h["full"]]
                for begin in range(0, len(full), 64):
                    meet, columns = windows_of(data, full[begin : begin + 64], length)
                    loose.append(((meet % np.uint64(parts)).astype(np.int32), columns))
                    size += 41 * len(meet)
                for h in hits:
                    if h["full"]:
                        continue
                    at = h["at"]
                    suffix = data[at : at - h["nearest"] + length]
                    before = data[at - h["farthest"] : at][::-1]
                    held.setdefault(h["gram"] % buckets, []).append(
                        (suffix, before, h["nearest"], h["farthest"], h["n"], h["gram"], h["region"])
                    )
                    size += len(suffix) + len(before) + 64
                if size > RUN_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return wanted.mapInArrow(run, _LEFT)


def _merge(runs: DataFrame, length: int, buckets: int, settled: Callable[[list[bytes], int], Iterable] = repeated) -> DataFrame:
    """What ``settled`` makes of all runs of a bucket: rows, or for ``met`` columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []

        def settle() -> pa.RecordBatch:
            found = settled(blobs, length)
            rows = found if settled is met else list(zip(*found)) or [[], [], [], []]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["gram", "region", "low", "high"])

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("run").to_pylist()):
                if bucket != current and blobs:
                    yield settle()
                    blobs = []
                current = bucket
                blobs.append(blob)
        if blobs:
            yield settle()

    tasks = min(buckets, 20_000)
    together = runs.select("bucket", "run").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(run, "gram long, region long, low int, high int")


def covered(docs: DataFrame, length: int = LENGTH, full: int = FULL) -> DataFrame:
    """(_id, _hash, spans): per text the byte spans (start, end) of repeated strings, unmerged."""
    keyed = _keyed(docs.select("doc_id", "text"))
    every = stage(_anchors(keyed, length), "anchors")
    counts = every.groupBy("gram").agg(F.count("*").alias("n"), F.min("region").alias("_low"), F.max("region").alias("_high"))
    counts = counts.where("n > 1").select(F.col("gram").alias("_gram"), (F.col("_low") == F.col("_high")).alias("settled"))
    counts = stage(counts, "repeated-anchors")
    again = stage(every.join(counts, F.col("gram") == F.col("_gram")).drop("_gram"), "occurrences")

    # One occurrence of each content, where the contents of a class differ.
    mixed_ = again.where(~F.col("settled"))
    contents = mixed_.groupBy("gram", "region").agg(
        F.count("*").alias("n"), F.min(F.struct("_id", "_hash", "at", "nearest", "farthest")).alias("one")
    )
    contents = stage(contents, "contents")
    sizes = contents.groupBy("gram").agg(F.count("*").alias("_size")).where(F.col("_size") > full)
    sizes = stage(sizes.select(F.col("gram").alias("_full"), "_size"), "full-classes")
    marked = contents.join(sizes.select("_full"), F.col("gram") == F.col("_full"), "left")
    hit = F.struct("one.at", "one.nearest", "one.farthest", "n", "gram", "region", F.col("_full").isNotNull().alias("full"))
    hits = marked.groupBy(F.col("one._id").alias("_of"), F.col("one._hash").alias("_with")).agg(F.collect_list(hit).alias("hits"))
    same = (F.col("_id") == F.col("_of")) & (F.col("_hash") == F.col("_with"))
    # Rows that repeat an id and its text are one text here.
    texts = keyed.join(stage(hits, "hits"), same).dropDuplicates(["_id", "_hash"]).select("text", "hits")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), contents.count() // BUCKET_ROWS)
    n_windows = (sizes.agg(F.sum("_size")).first()[0] or 0) * (length - length // 2 + 1)
    parts = max(LEAST_PARTS, n_windows // PART_WINDOWS)
    suffixes = stage(_suffixes(texts, length, buckets, parts), "suffixes")

    merged_ = _merge(suffixes.where("kind = 0"), length, buckets)
    single = _merge(suffixes.where("kind = 1"), length, parts, met)
    own = suffixes.where("kind = 2").select("gram", "region", "low", "high")
    whole = contents.where("n > 1").select("gram", "region", F.col("one.nearest").alias("low"), F.col("one.farthest").alias("high"))
    found = merged_.unionByName(single).unionByName(own).unionByName(whole)
    parts = found.groupBy("gram", "region").agg(F.collect_set(F.struct("low", "high")).alias("parts"))
    parts = stage(parts.select(F.col("gram").alias("_gram"), F.col("region").alias("_region"), "parts"), "repeated-parts")

    found = mixed_.join(parts, (F.col("gram") == F.col("_gram")) & (F.col("region") == F.col("_region")))
    found = found.select("_id", "_hash", "at", F.explode("parts").alias("part")).select("_id", "_hash", "at", "part.low", "part.high")
    settled = again.where("settled").select("_id", "_hash", "at", F.col("nearest").alias("low"), F.col("farthest").alias("high"))
    spans = F.struct((F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))
    return found.unionByName(settled).groupBy("_id", "_hash").agg(F.collect_set(spans).alias("spans"))


def _removed(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs, end excluded."""
    if not spans:
        return []
    return [(a, b + 1) for a, b in _joined([(s["start"], s["end"] - 1) for s in spans])]


def _kept(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in removed for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_spans(docs: DataFrame, length: int, full: int, row: bool = False) -> DataFrame:
    """``docs`` with ``spans``; with ``row``, its columns as one struct ``_row`` instead, and no text beside it."""
    spans = stage(covered(docs, length, full), "spans").withColumnsRenamed({"_id": "_of", "_hash": "_with"})
    same = (F.col("_id") == F.col("_of")) & (F.col("_hash") == F.col("_with"))
    if row:
        whole = F.struct(*[F.col(field(c)) for c in docs.columns]).alias("_row")
        keyed = docs.select(whole, *[c.alias(name) for name, c in _keys().items()])
    else:
        keyed = _keyed(docs)
    return keyed.join(spans, same, "left").drop("_id", "_hash", "_of", "_with")


def deduplicated(docs: DataFrame, length: int = LENGTH, full: int = FULL) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    names = ["n_bytes", "n_removed", "n_spans"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                data, removed = (text or "").encode(), _removed(spans)
                gone = sum(b - a for a, b in removed)
                rows.append((len(data), gone, len(removed), hashlib.sha256(_kept(data, removed)).hexdigest()))
            *numbers, digests = zip(*rows)
            arrays = [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in numbers], pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, "kept_sha256"])

    joined = _with_spans(docs.select("doc_id", "text"), length, full).select("doc_id", "text", "spans")
    fields = [joined.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names], T.StructField("kept_sha256", T.StringType())]
    return joined.mapInArrow(run, T.StructType(fields))


def cut(docs: DataFrame, length: int = LENGTH, full: int = FULL) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; a character that is only partly covered stays."""
    columns = docs.columns
    place = [c.lower() for c in columns].index("text")

    # The text is in the row already; a column of its own would be a second copy in the exchange, the JVM's batch and the worker's.
    def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, spans = batch.columns
        return pa.RecordBatch.from_arrays([row, row.field(place), spans], names=["row", "text", "spans"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(map(with_text, batches)):
            texts = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                removed = _removed(spans)
                if removed:
                    data = text.encode()
                    whole = []
                    for a, b in removed:
                        while a < b and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                        whole.append((a, b))
                    text = _kept(data, whole).decode()
                texts.append(text)
            row = part.column("row")
            fields = list(row.type)
            changed = [pa.array(texts, f.type) if i == place else row.field(i) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(changed, fields=fields)], names=["_row"])

    joined = _with_spans(docs, length, full, row=True).select("_row", "spans")
    changed = joined.mapInArrow(run, joined.select("_row").schema)
    return changed.select(*[F.col("_row")[c].alias(c) for c in columns])
