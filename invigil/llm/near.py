"""Near-duplicate groups by MinHash and an LSH forest.

A document's set holds its distinct shingles of five words.  Documents with the same set are one
class from the start, so exact copies, however many, are one row from then on.  The forest is a
number of sorted orders of the classes, each by a rotation of the MinHash signature.  Classes
that share a prefix of four values in an order form a region; a region that is too full is cut by
longer prefixes (its own depth), at the end into parts of bounded size.  In each the neighbours in
the sorted order, which have the longest common prefix, are candidates, and so is each member
with the member most like all.  Signatures drop candidates that cannot reach the threshold; the
others are confirmed on full sets.

That links most of each group with few pairs.  What it may have left is then closed: regions at
the first depth that still hold several components are gone through with the full sets at hand (a
full one as pairs of its parts), and give the links that join components, not pairs.  So a longer
prefix saves work and loses nothing.  No pair inside a component is ever listed.  Regions of one component,
as a group of thousands of copies makes them, are dropped by an aggregate before that; in others the
largest component is not set against itself.  Of n members, m outside the largest component, at
most m * n pairs are compared and about 2 * m * n / 512 + n rows of sets carried.

With 24 orders, a link at the threshold escapes all regions with a probability of about 3e-8 at
0.85 and 3e-6 at 0.8, and 1e-6 comes from the signature filter; a group needs only enough links to
hold together.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing;
fewer than five words are one shingle; rows that repeat an id and its text get the same result;
rows that repeat an id with another text are documents of their own, and of those that share a
group's smallest id one text is kept (of the smallest hash); rows without an id take no part
(component null, kept).  Components are found by passing on the smallest number of a class,
doubling pointers each round; nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invigil.llm.common import slices
from invigil.session import stage

WORDS = 5
TREES, PREFIX, DEEPEST = 24, 4, 8
HASHES = TREES * PREFIX
REGION = 512
SLACK = 18
_ODD = (np.random.default_rng(5).integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
SET_BYTES = 5


def mixed(v: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all 64 (multiply and shift)."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    value = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        value = mixed(value * _STEP + hashed[i : len(words) - size + 1 + i])
    return np.unique(value)


def signature(values: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 4096):
        least = np.minimum(least, (values[None, start : start + 4096] * _ODD[:, None]).min(axis=1))
    return mixed(least)


_PROFILE = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("keys", T.BinaryType()),
    T.StructField("signature", T.BinaryType()),
]


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, size and digest of the set; one key per tree and a byte per hash of the signature."""
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    names = ["doc_id", "text_hash", *[f.name for f in _PROFILE]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(1, TREES + 1, dtype=np.uint64)
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                values = shingles(text)
                if not len(values):
                    rows.append((0, None, None, None))
                    continue
                own = signature(values)
                keys = tree.copy()
                for column in own.reshape(TREES, PREFIX).T:
                    keys = mixed(keys * _STEP + column)
                digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                rows.append((len(values), digest, keys.tobytes(), own.astype(np.uint8).tobytes()))
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *arrays], names=names)

    return narrow.mapInArrow(run, T.StructType([narrow.schema["doc_id"], narrow.schema["text_hash"], *_PROFILE]))


# -- regions of the forest ---------------------------------------------------------------


def _members(classes: DataFrame) -> DataFrame:
    """(key, tree, node): each class in each tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            trees = np.tile(np.arange(TREES, dtype=np.int32), n)
            nodes = batch.column("node").take(pa.array(np.repeat(np.arange(n), TREES)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(trees), nodes], names=["key", "tree", "node"])

    return classes.select("node", "keys").mapInArrow(run, "key long, tree int, node long")


def _counted(members: DataFrame) -> DataFrame:
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return members.join(counts.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).drop("_key")


def in_parts(members: DataFrame, limit: int) -> DataFrame:
    """(key, tree, parts, part, node): fuller regions than ``limit`` cut into parts of about that size."""
    parts = F.ceil(F.col("n") / limit).cast("int")
    # Another seed in each tree: what one tree's parts keep apart meets in another's.
    part = F.pmod(F.xxhash64("tree", "node"), parts).cast("int")
    return members.select("key", "tree", parts.alias("parts"), part.alias("part"), "node")


def deepened(members: DataFrame, classes: DataFrame, limit: int = REGION) -> DataFrame:
    """The regions with longer prefixes where they are fuller than ``limit``, and only there."""
    done, found = [], members
    for depth in range(PREFIX, DEEPEST):
        if not found.where(F.col("n") > limit).take(1):
            break
        done.append(found.where(F.col("n") <= limit))
        full = found.where(F.col("n") > limit).drop("n")
        bytes_ = classes.select(F.col("node").alias("_node"), "signature")
        place = (F.col("tree") * PREFIX + depth) % HASHES
        value = F.substring("signature", place + 1, F.lit(1))
        deeper = full.join(bytes_, F.col("node") == F.col("_node")).withColumn("key", F.xxhash64("key", value))
        found = stage(_counted(deeper.select("key", "tree", "node")), "deeper-regions")
    for more in done:
        found = found.unionByName(more)
    return in_parts(found, limit)


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that agree on ``keys``, one batch each."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changes |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist()]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)
        rest = batch.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _signatures(run: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(run.column("signature").to_pylist()), np.uint8).reshape(run.num_rows, HASHES)


def _pairs(left: list, right: list) -> pa.RecordBatch:
    a, b = np.array(left, np.int64), np.array(right, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _in_runs(rows: DataFrame, keys: list[str], pairs_of) -> DataFrame:
    """Distinct pairs that ``pairs_of`` finds in each run of ``keys``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for own in _runs(batches, keys):
            if own.num_rows > 1:
                for a, b in pairs_of(own):
                    left.append(a)
                    right.append(b)
            if sum(map(len, left)) > 100_000:
                yield _pairs(np.concatenate(left), np.concatenate(right))
                left, right = [], []
        if left:
            yield _pairs(np.concatenate(left), np.concatenate(right))

    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(run, "a long, b long").where("a < b").distinct()


def _neighbours(least: int):
    """Neighbours in the sorted order, and each member with the one nearest to all."""

    def pairs(run: pa.RecordBatch):
        nodes, own = run.column("node").to_numpy(), _signatures(run)
        # The tree's own rotation: the hashes from its offset on, then those before it.
        order = np.lexsort(np.roll(own, -PREFIX * run.column("tree")[0].as_py(), axis=1).T[::-1])
        nodes, own = nodes[order], own[order]
        alike = (own[1:] == own[:-1]).sum(axis=1) >= least
        yield nodes[:-1][alike], nodes[1:][alike]
        if len(nodes) > 2:
            common = np.array([np.bincount(c, minlength=256).argmax() for c in own.T], np.uint8)
            hub = int((own == common).sum(axis=1).argmax())
            alike = (own == own[hub]).sum(axis=1) >= least
            alike[hub] = False
            yield np.full(int(alike.sum()), nodes[hub]), nodes[alike]

    return pairs


# -- confirming on full sets -------------------------------------------------------------


def _sets(docs: DataFrame) -> DataFrame:
    """(node, members): the set, 40 bits of each hash, sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = []
            for text in part.column("text").to_pylist():
                top = np.unique(shingles(text) >> np.uint64(64 - 8 * SET_BYTES))
                sets.append(top.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "members"])

    return docs.mapInArrow(run, "node long, members binary")


def _numbers(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").ravel()


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of some nodes.  Texts and nodes meet in the same way however many nodes there are.

    A node's text is that of its class's head, by id and hash of the text: another text under the
    same id is of another class.
    """
    heads = classes.select(F.col("node").alias("_node"), F.col("head.doc_id").alias("_head"), F.col("head.text_hash").alias("_hash"))
    heads = nodes.distinct().join(heads, F.col("node") == F.col("_node")).drop("_node")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.xxhash64("text").alias("_text"))
    texts = texts.join(heads.hint("merge"), (F.col("_id") == F.col("_head")) & (F.col("_text") == F.col("_hash")))
    return stage(_sets(texts.dropDuplicates(["_id", "_text"]).select("node", "text")), "sets")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    # The smaller set bounds the intersection, the larger one the union.
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` that are links."""
    pairs = stage(pairs, "pairs")
    one = sets.select(F.col("node").alias("_a"), F.col("members").alias("x"))
    two = sets.select(F.col("node").alias("_b"), F.col("members").alias("y"))
    # The second member of a pair is met first: a hub, with many pairs, is mostly the first, and
    # its partition can be split.
    both = pairs.join(two, F.col("b") == F.col("_b")).join(one, F.col("a") == F.col("_a")).select("a", "b", "x", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(_numbers(x.as_py()), _numbers(y.as_py()), percent) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(both.mapInArrow(run, "a long, b long"), "links")


def open_cells(labelled: DataFrame, limit: int) -> DataFrame:
    """(key, tree, part, node, component, i, j): members of regions of several components in cells.

    Only pairs of different components have to meet.  So the largest component of a region is never
    set against itself: its parts meet the parts of the others, and these each other.
    """
    sizes = stage(labelled.groupBy("key", "component").agg(F.count("*").alias("n")), "region-components")
    regions = sizes.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("_most"), F.sum("n").alias("_n"), F.count("*").alias("_components")
    )
    rest, most = F.col("_n") - F.col("_most.n"), F.col("_most.n")
    regions = regions.where(F.col("_components") > 1).select(
        F.col("key").alias("_key"),
        F.col("_most.component").alias("_largest"),
        F.ceil(rest / limit).cast("int").alias("_others"),
        F.ceil(most / limit).cast("int").alias("_parts"),
    )
    members = labelled.join(stage(regions, "open-regions"), F.col("key") == F.col("_key"))
    # Parts of the others are numbered first, and meet all; those of the largest meet the others'.
    in_largest = F.col("component") == F.col("_largest")
    seed = F.xxhash64("tree", "node")
    part = F.when(in_largest, F.col("_others") + F.pmod(seed, F.col("_parts"))).otherwise(F.pmod(seed, F.col("_others")))
    met = F.when(in_largest, F.col("_others")).otherwise(F.col("_others") + F.col("_parts"))
    placed = members.select("key", "tree", part.cast("int").alias("part"), "node", "component", met.alias("_met"))
    return placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_met") - 1))).select(
        "key", "tree", "part", "node", "component", F.least("part", "_other").alias("i"), F.greatest("part", "_other").alias("j")
    )


def closed(cells: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b): links that join components within each cell, as few as it takes.

    ``cells`` has, for each member, its component, signature, tree keys and set.  A pair of
    components is done with the first link between them, and a pair of members is looked at in
    the first tree alone in which they share a region.
    """

    def links(run: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        nodes, own = run.column("node").to_pylist(), _signatures(run)
        component, part = run.column("component").to_numpy(), run.column("part").to_numpy()
        keys = np.frombuffer(b"".join(run.column("keys").to_pylist()), np.int64).reshape(-1, TREES)
        earlier = keys[:, : run.column("tree")[0].as_py()]
        members = run.column("members")
        sets: dict[int, np.ndarray] = {}
        two = run.column("i")[0].as_py() != run.column("j")[0].as_py()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = _numbers(members[k].as_py())
            return sets[k]

        labels = component.tolist()
        for start in range(0, len(nodes), 32):
            rows = slice(start, start + 32)
            fits = component[rows, None] != component[None, start:]
            if two:
                fits &= part[rows, None] != part[None, start:]
            if not fits.any():
                continue
            fits &= (own[rows, None] == own[None, start:]).sum(axis=2) >= least
            x, y = np.nonzero(fits)
            x, y = x + start, y + start
            new = (x < y) & ~(earlier[x] == earlier[y]).any(axis=1)
            for i, j in zip(x[new].tolist(), y[new].tolist()):
                a, b = root(labels[i]), root(labels[j])
                if a != b and _linked(set_of(i), set_of(j), percent):
                    parent[max(a, b)] = min(a, b)
                    yield nodes[i], nodes[j]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches, ["key", "i", "j"]):
            found = list(links(own)) if own.num_rows > 1 else []
            if found:
                yield _pairs(*zip(*found))

    by = ["key", "i", "j"]
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(cells.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long"), "more-links")


# -- components --------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node with a link."""
    edges = stage(links.union(links.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = stage(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        other = labels.select(F.col("node").alias("_node"), F.col("component").alias("_label"))
        around = edges.join(other, F.col("b") == F.col("_node")).groupBy("a").agg(F.min("_label").alias("_around"))
        seen = labels.join(around, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("_old"), F.least("component", "_around").alias("_near")
        )
        jump = labels.select(F.col("node").alias("_node"), F.col("component").alias("_far"))
        after = seen.join(jump, F.col("_near") == F.col("_node"), "left")
        after = after.select("node", "_old", F.least("_near", F.coalesce("_far", "_near")).alias("component"))
        new = stage(after, "labels")
        if not new.where(F.col("_old") != F.col("component")).take(1):
            return new.select("node", "component")
        labels = new.select("node", "component")


def groups(docs: DataFrame, percent: int = 85, region: int = REGION) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and the digest of its set."""
    return _grouped(docs, percent, region).drop("text_hash")


def _grouped(docs: DataFrame, percent: int, region: int) -> DataFrame:
    """``groups`` with the hash of each text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = stage(profiles(docs), "profiles")
    least = int(HASHES * (percent - SLACK) / 100)
    with_set = known.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # A class has a number of its own, since ids may repeat with other texts; its head is its first document.
    head = F.min(F.struct("doc_id", "text_hash")).alias("head")
    classes = with_set.groupBy("digest").agg(head, F.first("keys").alias("keys"), F.first("signature").alias("signature"))
    classes = stage(classes.sortWithinPartitions("digest").withColumn("node", F.monotonically_increasing_id()), "classes")
    found = stage(_counted(_members(classes)), "regions")

    own = classes.select(F.col("node").alias("_node"), "signature")
    members = deepened(found, classes, region).join(own, F.col("node") == F.col("_node")).drop("_node")
    sets = _sets_of(docs, classes, found.select("node"))
    links = confirmed(_in_runs(members, ["key", "part"], _neighbours(least)), sets, percent)
    labels = components(links)

    # What is still apart in some region.
    label = labels.select(F.col("node").alias("_node"), F.col("component").alias("_label"))
    now = found.select("key", "tree", "node").join(label, F.col("node") == F.col("_node"), "left").select(
        "key", "tree", "node", F.coalesce("_label", "node").alias("component")
    )
    cells = open_cells(stage(now, "labelled"), region)
    sets = sets.withColumnRenamed("node", "_of")
    own = classes.select(F.col("node").alias("_node"), "keys", "signature").join(sets, F.col("_node") == F.col("_of")).drop("_of")
    more = closed(cells.join(own, F.col("node") == F.col("_node")).drop("_node"), least, percent)
    if more.take(1):
        labels = components(links.union(more))

    label = labels.select(F.col("node").alias("_node"), "component")
    of_class = classes.select("digest", "node", "head").join(label, F.col("node") == F.col("_node"), "left")
    of_class = stage(of_class.select(F.col("digest").alias("_digest"), "head", F.coalesce("component", "node").alias("component")), "components")
    heads = stage(of_class.groupBy("component").agg(F.min("head").alias("_head")).withColumnRenamed("component", "_component"), "heads")
    of_class = stage(of_class.join(heads, F.col("component") == F.col("_component")).select("_digest", "_head"), "class-heads")
    rows = known.select("doc_id", "text_hash", "n_shingles", "digest").join(of_class, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_head.doc_id", "doc_id"))
    first = (F.col("doc_id") == F.col("_head.doc_id")) & (F.col("text_hash") == F.col("_head.text_hash"))
    return rows.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.when(F.col("doc_id").isNull(), True).otherwise(F.coalesce(first, F.lit(True))).alias("kept"),
        "digest",
    )


def kept(docs: DataFrame, percent: int = 80, region: int = REGION) -> DataFrame:
    """The rows of ``docs`` with one document of each group: that of the smallest id.

    Of rows that repeat an id and its text one stays; rows without an id all stay.
    """
    stay = _grouped(docs, percent, region).where(F.col("kept") & F.col("doc_id").isNotNull())
    stay = stay.select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash")).distinct()
    same = (docs["doc_id"].cast("long") == stay["_kept_id"]) & (F.xxhash64(docs["text"]) == stay["_kept_hash"])
    named = docs.where(F.col("doc_id").isNotNull()).join(stay, same, "left_semi")
    return named.dropDuplicates(["doc_id", "text"]).unionByName(docs.where(F.col("doc_id").isNull()))
