"""What filters remove in every order they can be applied in, read off decision diagrams.

A document fails some of k filters; how many it is alone in failing, and how many another would have
removed before, depends on the order.  Per part of the corpus the documents are counted by the set
of filters they fail (their mask), at most 2^k counts, and a decision diagram is built over them:
a level per filter, a branch for passing and one for failing, equal sub-diagrams shared, every node
weighted by the documents below it.  Going down the passing branches gives the steps of the
diagram's order: what the failing branch weighs is removed, what the passing one weighs is kept.
All k! orders are visited by swapping two neighbouring levels at a time (plain changes); a swap
rewrites the nodes of those two levels and nothing above or below.

One filter needs the whole table: a document fails it if one of smaller id has its text.  Texts
meet as digests of 256 bits.  Equal rows are counted before each exchange: by document first, then by
digest, part and outcome, so that a text that a third of the documents share is a few rows by the
time its digests meet, and only counts go on from there.

Defined cases: a null text is empty, a null part is the empty string; a null doc_id is smaller and
larger than none, so such a document neither fails the filter of copies nor makes others fail it, and
has no labels; rows that repeat id and text pass or fail together; a document is good, or toxic, if any of
its labels says so; an empty table has no parts and gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: The filters by letter; the last one is that of copies.
LETTERS = "ABCDE"

Weight = tuple[int, int, int]  # documents, good ones, toxic ones


# -- masks ---------------------------------------------------------------------------------


def own_failures() -> list[Column]:
    """Conditions on ``n_words``, ``n_distinct`` and ``text`` under which a document fails A to D."""
    capitals = F.char_length(F.regexp_replace("text", "[^A-Z]+", ""))
    return [
        F.col("n_words") < 200,
        100 * F.col("n_distinct") < 50 * F.col("n_words"),
        100 * capitals > 3 * F.char_length("text"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, digest and the mask of the filters that need the document alone, for every row."""
    texts = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = texts.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    sized = split.select(
        "doc_id", "part", "text", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct")
    )
    mask = sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(own_failures())), F.lit(0))
    return sized.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def outcomes(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask over all filters, and the documents (n, n_good, n_toxic) that fail exactly those."""
    copies = 1 << (len(LETTERS) - 1)
    rows = masks(docs, part).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_labelled"))
    flags = flags.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flagged = rows.join(flags, F.col("doc_id") == F.col("_labelled"), "left")
    good, toxic = (F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    named = F.col("doc_id").isNotNull()
    classes = flagged.groupBy("digest", "part", "mask", good, toxic).agg(
        F.sum(F.when(named, F.col("n"))).alias("n_named"),
        F.sum(F.when(~named, F.col("n"))).alias("n_nameless"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"),
    )
    # A digest has a row per part and label here, however many documents share its text.
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    named_n = F.coalesce("n_named", F.lit(0))
    counted = classes.select(
        "part",
        "mask",
        "good",
        "toxic",
        (F.coalesce(passing, F.lit(0)) + F.coalesce("n_nameless", F.lit(0))).alias("n_passing"),
        (named_n - F.coalesce(passing, F.lit(0))).alias("n_failing"),
    )
    each = F.array(
        F.struct(F.col("mask"), F.col("n_passing").alias("n")),
        F.struct(F.col("mask").bitwiseOR(copies).alias("mask"), F.col("n_failing").alias("n")),
    )
    split = counted.select("part", "good", "toxic", F.explode(each).alias("e")).where("e.n > 0")
    return split.groupBy("part", F.col("e.mask").alias("mask")).agg(
        F.sum("e.n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("e.n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("e.n")).otherwise(0)).alias("n_toxic"),
    )


# -- diagrams ------------------------------------------------------------------------------


class Diagram:
    """A quasi-reduced decision diagram of counts by mask, whose neighbouring levels can be swapped.

    Every level maps its nodes to their (passing, failing) children one level down; the level below
    the last holds the counts themselves.  Equal nodes of a level are one.
    """

    def __init__(self, counts: dict[int, Weight], n_filters: int):
        self.order = list(range(n_filters))
        self.weight: list[Weight] = []
        self.children: list[dict[int, tuple[int, int]]] = [{} for _ in self.order]
        self.known: list[dict[tuple, int]] = [{} for _ in self.order]
        self.leaves: dict[Weight, int] = {}
        row = [self._leaf(counts.get(self._reversed(m), (0, 0, 0))) for m in range(1 << n_filters)]
        for level in reversed(self.order):
            row = [self._node(level, low, high) for low, high in zip(row[::2], row[1::2])]
        self.root = row[0]

    def _reversed(self, path: int) -> int:
        """The mask whose first filter is the highest bit of ``path``, as levels are from the top."""
        return sum(1 << i for i in self.order if path >> (len(self.order) - 1 - i) & 1)

    def _new(self, weight: Weight) -> int:
        self.weight.append(weight)
        return len(self.weight) - 1

    def _leaf(self, weight: Weight) -> int:
        if weight not in self.leaves:
            self.leaves[weight] = self._new(weight)
        return self.leaves[weight]

    def _node(self, level: int, low: int, high: int) -> int:
        known = self.known[level]
        if (low, high) not in known:
            a, b = self.weight[low], self.weight[high]
            node = known[low, high] = self._new((a[0] + b[0], a[1] + b[1], a[2] + b[2]))
            self.children[level][node] = (low, high)
        return known[low, high]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next: the upper nodes stay, with new children."""
        below = self.children[level + 1]
        self.children[level + 1], self.known[level + 1] = {}, {}
        self.known[level] = {}
        for node, (low, high) in self.children[level].items():
            (a, b), (c, d) = below[low], below[high]
            own = self._node(level + 1, a, c), self._node(level + 1, b, d)
            self.children[level][node] = own
            self.known[level][own] = node
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """(filter, kept, removed) down the path of documents that pass everything so far."""
        node = self.root
        for level, number in enumerate(self.order):
            node, failing = self.children[level][node]
            yield number, self.weight[node], self.weight[failing]


def plain_changes(size: int) -> Iterator[int]:
    """Places whose neighbours to swap, one after the other, to see all orders of ``size`` things once."""
    if size < 2:
        return
    # The last thing wanders through an order of the others; they change while it is at an end.
    at_end = True
    for change in [*plain_changes(size - 1), None]:
        yield from range(size - 2, -1, -1) if at_end else range(size - 1)
        at_end = not at_end
        if change is not None:
            yield change if at_end else change + 1


def steps_of(counts: dict[int, Weight], letters: str = LETTERS) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    diagram = Diagram(counts, len(letters))
    bits = [1 << i for i in range(len(letters))]
    failing = [sum(w[0] for mask, w in counts.items() if mask & bit) for bit in bits]
    alone = [counts.get(bit, (0, 0, 0))[0] for bit in bits]
    orders, shapley = [], [0] * len(letters)
    for change in [None, *plain_changes(len(letters))]:
        if change is not None:
            diagram.swap(change)
        steps = list(diagram.steps())
        orders.append(steps)
        for number, _, removed in steps:
            shapley[number] += removed[0]
    for steps in orders:
        name = "".join(letters[number] for number, _, _ in steps)
        for step, (number, kept, removed) in enumerate(steps, 1):
            redundant = failing[number] - removed[0]
            yield name, step, kept[0], removed[0], redundant, alone[number], removed[1], removed[2], shapley[number]


COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS)


def _of_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    counts = {int(r.mask): (int(r.n), int(r.n_good), int(r.n_toxic)) for r in rows.itertuples()}
    return pd.DataFrame([(key[0], *step) for step in steps_of(counts)], columns=["part", "filter_order", "step", *COLUMNS])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step; see the module's text."""
    return outcomes(docs, labels, part).groupBy("part").applyInPandas(_of_part, SCHEMA)
