"""Order-independent fingerprints of documents: a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines), each the multiset of its sentences.  Every
sentence is hashed to two wide vectors, and a text's vectors are their sums: eight lanes modulo
2**32, which decide equality, and 128 lanes of plus or minus one modulo 2**16, whose cosine
estimates how much two texts share (the error is about 0.09).  Sums know no order, and a
sentence can be added to a fingerprint or taken away again without the rest of the text.

All of it is DataFrame functions.  A text is split and summed inside its row, so nothing is
shuffled for a fingerprint.  Only pairing each document with the next one moves texts, once:
they meet in blocks of 1,024 ids, and one row per block is carried over to the block before.

Defined cases: a null text is empty; a text without sentences has all lanes zero; equal texts
have equal fingerprints and likeness 1; a vector of zeros has likeness 0 with any other.  Rows
with the same id follow each other by text; rows without an id come last; a table of one row is
its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invigil.llm.common import field

BLOCK_BITS = 10
DENSE, SIGNS = 4, 2
_SENTENCE = r"\n|(?<=[.!?]) "
_LOW = 0xFFFFFFFF


def with_vectors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: a struct of ``dense`` and ``lanes`` for the text in column ``text``."""
    units = F.filter(F.split(F.col(text), _SENTENCE), lambda u: u != "")
    df = df.withColumn("_units", units)
    df = df.select("*", *[F.transform("_units", _hashed_with(k)).alias(f"_h{k}") for k in range(DENSE + SIGNS)])

    def total(k: int, lane) -> Column:
        return F.aggregate(f"_h{k}", F.lit(0).cast("long"), lambda s, h: s + lane(h))

    dense, packed = [], []
    for k in range(DENSE):
        dense.append(total(k, lambda h: h.bitwiseAND(F.lit(_LOW))))
        dense.append(total(k, lambda h: F.shiftrightunsigned(h, 32)))
    for k in range(DENSE, DENSE + SIGNS):
        # Bits i and i + 32 of a hash are counted in the two halves of one number.
        for i in range(32):
            packed.append(total(k, lambda h, i=i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(0x100000001))))
    df = df.withColumn("_dense", F.array(*dense)).withColumn("_packed", F.array(*packed))
    ones = F.flatten(F.transform("_packed", lambda p: F.array(p.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(p, 32))))
    n = F.size("_units").cast("long")
    lanes = F.transform(ones, lambda o: ((2 * o - n + 32768).bitwiseAND(F.lit(65535)) - 32768).cast("smallint"))
    vectors = F.struct(F.transform("_dense", lambda x: x.bitwiseAND(F.lit(_LOW))).alias("dense"), lanes.alias("lanes"))
    df = df.withColumn(out, vectors)
    return df.drop("_units", "_dense", "_packed", *[f"_h{k}" for k in range(DENSE + SIGNS)])


def _hashed_with(seed: int):
    return lambda unit: F.xxhash64(F.lit(seed), unit)


def as_text(vectors: str) -> Column:
    """All lanes in lowercase hexadecimal."""
    dense = F.transform(f"{vectors}.dense", lambda x: F.lpad(F.hex(x), 8, "0"))
    lanes = F.transform(f"{vectors}.lanes", lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(65535))), 4, "0"))
    return F.lower(F.concat(F.array_join(dense, ""), F.array_join(lanes, "")))


def plus(left: Column, right: Column, sign: int = 1) -> Column:
    """Vectors of two texts put together or, with ``sign`` -1, of the first without the second."""
    dense = F.zip_with(left["dense"], right["dense"], lambda a, b: (a + sign * b).bitwiseAND(F.lit(_LOW)))
    lanes = F.zip_with(
        left["lanes"],
        right["lanes"],
        lambda a, b: ((a.cast("long") + sign * b.cast("long") + 32768).bitwiseAND(F.lit(65535)) - 32768).cast("smallint"),
    )
    return F.struct(dense.alias("dense"), lanes.alias("lanes"))


def likeness(left: str, right: str) -> Column:
    """Cosine of the lanes, 0 to 1; exactly 1 for equal vectors."""

    def product(a: str, b: str) -> Column:
        both = F.zip_with(f"{a}.lanes", f"{b}.lanes", lambda x, y: x.cast("long") * y.cast("long"))
        return F.aggregate(both, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")

    size = F.sqrt(product(left, left) * product(right, right))
    cosine = F.when(size > 0, product(left, right) / size).otherwise(0.0)
    return F.when(F.col(left) == F.col(right), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``; replaces a column of that name."""
    kept = [c for c in docs.columns if c.lower() != "fingerprint"]
    row = F.struct(*[F.col(field(c)) for c in kept]).alias("row")
    df = with_vectors(docs.select(row, F.coalesce("text", F.lit("")).alias("text")), "text", "vectors")
    return df.select(*[F.col("row")[c].alias(c) for c in kept], as_text("vectors").alias("fingerprint"))


# -- each document and the next ----------------------------------------------------------


def _block(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.shiftright(F.col(doc_id).cast("long"), BLOCK_BITS), F.lit(-(2**62)))


def _next_blocks(ids: DataFrame) -> DataFrame:
    """(block, next_block): every block that has documents and the one below it; the lowest is followed by the highest."""
    return _below(ids.select(_block().alias("block")).distinct(), [BLOCK_BITS, 12])


def _below(blocks: DataFrame, bits: list[int]) -> DataFrame:
    """The same for any ``block`` numbers, level by level: however the ids are spread over 64 bits, a window holds at most
    2^20 blocks, 2^12 stretches of them, or 2^12 stretches of those at the top."""
    falling = F.desc("block")
    if not bits:
        whole = Window.orderBy(falling).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return blocks.select("block", F.coalesce(F.lead("block").over(Window.orderBy(falling)), F.first("block").over(whole)).alias("next_block"))
    stretch = F.shiftright("block", bits[0])
    highest = blocks.groupBy(stretch.alias("_stretch")).agg(F.max("block").alias("_highest"))
    after = _below(highest.select(F.col("_stretch").alias("block")), bits[1:]).withColumnsRenamed({"block": "_of"})
    after = after.join(highest, F.col("next_block") == F.col("_stretch")).select("_of", "_highest")
    inside = F.lead("block").over(Window.partitionBy(stretch).orderBy(falling))
    found = blocks.select("block", stretch.alias("_in"), inside.alias("_inside")).join(after, F.col("_in") == F.col("_of"))
    return found.select("block", F.coalesce("_inside", "_highest").alias("next_block"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): ``next`` is the text of the document that follows in descending order
    of doc_id; the last is followed by the first.  Texts are exchanged once: the rows that open a
    block are read from the same exchange."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _block().alias("_block"))
    falling = Window.partitionBy("_block").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.select("*", F.lead("text").over(falling).alias("_next"), F.lag("text").over(falling).alias("_before"))

    heads = rows.where(F.col("_before").isNull()).select(F.col("_block").alias("_of"), F.col("text").alias("_first"))
    blocks = _next_blocks(docs.select("doc_id")).select(F.col("block").alias("_last_of"), "next_block")
    heads = blocks.join(heads, F.col("next_block") == F.col("_of")).select("_last_of", "_first")
    # Only a block's last row has no next one in it; a text is never null here.
    rows = rows.join(heads, F.col("_block") == F.col("_last_of"), "left")
    return rows.select("doc_id", "text", F.coalesce("_next", "_first").alias("next"))


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike they are.

    The edited text ends with the beginning of the next document: half of the code points.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("_half", F.expr("n_chars div 2"))
    edited = F.expr("concat(substring(text, 1, int(n_chars - _half)), substring(next, 1, int(_half)))")
    rows = rows.select("doc_id", "n_chars", "text", "next", edited.alias("_edited"))
    rows = with_vectors(rows, "text", "vectors").drop("text")
    rows = with_vectors(rows, "next", "_following").drop("next")
    rows = with_vectors(rows, "_edited", "_changed")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text("vectors").alias("fingerprint"),
        as_text("_changed").alias("edited_fingerprint"),
        likeness("vectors", "_changed").alias("near_edited"),
        likeness("vectors", "_following").alias("near_next"),
    )
