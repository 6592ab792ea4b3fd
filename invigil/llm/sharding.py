"""Random shards by a two-pass external shuffle.

The first pass scatters records over buckets of about ``bucket_bytes`` by a seeded hash.  The
second takes each bucket into memory, shuffles it (Spark's ``shuffle`` is Fisher-Yates) and
writes it.  The buckets in order are a random order of all records, and every shard is an equal
stretch of it: the law is ``rows``, counts at most one apart.

All of it is DataFrame functions.  Records move once, with their text; counts per bucket are read
from the written table.  The buckets' order inside a task is fixed before shuffling and the table
is written before anything is derived from it, so a lost executor changes nothing.

Defined cases: a null text has 0 bytes and counts as size 1; equal texts are spread like any
others, since doc_id takes part in the hash; rows equal in every column come next to nothing in
number in a table with ids, share a bucket, and each gets a place of its own; fewer rows than
shards leave some shards empty; no rows, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invigil.functions.numbering import running_total
from invigil.llm.common import field
from invigil.session import stage

BUCKET_BYTES = 8 << 20
SHARDS = 8


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def checksum(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")))


def shuffled(docs: DataFrame, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` in a written table, with ``_bucket`` and the place ``_in_bucket`` after shuffling."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(size_of())).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), "doc_id", checksum())
    scattered = docs.select(F.pmod(key, F.lit(buckets)).alias("_bucket"), _row(docs, key))
    tasks = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    gathered = scattered.repartition(min(tasks, 100_000), "_bucket").groupBy("_bucket").agg(F.collect_list("_record").alias("_all"))
    gathered = gathered.withColumn("_all", F.array_sort("_all")).sortWithinPartitions("_bucket")
    mixed = gathered.select("_bucket", F.posexplode(F.shuffle("_all", seed)).alias("_in_bucket", "_record"))
    row = F.col("_record")["row"]
    return stage(mixed.select("_bucket", "_in_bucket", *[row[c].alias(c) for c in docs.columns]), "shuffled")


def _row(docs: DataFrame, key: Column) -> Column:
    return F.struct(key.alias("key"), F.struct(*[F.col(field(c)) for c in docs.columns]).alias("row")).alias("_record")


def shards(docs: DataFrame, n: int = SHARDS, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``shard`` (0 to n - 1) and ``slot``, the place in it; these replace such columns."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot", "_bucket", "_in_bucket", "_of", "_before", "_place", "_total")]
    table = shuffled(docs.select(*[F.col(field(c)) for c in kept]), seed, bucket_bytes)
    counts = table.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = running_total(counts, "_bucket", "_before", F.col("_n")).select(F.col("_bucket").alias("_of"), "_before")
    total = table.agg(F.count("*").alias("n")).scalar()
    placed = table.join(before, F.col("_bucket") == F.col("_of")).withColumn("_place", F.col("_before") + F.col("_in_bucket"))
    placed = placed.withColumn("_total", total)
    placed = placed.withColumn("shard", F.expr(f"int(_place * {n}L div _total)"))
    first = F.expr(f"(shard * _total + {n - 1}L) div {n}L")
    return placed.select(*[F.col(field(c)) for c in kept], "shard", (F.col("_place") - first).cast("long").alias("slot"))


def places(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """Where every document went: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    records = docs.select("doc_id", "text", size_of().alias("size"), checksum().alias("text_crc32"))
    # The text moves and is written with its record; what is asked for here is read without it.
    return shards(records, n).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
