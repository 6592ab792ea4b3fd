"""Declared constraints as audits, driven by the table descriptions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invigil.schema import TABLES, Table
from invigil.session import stage
from invigil.sources.tables import Tables


def _union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _specs(names: Iterable[str] | None) -> list[Table]:
    return [TABLES[n] for n in (names or TABLES)]


def _each_problem(df: DataFrame, spec: Table, problems: list[tuple[str, Column]], out: str) -> DataFrame:
    """One row per problem of a row, all found in a single scan."""
    hits = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in problems]))
    return df.select(
        F.lit(spec.name).alias("table_name"), F.col(spec.key).cast("long").alias("key"), F.explode(hits).alias(out)
    )


def check_violations(tables: Tables, names: Iterable[str] | None = None) -> DataFrame:
    """I-11: rows for which a CHECK rule is false; NULL passes."""
    parts = []
    for spec in _specs(names):
        if spec.checks:
            problems = [(c.name, F.expr(f"NOT ({c.sql})")) for c in spec.checks]
            parts.append(_each_problem(tables[spec.name], spec, problems, "check_name"))
    return _union(parts)


def unique_violations(tables: Tables, names: Iterable[str] | None = None, ci: bool = False) -> DataFrame:
    """I-12: values of a primary or unique key that occur more than once, with their count."""
    return _repeated([(tables[spec.name], spec, [(spec.key,), *spec.unique]) for spec in _specs(names)], ci)


def duplicates(df: DataFrame, spec: Table, ci: bool = False, keys: Iterable[tuple[str, ...]] | None = None) -> DataFrame:
    """The same for the rows of ``df``, by the named keys."""
    return _repeated([(df, spec, list(keys or [(spec.key,), *spec.unique]))], ci)


def _repeated(given: list[tuple[DataFrame, Table, list[tuple[str, ...]]]], ci: bool) -> DataFrame:
    """Two steps: 64-bit hashes of all keys of all tables are counted, in one exchange of a number and a hash
    per key, combined before it; then only rows whose hash occurs twice are compared by their keys themselves.

    Only the key columns are read, and where every hash occurs once the second step has nothing to read for.
    """
    hashed, keyed, number = [], [], 0
    for df, spec, keys in given:
        parts = {c: _comparable(spec, c, ci) for c in dict.fromkeys(c for key in keys for c in key)}
        # A missing part is a value of its own; as JSON, "a|b", "c" and "a", "b|c" stay apart.
        kinds = [
            (number + i, " ".join(key), F.xxhash64(*[p for c in key for p in (parts[c], parts[c].isNull())]),
             F.to_json(F.array(*[parts[c].cast("string") for c in key])), F.concat_ws("|", *[parts[c].cast("string") for c in key]))
            for i, key in enumerate(keys)
        ]
        number += len(keys)
        hashes = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), h.alias("h")) for n, _, h, _, _ in kinds]))
        hashed.append(df.select(hashes.alias("k")).select("k.n", "k.h"))
        keyed.append((df.select(hashes.alias("k"), *parts), spec, kinds))
    counts = _union(hashed).groupBy("n", "h").agg(F.count("*").alias("c"))
    twice = stage(counts.where(F.col("c") > 1).select(F.col("n").alias("_n"), F.col("h").alias("_h")), "repeated-keys")
    found = []
    for rows, spec, kinds in keyed:
        own = twice.where(F.col("_n").between(kinds[0][0], kinds[-1][0]))
        rows = rows.join(own, (F.col("k.n") == F.col("_n")) & (F.col("k.h") == F.col("_h")), "left_semi")
        exact, shown, names = (F.coalesce(*[F.when(F.col("k.n") == kind[0], value(kind)) for kind in kinds]) for value in (
            lambda k: k[3], lambda k: k[4], lambda k: F.lit(k[1])))
        found.append(
            rows.select(names.alias("key_columns"), exact.alias("exact"), shown.alias("shown"))
            .groupBy("key_columns", "exact")
            .agg(F.count("*").alias("n_rows"), F.min("shown").alias("key_value"))
            .where(F.col("n_rows") > 1)
            .select(F.lit(spec.name).alias("table_name"), "key_columns", "key_value", "n_rows")
        )
    return _union(found)


def _comparable(spec: Table, column: str, ci: bool) -> Column:
    if spec.column(column).type != "string":
        return F.col(column)
    text = F.rtrim(F.col(column))
    return F.lower(text) if ci else text


def correct_choice_violations(tables: Tables) -> DataFrame:
    """I-13: questions with more than one correct choice."""
    return (
        tables["MCQChoice"]
        .where("Ch_Correct")
        .groupBy("Ch_QId")
        .agg(F.count("*").alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def reference_violations(tables: Tables, names: Iterable[str] | None = None) -> DataFrame:
    """I-14: rows that point at a row which does not exist; a NULL reference passes.

    One pass over each table: its key and references meet the ids of all their targets one after the other, each in the way that
    suits that target (in place by bucket, broadcast, or exchanged).  Ids go into their joins as they are, so that AQE
    can split a hot one; an id that occurs twice would show a row's other problems twice, which the end undoes.
    """
    parts = []
    for spec in _specs(names):
        if not spec.references:
            continue
        rows = tables[spec.name].select(spec.key, *[c for c in spec.references if c != spec.key])
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        for i, (column, target) in enumerate(spec.references.items()):
            there = tables[target].select(F.col(TABLES[target].key).alias(f"_there{i}"))
            rows = rows.join(there, F.col(column) == F.col(f"_there{i}"), "left")
        problems = [
            F.when(
                F.col(column).isNotNull() & F.col(f"_there{i}").isNull(),
                F.struct(
                    F.lit(column).alias("column_name"), F.lit(target).alias("target"), F.col(column).cast("long").alias("value")
                ),
            )
            for i, (column, target) in enumerate(spec.references.items())
        ]
        lost = rows.select("_row", F.col(spec.key).cast("long").alias("key"), F.explode(F.array_compact(F.array(*problems))).alias("p"))
        lost = lost.distinct()
        parts.append(lost.select(F.lit(spec.name).alias("table_name"), "p.column_name", "p.target", "key", "p.value"))
    return _union(parts)


def value_violations(tables: Tables, names: Iterable[str] | None = None) -> DataFrame:
    """I-15: missing required values and strings longer than declared."""
    parts = []
    for spec in _specs(names):
        problems = []
        for c in spec.columns:
            if c.required:
                problems.append((f"{c.name} is missing", F.col(c.name).isNull()))
            if c.length:
                problems.append((f"{c.name} is too long", F.length(c.name) > c.length))
        parts.append(_each_problem(tables[spec.name], spec, problems, "problem"))
    return _union(parts)


def require_unique(tables: Tables, names: Iterable[str]) -> None:
    """Raise if a key of the named tables occurs twice: joins on it would double rows."""
    require_keys(tables, {n: [(TABLES[n].key,), *TABLES[n].unique] for n in names})


def require_keys(tables: Tables, keys: Mapping[str, list[tuple[str, ...]]]) -> None:
    """Raise if one of the named keys occurs twice."""
    found = _union([duplicates(tables[name], TABLES[name], keys=own) for name, own in keys.items()])
    first = found.limit(1).collect()
    if first:
        raise ValueError(f"duplicate key: {first[0].asDict()}")
