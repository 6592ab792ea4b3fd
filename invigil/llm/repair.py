"""Structure repair of conversations: weighted CYK over spans of their rows.

A repaired conversation is empty or an optional system turn and then user and assistant in turn,
``(s?(ua)+)?`` over the initials of its roles.  Every row is kept, deleted, given another role, or has
empty turns inserted beside it, at a cost.  The grammar is in Chomsky normal form: its nonterminals
are what a span of rows can become as a part of such a word, named by the first and last initial (``ua``:
starts with u, ends with a; ``""``: nothing), and a rule joins two neighbouring spans whose initials may
follow each other.  A cell holds, for every nonterminal, the smallest (cost, audit); the audit is the
edits' initials in order.  Cells of single rows are closed under insertion on both sides.  Spans
are combined bottom-up by length: 1, 2, 4 and so on.  Since the nonterminals of a span's two halves give all of the
span's wherever it is cut, every cell needs one cut only, and n rows take n - 1 combinations.

Of equal cost the audit that sorts first by ASCII is taken.  That is safe cell by cell: audits of
one span and one cost are never prefixes of each other, as what one has beyond the other would be
insertions, which cost.

A row's first fault counts: blank, a repeat of an earlier role and text, or truncated.  Blank rows and
repeats have to go.

Defined cases: a null role or text is one space, in ``damaged`` a null conv_id or turn as well; rows go by
turn (null first), then role and text; rows without conv_id are one conversation; a role's initial is its first character, whatever the
rest; a conversation without rows left has zeros and empty strings; an empty table gives no rows.  Other
columns are not read.  A conversation is one cell, as its digest has to be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invigil.llm.common import Memo

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}
#: Longer conversations are parsed, not remembered.
SHORT = 64

Cell = dict[str, tuple[int, str]]  # the smallest (cost, audit) by nonterminal

# -- grammar -------------------------------------------------------------------------------

FOLLOWS = {"su", "ua", "au"}
#: What a span can become: first and last initial, ``s`` the system turn alone, empty: nothing.
SPANS = ["", "uu", "ua", "au", "aa", "s", "su", "sa"]
COMPLETE = ["", "ua", "sa"]


def _joined(left: str, right: str) -> str | None:
    """The nonterminal whose rule has these two, if one has."""
    if not left or not right:
        return left or right
    return left[0] + right[-1] if left[-1] + right[0] in FOLLOWS else None


RULES = [(x, y, z) for x in SPANS for y in SPANS if (z := _joined(x, y)) is not None]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for x, y, z in RULES:
        if x in left and y in right:
            (cost, audit), (more, then) = left[x], right[y]
            found = cost + more, audit + then
            if z not in out or found < out[z]:
                out[z] = found
    return out


#: What insertion alone makes of an empty span.
INSERTED: Cell = {"": (0, ""), "uu": (INSERT, "I"), "aa": (INSERT, "I")}
INSERTED = combine(INSERTED, INSERTED)


def leaf(kind: tuple[str, bool, bool]) -> Cell:
    """The cell of one row: (initial, has to go, truncated), closed under insertion."""
    initial, goes, truncated = kind
    cell: Cell = {"": (DELETE, "D")}
    if not goes:
        for role in ROLES:
            cell[2 * role] = (REROLE + truncated, "R")
        if initial in ROLES:
            cell[2 * initial] = (int(truncated), "K")
        elif initial == "s":
            cell["s"] = (int(truncated), "K")
    return combine(combine(INSERTED, cell), INSERTED)


LEAVES = Memo(leaf, 4096)


def parse(kinds: Iterable[tuple[str, bool, bool]]) -> tuple[int, str]:
    """The smallest (cost, audit) that repairs rows of these kinds."""
    cells = [LEAVES[kind] for kind in kinds]
    if not cells:
        return 0, ""
    while len(cells) > 1:
        pairs = [combine(x, y) for x, y in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(pairs) * 2 :]
    return min(cells[0][z] for z in COMPLETE if z in cells[0])


# -- conversations -------------------------------------------------------------------------


class Repaired(NamedTuple):
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str
    rows: list[tuple[str, str, str]]  # edit, role, text


PARSED = Memo(parse, 50_000, SHORT)


def repaired(rows: list[tuple[str, str]]) -> Repaired:
    """A conversation's (role, text) rows in order, repaired at the least cost."""
    seen: set[tuple[str, str]] = set()
    kinds, blank, duplicate, cut = [], 0, 0, 0
    for role, text in rows:
        core = text.rstrip(BLANKS)
        is_blank = not core
        is_repeat = not is_blank and (role, text) in seen
        is_cut = not is_blank and not is_repeat and core[-1] not in ".!?"
        seen.add((role, text))
        blank, duplicate, cut = blank + is_blank, duplicate + is_repeat, cut + is_cut
        # Initials that no rule knows are alike.
        initial = role[:1] if role[:1] in ("u", "a", "s") else ""
        kinds.append((initial, is_blank or is_repeat, is_cut))
    initials = [role[:1] for role, _ in rows]
    illegal = sum(x + y not in FOLLOWS for x, y in zip(initials, initials[1:]))
    kinds = tuple(kinds)
    cost, audit = PARSED[kinds]

    # An odd number of turns starts with the system's; after it user and assistant alternate.
    turns = len(audit) - audit.count("D")
    system, place = turns % 2, 0
    given, out = iter(rows), []
    for edit in audit:
        role, text = next(given) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["ua"[(place - system) % 2]]
        out.append((edit, role, text))
        place += 1
    return Repaired(blank, duplicate, cut, illegal, cost, audit, out)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults that the hash of ``conv_id:turn`` decides, and ``copies`` (0 to 2) of each row."""

    def shown(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fate.alias("_fate")).select(
        "conv_id",
        "turn",
        F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("_fate") == 0, 0).when(F.col("_fate") == 3, 2).otherwise(1).alias("copies"),
    )


def _collected(turns: DataFrame) -> DataFrame:
    """A row per conversation, its rows in order; those with no copies are left out."""
    row = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.col("copies") if "copies" in turns.columns else F.lit(1)).alias("copies"),
    )
    rows = F.sort_array(F.collect_list(F.when(F.col("rows.copies") > 0, F.col("rows"))))
    return turns.select("conv_id", row.alias("rows")).groupBy("conv_id").agg(rows.alias("rows"))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[list[int], Repaired]]:
    for rows in batch.column("rows").to_pylist():
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        yield turns, repaired([(r["role"], r["text"]) for r in rows for _ in range(r["copies"])])


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LARGEST = (1 << 63) - 1


def audit(turns: DataFrame) -> DataFrame:
    """A row per conversation: what is wrong with it, its cheapest repair and the repaired text's digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            counts: dict[str, list[int]] = {c: [] for c in COUNTS}
            audits, digests = [], []
            for numbers, found in _each(batch):
                gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
                for name, value in zip(COUNTS, (min(gaps, _LARGEST), *found[:5])):
                    counts[name].append(value)
                audits.append(found.audit)
                text = "\n".join(f"{role}:{text}" for _, role, text in found.rows)
                digests.append(hashlib.sha256(text.encode()).hexdigest())
            arrays = [batch.column("conv_id"), *[pa.array(c, pa.int64()) for c in counts.values()], pa.array(audits, pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

    collected = _collected(turns)
    fields = [collected.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS]]
    fields += [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]
    return collected.mapInArrow(run, T.StructType(fields))


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0), role, text and the edit that made the row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            place, numbers, edits, roles, texts = [], [], [], [], []
            for i, (_, found) in enumerate(_each(batch)):
                for n, (edit, role, text) in enumerate(found.rows):
                    for column, value in zip((place, numbers, edits, roles, texts), (i, n, edit, role, text)):
                        column.append(value)
            ids = batch.column("conv_id").take(pa.array(place, pa.int64()))
            arrays = [ids, pa.array(numbers, pa.int64()), *[pa.array(c, pa.string()) for c in (roles, texts, edits)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "role", "text", "edit"])

    collected = _collected(turns)
    fields = [collected.schema["conv_id"], T.StructField("turn", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in ("role", "text", "edit")]
    return collected.mapInArrow(run, T.StructType(fields))


def _parts(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of bounded size, one conversation at least."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
