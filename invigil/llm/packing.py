"""Best-fit packing with Martello-Toth dominance reduction.

A document's tokens, and an end mark, fill one piece; longer documents are cut into pieces of
the full capacity.  Pieces go into as few sequences as can be found.

Sizes are whole numbers up to the capacity, so the instance, at any scale, is a histogram of at
most ``capacity`` counts.  The reduction takes the largest size and looks for a set of at most
three pieces that dominates every other set with that size: nothing fits beside it; a piece
fills the rest exactly; at most one piece fits beside it, and the largest that does is taken; or
at most two fit, and the largest single one, or the best two, can stand for any others.  Such
sets are fixed once and for all, the counts shrink, and the rest is packed best fit decreasing.
Only this histogram and the patterns that come of it (a few per size) reach the driver.

Every piece has a number among those of its size, counted by blocks, and the patterns hand out
these numbers in ranges; a join on the size tells each piece its sequence and offset.

Defined cases: null and empty texts are one piece with the end mark alone; an empty table gives
no rows; rows with equal or null doc_id are pieces of their own; equal sizes are told apart by
doc_id, piece and contents, so the result does not depend on the order of rows.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invigil.functions.numbering import running_total
from invigil.llm.common import slices, tokenizer_path
from invigil.session import stage

CAPACITY = 2048
END = 0
BLOCK_ROWS = 1024
#: Words after which a worker starts its memory anew, the last such memory beside it, and the bytes up to which it remembers them.
KNOWN = 250_000
RESTING = 50_000
SHORT = 64

Pattern = tuple[tuple[int, int], ...]  # (size, how many), in the order of their places


def vocabulary_path() -> str:
    return tokenizer_path("word_bpe_49k.json")


# -- tokens ------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Words:
    """Ids of white-space-separated words, little-endian unsigned 32 bit, remembered within bounds.

    The vocabulary drops white space and never joins across it, so the ids of a text are those
    of its words in order.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.before = _tokenizer(path), {}, {}
        self.model = self.tokenizer.model
        self.mark_id, token = max(self.tokenizer.get_added_tokens_decoder().items())
        self.mark = token.content
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode().split() for t in texts]
        if len(self.known) > KNOWN:
            self.known, self.before = {}, self.known
        new = []
        for word in set().union(*split).difference(self.known):
            ids = self.before.get(word)
            if ids is None:
                new.append(word)
            else:
                self.known[word] = ids
        self._learn(new)
        found = [b"".join(map(self.known.__getitem__, own)) for own in split]
        for word in new:
            if len(word) > SHORT:
                del self.known[word]
                self.known.pop(word[:-1], None)
        return found

    def rest(self) -> None:
        """Between tasks only short words stay, mostly the frequent ones, so that an idle worker holds little."""
        if len(self.known) + len(self.before) > RESTING:
            short = ((w, ids) for memory in (self.known, self.before) for w, ids in memory.items() if len(w) <= 8)
            self.known, self.before = dict(islice(short, RESTING)), {}

    def _learn(self, new: list[bytes]) -> None:
        """Encode new words: the model takes plain letters as they are; others many at a time, their ids cut apart.

        Words of letters alone are one token group each, which ends where a token ends a word.  A
        single stop after such a word is a group of its own.  All else is encoded with a special
        token between, and what holds that token's string by itself.
        """
        letters, stopped, rest = {}, [], []
        known, tokens = self.known, self.model.tokenize
        for word in new:
            stop = word[-1:] in (b".", b",") and len(word) > 1
            core = word[:-1] if stop else word
            if core.isalpha():  # of ASCII
                if core not in known:
                    known[core] = self.before.get(core) or array("I", [t.id for t in tokens(core.lower().decode())]).tobytes()
                if stop:
                    stopped.append(word)
                continue
            text = core.decode()
            if not text.isalpha() or (stop and not text.lower().isalpha()):
                rest.append(word)
                continue
            if core not in known:
                letters[core] = text
            if stop:
                stopped.append(word)
        if stopped:
            rest += [s for s in (b".", b",") if s not in self.known]
        words = list(letters)
        for start in range(0, len(words), 4096):
            block = words[start : start + 4096]
            ids = self._encoded(" ".join([letters[w] for w in block]))
            cuts = np.flatnonzero(self.ends[ids]).tolist()
            # A letter may turn into one with a mark when it is lowered: then they do not match.
            if len(cuts) == len(block):
                self._keep(block, ids, [-1, *cuts], [c + 1 for c in cuts])
            else:
                rest += block
        plain = [w for w in rest if self.mark.encode() not in w]
        for start in range(0, len(plain), 4096):
            block = plain[start : start + 4096]
            ids = self._encoded(self.mark.join([w.decode() for w in block]))
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            self._keep(block, ids, [-1, *cuts], [*cuts, len(ids)])
        for word in set(rest).difference(plain):
            self.known[word] = self._encoded(word.decode()).tobytes()
        self.known.update((w, self.known[w[:-1]] + self.known[w[-1:]]) for w in stopped)

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _keep(self, words: list[bytes], ids: np.ndarray, after: list[int], upto: list[int]) -> None:
        data = ids.tobytes()
        self.known.update((w, data[4 * a + 4 : 4 * b]) for w, a, b in zip(words, after, upto))


@lru_cache(maxsize=1)
def known_words(path: str) -> Words:
    """One memory per worker, which goes on from task to task."""
    return Words(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as bytes."""
    path = path or vocabulary_path()
    narrow = docs.select("doc_id", "text")
    fields = [narrow.schema["doc_id"]]
    fields += [T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32")]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = known_words(path), np.array([END], "<u4").tobytes()
        for part in slices(batches):
            rows: list[tuple] = []
            place: list[int] = []
            for row, ids in enumerate(words.ids(part.column("text").to_pylist())):
                ids += end
                for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    rows.append((number, start // 4, len(own) // 4, zlib.crc32(own), own))
                    place.append(row)
            columns = list(zip(*rows))
            arrays = [part.column("doc_id").take(pa.array(place, pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in columns[:4]]
            arrays += [pa.array(columns[4], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])
        words.rest()

    return narrow.mapInArrow(run, T.StructType(fields))


# -- the packing of a histogram ----------------------------------------------------------


class Counts:
    """How many pieces there are of each size, with the sizes in order."""

    def __init__(self, histogram: dict[int, int]):
        self.of = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.of)

    def take(self, size: int, n: int) -> None:
        self.of[size] -= n
        if not self.of[size]:
            del self.of[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def largest(self, limit: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest size up to ``limit`` of which there is one besides ``without``."""
        i = bisect.bisect_right(self.sizes, limit) - 1
        while i >= 0 and self.of[self.sizes[i]] <= without.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest pieces besides one of size ``without``."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.of[size] - (size == without))
            if len(out) == n:
                break
        return out


def dominating(counts: Counts, size: int, capacity: int) -> tuple[int, ...] | None:
    """Companions that dominate every other choice for one piece of ``size``, if that can be shown."""
    rest = capacity - size
    best = counts.largest(rest, (size,))
    if best is None:
        return ()
    if best == rest:
        return (best,)
    least = counts.smallest(3, size)
    if len(least) < 2 or least[0] + least[1] > rest:
        return (best,)
    if len(least) == 3 and sum(least) <= rest:
        return None
    # At most two companions fit.  Of any two, the smaller is at most rest // 2.
    small, second = counts.largest(rest // 2, (size,)), counts.largest(rest - best, (size, best))
    largest_pair = 0
    for other in counts.sizes:
        if other > rest // 2:
            break
        if counts.of[other] > (other == size):
            partner = counts.largest(rest - other, (size, other))
            largest_pair = max(largest_pair, other + partner) if partner else largest_pair
    if largest_pair <= best:
        return (best,)
    if second is not None and small is not None and small <= second:
        return (best, second)
    return None


def reduce(counts: Counts, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets, the largest sizes first, until a whole round finds none."""
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed and counts.sizes:
        changed = False
        size = counts.sizes[-1]
        while size is not None:
            chosen = dominating(counts, size, capacity)
            if chosen is not None:
                content = (size, *chosen)
                # What was shown rests on which sizes there are, up to three pieces of each: it holds
                # for a lone companion while there are any, for two while more than three are left.
                n = min(counts.of[s] // content.count(s) for s in set(content))
                if len(content) == 3:
                    n = max(1, min(counts.of[s] for s in content) // 3 - 3)
                for s in content:
                    counts.take(s, n)
                fixed.append((tuple((s, 1) for s in content), n))
                changed = True
            # the next size to look at: the same while there are more, else the next smaller one
            size = counts.largest(size if chosen is not None else size - 1)
    return fixed


def best_fit(counts: Counts, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing, whole groups of equal sequences at a time."""
    full: list[tuple[Pattern, int]] = []
    open_by_rest: dict[int, list[tuple[Pattern, int]]] = {}
    rests: list[int] = []

    def put(content: Pattern, n: int, rest: int) -> None:
        if not n:
            return
        if not rest:
            full.append((content, n))
            return
        if rest not in open_by_rest:
            open_by_rest[rest] = []
            bisect.insort(rests, rest)
        open_by_rest[rest].append((content, n))

    for size in reversed(counts.sizes):
        left = counts.of[size]
        while left:
            i = bisect.bisect_left(rests, size)
            if i == len(rests):
                content, n, rest = (), left, capacity
            else:
                rest = rests[i]
                content, n = open_by_rest[rest].pop()
                if not open_by_rest[rest]:
                    del open_by_rest[rest]
                    rests.pop(i)
            each = rest // size
            whole = min(n, left // each)
            left -= whole * each
            put((*content, (size, each)), whole, rest - each * size)
            untouched = n - whole
            if left and untouched and left < each:
                put((*content, (size, left)), 1, rest - left * size)
                left, untouched = 0, untouched - 1
            if content:
                put(content, untouched, rest)
    for rest, groups in open_by_rest.items():
        full.extend(groups)
    return full


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(contents, how many sequences) that hold every piece of ``histogram``, none over ``capacity``."""
    counts = Counts(histogram)
    if counts.sizes and counts.sizes[-1] > capacity:
        raise ValueError("a piece is longer than a sequence")
    return [*reduce(counts, capacity), *best_fit(counts, capacity)]


def ranges(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first number, number after the last, first sequence, how many each, offset) in order."""
    given: dict[int, int] = {}
    out, sequence = [], 0
    for content, n in patterns:
        offset = 0
        for size, each in content:
            first = given.get(size, 0)
            given[size] = first + n * each
            out.append((size, first, first + n * each, sequence, each, offset))
            offset += size * each
        sequence += n
    return out


# -- all pieces --------------------------------------------------------------------------


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (a table that can be read again) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    handed_out = ranges(pack_histogram(histogram, capacity))
    blocks = max(1, sum(histogram.values()) // BLOCK_ROWS)
    names = "_size long, _first long, _end long, _sequence long, _each long, _offset long"
    # A few rows for each size up to the capacity, however many pieces there are.
    table = spark.createDataFrame(handed_out, names)

    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    rows = found.withColumn("_block", F.pmod(key, F.lit(blocks)))
    order = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("_own", F.row_number().over(order) - 1)
    sums = running_total(
        found.select("length", F.pmod(key, F.lit(blocks)).alias("_block")).groupBy("length", "_block").agg(F.count("*").alias("_n")),
        "_block",
        "_before",
        F.col("_n"),
        ["length"],
    ).select(F.col("length").alias("_length"), F.col("_block").alias("_of"), "_before")
    rows = rows.join(sums, (F.col("length") == F.col("_length")) & (F.col("_block") == F.col("_of")))
    number = F.col("_before") + F.col("_own")
    rows = rows.withColumn("_number", number)
    fits = (F.col("length") == F.col("_size")) & (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_end"))
    rows = rows.join(F.broadcast(table), fits)
    at = F.col("_number") - F.col("_first")
    return rows.select(
        *found.columns,
        (F.col("_sequence") + F.expr("(_number - _first) div _each")).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its place there; sequences have no gaps."""
    return place(stage(pieces(docs, path, capacity, with_ids), "pieces"), capacity)
