"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability
of a word is the sum, over all ways to cut it into pieces, of the product of their
probabilities; the forward algorithm takes that sum without listing the ways.  A text's is the
product over its words, and the score is the posterior of the best language under equal priors.

Training is expectation maximisation over word types: the forward and backward sums give the
expected number of times each piece is used.  It reads at most ``sample`` labelled documents of
each language (the smallest seeded hashes); scoring reads every text whole.

Defined cases: a null text, one without letters, or a model without languages gives ``und`` and
score 0.  Rows without a language are not learned from.  Equal rows give equal predictions; of
equally likely languages the first in alphabetical order is taken.  A character outside the
vocabulary has one small probability in every language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invigil.llm.common import back, beside, field, fresh, slices, tokenizer_path, unused
from invigil.session import stage

UNDECIDED = "und"
SAMPLE = 2000
ROUNDS = 2
SMOOTHING = 0.05
UNKNOWN = 1e-7
LONGEST = 16
TYPES = 50_000
#: Bytes of text whose words are held at once: as lists of words they take some ten times that.
SLICE = 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def vocabulary_path() -> str:
    return tokenizer_path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Piece to number, without control and byte pieces; ``▁`` marks the start of a word."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    texts = (
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    )
    return {p: n for n, p in enumerate(dict.fromkeys(p for p in texts if len(p) <= LONGEST))}


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


# -- sums over all segmentations ---------------------------------------------------------


def _lattice(same_length: list[str], vocabulary: dict[str, int]) -> dict[tuple[int, int], np.ndarray]:
    """For each span the piece number in every word; the vocabulary's size where there is none,
    one more for a character of its own that is no piece."""
    none, size = len(vocabulary), len(same_length[0])
    get, spans = vocabulary.get, {}
    for start in range(size):
        for end in range(start + 1, min(size, start + LONGEST) + 1):
            other = none + 1 if end == start + 1 else none
            found = np.fromiter((get(w[start:end], other) for w in same_length), np.int32, len(same_length))
            if end == start + 1 or (found != none).any():
                spans[start, end] = found
    return spans


def forward(same_length: list[str], vocabulary: dict[str, int], table: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability under each column of ``table``.

    Long words are taken in blocks of positions, scaled on the way, so nothing underflows.
    """
    size, n = len(same_length[0]), len(same_length)
    get, none = vocabulary.get, len(vocabulary)
    recent = {0: np.ones((n, table.shape[1]))}
    scale = np.zeros((n, table.shape[1]))
    for end in range(1, size + 1):
        total = np.zeros((n, table.shape[1]))
        for start in range(max(0, end - LONGEST), end):
            other = none + 1 if end == start + 1 else none
            found = np.fromiter((get(w[start:end], other) for w in same_length), np.int32, n)
            if end == start + 1 or (found != none).any():
                total += recent[start] * table[found]
        recent[end] = total
        recent.pop(end - LONGEST, None)
        if end % 8 == 0:
            factor = np.where(total < 1e-120, 1e120, 1.0)
            scale -= np.log(factor)
            for kept in recent.values():
                kept *= factor
    return np.log(np.maximum(recent[size], 1e-300)) + scale


def expected(same_length: list[str], weights: np.ndarray, vocabulary: dict[str, int], table: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, weighted; ``table`` has one probability per piece."""
    size, n = len(same_length[0]), len(same_length)
    spans = _lattice(same_length, vocabulary)
    ahead = np.zeros((size + 1, n))
    behind = np.zeros((size + 1, n))
    ahead[0] = behind[size] = 1.0
    for end in range(1, size + 1):
        for start in range(max(0, end - LONGEST), end):
            if (start, end) in spans:
                ahead[end] += ahead[start] * table[spans[start, end]]
    for start in range(size - 1, -1, -1):
        for end in range(start + 1, min(size, start + LONGEST) + 1):
            if (start, end) in spans:
                behind[start] += behind[end] * table[spans[start, end]]
    uses = np.zeros(len(vocabulary) + 2)
    share = weights / np.maximum(ahead[size], 1e-300)
    for (start, end), found in spans.items():
        np.add.at(uses, found, ahead[start] * table[found] * behind[end] * share)
    return uses[: len(vocabulary)]


def _by_length(types: Iterable[str]) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for word in types:
        groups.setdefault(len(word), []).append(word)
    for group in groups.values():
        for start in range(0, len(group), 4096):
            yield group[start : start + 4096]


# -- training ----------------------------------------------------------------------------


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (language, word); a task holds at most ``TYPES`` and one slice's."""
    counts: Counter = Counter()

    def flush():
        rows = list(counts.items())
        counts.clear()
        return pa.record_batch(
            [[k[0] for k, _ in rows], [k[1] for k, _ in rows], [n for _, n in rows]], schema=_COUNTS
        )

    for part in slices(batches, limit=SLICE):
        for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
            counts.update((lang, "▁" + w) for w in words(text) if len(w) <= 64)
        if len(counts) >= TYPES:
            yield flush()
    yield flush()


_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


#: Parts that the first round of choosing a sample splits every language into.
PARTS = 256


def _among_first(ordered: DataFrame, sample: int, lang: Column, order: Column) -> Column:
    """Whether a document is among the first ``sample`` of its language by ``_order``, ties included.

    ``ordered`` has lang and _order alone.  First per part of a language, so that none is one task however many
    documents it has, then among at most ``PARTS * sample`` per language.  What comes back is one number per language, so
    the texts are chosen where they are scanned.
    """
    part = F.pmod("_order", F.lit(PARTS))
    for by in (["lang", part], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_order"))
        ordered = ordered.withColumn("_place", place).where(F.col("_place") <= sample).drop("_place")
    last = ordered.groupBy("lang").agg(F.max("_order").alias("last")).orderBy("lang").collect()
    chosen = F.lit(False)
    for r in last:
        chosen = chosen | ((lang == r.lang) & (order <= r.last))
    return chosen


def train(
    docs: DataFrame,
    allowed: Column,
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
    path: str | None = None,
) -> dict[str, np.ndarray]:
    """Language to probabilities of the pieces (then 0, then that of an unknown character).

    ``docs`` has doc_id, text and lang.  What reaches the driver is bounded by the vocabulary
    times the number of languages.  Words of over 64 letters are scored but not learned from.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(7), "doc_id")
    labelled = docs.select("doc_id", "text", "lang").where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts = labelled.where(_among_first(labelled.select("lang", order.alias("_order")), sample, F.col("lang"), order)).select("text", "lang")
    counts = texts.mapInArrow(_count_words, "lang string, word string, n long")
    types = stage(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    size = len(pieces(path))
    model: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary = pieces(path)
            start = np.full(size + 2, 1.0 / size)
            start[size:] = 0, UNKNOWN
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                found: dict[str, dict[str, int]] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    found.setdefault(lang, {})[word] = n
                for lang, of in found.items():
                    table = shared.value.get(lang, start)
                    total = sums.setdefault(lang, np.zeros(size))
                    for group in _by_length(of):
                        total += expected(group, np.array([of[w] for w in group], float), vocabulary, table)
            for lang, total in sums.items():
                used = np.flatnonzero(total)
                yield pa.record_batch(
                    [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used])],
                    names=["lang", "piece", "uses"],
                )

        uses = types.mapInArrow(expect, "lang string, piece int, uses double")
        # A fixed scale makes the sum the same in whatever order the partial ones arrive.
        grains = F.sum(F.round(F.col("uses") * 1e6).cast("long")).alias("grains")
        rows = uses.groupBy("lang", "piece").agg(grains).collect()
        fresh_model = {}
        for lang in sorted({r.lang for r in rows}):
            table = np.full(size + 2, SMOOTHING)
            for r in rows:
                if r.lang == lang:
                    table[r.piece] += r.grains / 1e6
            table[size:] = 0
            table /= table.sum()
            table[size + 1] = UNKNOWN
            fresh_model[lang] = table
        model = fresh_model
    return model


# -- scoring -----------------------------------------------------------------------------


class Scorer:
    """Adds up word scores; remembers at most ``limit`` words and those of one slice."""

    def __init__(self, model: dict[str, np.ndarray], path: str, limit: int = 400_000):
        self.langs = sorted(model)
        self.table = np.stack([model[k] for k in self.langs], axis=1) if model else np.zeros((0, 0))
        self.vocabulary = pieces(path)
        self.limit = limit
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)))

    def learn(self, types: set[str]):
        if len(self.place) > self.limit:
            self._forget()
        new = [w for w in types if w not in self.place]
        blocks = [self.rows]
        for group in _by_length(new):
            blocks.append(forward(["▁" + w for w in group], self.vocabulary, self.table))
            base = len(self.place)
            self.place.update((w, base + k) for k, w in enumerate(group))
        self.rows = np.concatenate(blocks)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words(t) for t in texts]
        if not self.langs:
            return [UNDECIDED] * len(texts), [0.0] * len(texts)
        self.learn(set().union(*split))
        found, scores = [], []
        for own in split:
            if not any(any(map(str.isalpha, w)) for w in own):
                found.append(UNDECIDED)
                scores.append(0.0)
                continue
            total = self.rows[np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))].sum(axis=0)
            best = int(total.argmax())
            found.append(self.langs[best])
            scores.append(1.0 / sum(math.exp(max(x - total[best], -700.0)) for x in total))
        return found, scores


def identify(
    docs: DataFrame,
    model: dict[str, np.ndarray],
    path: str | None = None,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``docs`` with the language and its score under ``names``, which replace columns of that name.

    Reads only ``text`` to predict.  The model is broadcast: vocabulary times languages.
    """
    path = path or vocabulary_path()
    docs = fresh(docs, *names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # The text is in the row already; a column of its own would be a second copy in the JVM's batch and in the worker's.
    inner = beside(docs)
    place = [c.lower() for c in docs.columns].index("text")

    def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column(0)
        return pa.RecordBatch.from_arrays([row, row.field(place)], names=["row", "text"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, path)
        for part in slices(map(with_text, batches), limit=SLICE):
            found, scores = scorer.score(part.column("text").to_pylist())
            columns = [part.column("row"), pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "found", "likely"])

    schema = T.StructType([inner.schema["row"], T.StructField("found", T.StringType()), T.StructField("likely", T.DoubleType())])
    return back(inner.mapInArrow(run, schema), docs.columns, **{names[0]: "found", names[1]: "likely"})


def fold(doc_id: str = "doc_id") -> Column:
    """0 to 3, from the decimal id."""
    return F.crc32(F.col(field(doc_id)).cast("string").cast("binary")) % 4


def predictions(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.  Learns from folds other than 2."""
    held_out = F.coalesce(fold() == 2, F.lit(False))
    model = train(docs, ~held_out, **options)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def accepted(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` in a language: not ``und``, and the best one more likely than all others together."""
    model = train(docs, F.coalesce(fold() != 2, F.lit(True)), **options)
    names = unused(docs, "_language"), unused(docs, "_posterior")
    found = identify(docs, model, names=names)
    good = (F.col(names[0]) != UNDECIDED) & (F.col(names[1]) >= least)
    return found.where(good).select(*[field(c) for c in docs.columns])
