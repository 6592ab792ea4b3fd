"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding by vocabulary strings.

A pre-token is a doubly linked list of symbols.  All adjacent pairs that can merge wait in a
queue by (rank, place); a pair whose symbols have changed since it was queued is stale and is
skipped.  Equal ranks merge from the left.  Decoding concatenates the vocabulary strings of the
ids and turns their letters back into bytes.

Defined cases: a null text is empty and has no ids; a text that holds a special token's string
gets its id there, as the public library does; texts of any length are encoded whole, in
n log n steps for the longest pre-token.  Repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from invigil.llm.common import Memo, back, beside, fresh, over_slices, slices, tokenizer_path

# Fixed value: how the vocabulary's makers split a text before any merge.  White space is what
# Unicode calls so.
_SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def vocabulary_path() -> str:
    return tokenizer_path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Apply merges in order of rank until none is left.

    The queue holds ``rank * size + place``; ``waiting`` has the rank of the pair that starts at
    each place now, so an entry of another rank is stale.
    """
    size = len(symbols)
    if size == 1:
        return symbols
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    waiting = [get(pair, -1) for pair in zip(symbols, symbols[1:])]
    waiting.append(-1)
    queue = [rank * size + i for i, rank in enumerate(waiting) if rank >= 0]
    heapq.heapify(queue)
    while queue:
        rank, i = divmod(pop(queue), size)
        if waiting[i] != rank:
            continue
        new = symbols[i] = merged[rank]
        j = after[i]
        waiting[j] = -1
        k = after[i] = after[j]
        if k < size:
            before[k] = i
            rank = waiting[i] = get((new, symbols[k]), -1)
            if rank >= 0:
                push(queue, rank * size + i)
        else:
            waiting[i] = -1
        h = before[i]
        if h >= 0:
            rank = waiting[h] = get((symbols[h], new), -1)
            if rank >= 0:
                push(queue, rank * size + h)
    out, i = [], 0
    while i < size:
        out.append(symbols[i])
        i = after[i]
    return out


class ByteBPE:
    """A vocabulary file, its merges, and a bounded memory of encoded pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, model = spec["model"]["vocab"], spec["model"]
        letters = byte_letters()
        self.of_byte = [vocabulary[c] for c in letters]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left], vocabulary[right]] = rank
            self.merged.append(vocabulary[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        byte_of = {c: b for b, c in enumerate(letters)}
        self.strings = [b""] * size
        for text, number in vocabulary.items():
            self.strings[number] = bytes(byte_of[c] for c in text)
        for text, number in self.special.items():
            self.strings[number] = text.encode()
        self.decimals = [str(i) for i in range(size)]
        self.known = Memo(lambda word: merge([self.of_byte[b] for b in word.encode()], self.ranks, self.merged), 500_000)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, PRE_TOKEN.findall(text))))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the tokens of ``text``; replaces a column of that name."""
    path, docs = path or vocabulary_path(), fresh(docs, "ids")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = [load(path).encode(t) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("row"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "tokens"])

    inner = beside(docs, "text")
    schema = T.StructType([inner.schema["row"], T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    return back(inner.mapInArrow(over_slices(run), schema), docs.columns, ids="tokens")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded``, the text of ``ids`` (null: empty); replaces a column of that name."""
    path, tokens = path or vocabulary_path(), fresh(tokens, "decoded")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [load(path).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    inner = beside(tokens, "ids")
    schema = T.StructType([inner.schema["row"], T.StructField("text", T.StringType())])
    return back(inner.mapInArrow(run, schema), tokens.columns, decoded="text")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what ``encode`` and ``decode`` give,
    taken where the ids are made, so that no ids travel."""
    path = path or vocabulary_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in slices(batches):
            counts, ids_digests, text_digests = [], [], []
            for text in part.column("text").to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(text_digests)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            narrow.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return narrow.mapInArrow(run, schema)
