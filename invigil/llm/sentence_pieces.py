"""SentencePiece BPE: exact encoding by backtracking over longest matches, and decoding.

A merge-type model has one encoding per text, and it is the only sequence of pieces in which every
piece and every two adjacent pieces, merged again from their characters, come out as themselves: the
first merge across a border would be made in the pair alone as well.  So no text has to be merged.
An Aho-Corasick automaton of the reversed pieces, run over the reversed text, finds the longest piece
that starts at each place.  The encoder takes it, or the next shorter one that it starts with, if it is
compatible with the piece before, found by merging the two again (remembered within bounds), and goes on behind it;
where none fits it marks the place in a bitfield of failed places, goes back one piece and tries the
next shorter one.  A place fails once at most, so the work is linear in the text.

Where no piece of the model has a space behind anything else, or letters beside what is neither letter
nor space, no merge crosses there: such parts are encoded apart, and those of up to ``SHORT``
characters remembered.  Longer ones, of any length, are walked with the matches of a few blocks in
memory at a time.

Defined cases: a null text is empty and has the end id alone; characters without a piece become the
pieces of their UTF-8 bytes; strings of control pieces in a text are ordinary text; repeated rows
are encoded alike.  Models that change characters before they encode, that have pieces of their users or
none for bytes, or whose longer pieces have characters that are none themselves, are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from invigil.llm.common import Memo, back, beside, fresh, over_slices, slices, tokenizer_path

#: Fixed value: the character that stands for a space.
SPACE = "▁"
#: Parts of a text that no merge joins, if no piece holds what the second pattern of each pair finds.
SEAMS = [
    (rf"{SPACE}*[\p{{L}}\p{{M}}]+|{SPACE}*[^\p{{L}}\p{{M}}{SPACE}]+|{SPACE}+", rf"[\p{{L}}\p{{M}}][^\p{{L}}\p{{M}}]|[^\p{{L}}\p{{M}}{SPACE}][\p{{L}}\p{{M}}{SPACE}]"),
    (rf"{SPACE}*[^{SPACE}]+|{SPACE}+", rf"[^{SPACE}]{SPACE}"),
]
#: Longer words are not remembered.
SHORT = 64
BLOCK = 4096
NONE = -1
BLOCKS = 16


def model_path() -> str:
    return tokenizer_path("piece_bpe_32k.model")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol buffer message; fixed-width values as bytes."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, message[at : at + size]
        at += size


class Longest:
    """The longest piece that starts at each place of a text; a few blocks are held."""

    def __init__(self, automaton: ahocorasick.Automaton, longest: int, text: str):
        self.automaton, self.longest, self.text, self.blocks = automaton, longest, text, {}

    def get(self, at: int, none: int) -> int:
        number, place = divmod(at, BLOCK)
        block = self.blocks.get(number)
        if block is None:
            if len(self.blocks) >= BLOCKS:
                self.blocks.clear()
            start = number * BLOCK
            block = self.blocks[number] = starts(self.automaton, self.text[start : start + BLOCK + self.longest])
        return block.get(place, none)

    def __contains__(self, at: int) -> bool:
        return self.get(at, NONE) != NONE


def starts(automaton: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """The longest piece by the place where it starts.  The automaton reads from the end and gives, at each place, the
    longest first: it is the one that stays when the list is read backwards."""
    last = len(text) - 1
    return {last - at: piece for at, piece in reversed(list(automaton.iter(text[::-1])))}


class Model:
    """A model file, its automaton, and bounded memories of words and of adjacent pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        settings = dict(fields(dict(fields(model.serialized_model_proto())).get(3, b"")))
        numbers = range(model.get_piece_size())
        named = [model.id_to_piece(i) for i in numbers]
        plain = [i for i in numbers if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.of_byte = {bytes([int(named[i][3:5], 16)]): i for i in numbers if model.is_byte(i)}
        changes = settings.get(2) or settings.get(4, 1) or not settings.get(3, 1) or not settings.get(5, 1)
        if changes or len(self.of_byte) < 256 or any(model.is_unused(i) for i in plain):
            raise ValueError("a model of another kind")
        self.ids = {named[i]: i for i in plain}
        self.scores = {named[i]: model.get_score(i) for i in plain}
        if any(c not in self.ids for piece in self.ids for c in piece):
            raise ValueError("a piece has characters that are none")
        self.pieces = {i: named[i] for i in plain}
        self.end = model.eos_id()
        seams = (part for part, inside in SEAMS if not any(regex.search(inside, p) for p in self.ids))
        self.parts = regex.compile(next(seams, r"(?s).+"))

        self.longest = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            # What its own characters do not merge to is in no encoding.
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece[::-1], i)
        self.automaton.make_automaton()
        # The next shorter piece that a piece starts with.
        self.length, self.shorter = [1] * len(named), [-1] * len(named)
        for piece, i in self.ids.items():
            self.length[i] = len(piece)
            heads = (piece[:n] for n in range(len(piece) - 1, 0, -1))
            self.shorter[i] = next((self.ids[h] for h in heads if h[::-1] in self.automaton), -1)

        self.compatible = Memo(self._compatible, 500_000)
        self.known = Memo(self.walk, 300_000, SHORT)
        self.decimals = [str(i) for i in numbers]
        self.strings = [b"" if model.is_control(i) else named[i].replace(SPACE, " ").encode() for i in numbers]
        self.strings[model.unk_id()] = model.decode([model.unk_id()]).encode()
        self.bytes_of = {i: b for b, i in self.of_byte.items()}
        for i, byte in self.bytes_of.items():
            self.strings[i] = byte
        self.control = {i for i in numbers if model.is_control(i)}

    def merged(self, text: str) -> list[str]:
        """A short text by its definition: merge the pair of the best piece, the leftmost first."""
        symbols = list(text)
        while True:
            best, at = None, 0
            for i, pair in enumerate(zip(symbols, symbols[1:])):
                score = self.scores.get(pair[0] + pair[1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        left, right = self.pieces[pair[0]], self.pieces[pair[1]]
        return self.merged(left + right) == [left, right]

    def walk(self, text: str) -> tuple[int, ...]:
        """The ids of ``text``, spaces replaced."""
        size, length, shorter, compatible = len(text), self.length, self.shorter, self.compatible
        longest = starts(self.automaton, text) if size <= BLOCK else Longest(self.automaton, self.longest, text)
        failed = bytearray(size // 8 + 1)
        taken: list[int] = []  # pieces; NONE for a character without one, which no merge reaches over
        at, piece, before = 0, longest.get(0, NONE), NONE
        while at < size:
            end = at + length[piece]
            while piece >= 0 and (failed[end >> 3] >> (end & 7) & 1 or (before >= 0 and not compatible[before, piece])):
                piece = shorter[piece]
                end = at + length[piece]
            if piece >= 0 or at not in longest:
                taken.append(piece)
                at, before = end, piece
                piece = longest.get(at, NONE)
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= length[piece]
                before = taken[-1] if taken else NONE
                piece = shorter[piece]
        out: list[int] = []
        at = 0
        for piece in taken:
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.of_byte[bytes([b])] for b in text[at].encode()]
            at += length[piece]
        return tuple(out)

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        last = [self.end] if end else []
        if not text:
            return last
        parts = self.parts.findall(SPACE + text.replace(" ", SPACE))
        return [*chain.from_iterable(map(self.known.__getitem__, parts)), *last]

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        try:
            if not self.control.isdisjoint(ids[:-1]):
                text = self._repaired(ids)
            else:
                text = b"".join(map(self.strings.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = self._repaired(ids)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if self.pieces.get(first, "").startswith(SPACE) else text

    def _repaired(self, ids: list[int]) -> str:
        """The strings of ``ids``; in each run of byte pieces, bytes that are no character are replaced one by one."""
        out, run = [], b""
        for i in [*ids, None]:
            if i in self.bytes_of:
                run += self.bytes_of[i]
                continue
            while run:
                for size in range(1, 5):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                run = run[size:]
            if i is not None:
                out.append(self.strings[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the pieces of ``text`` and the end id; replaces a column of that name."""
    path, docs = path or model_path(), fresh(docs, "ids")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = [load(path).encode(t) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("row"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "tokens"])

    inner = beside(docs, "text")
    schema = T.StructType([inner.schema["row"], T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    return back(inner.mapInArrow(over_slices(run), schema), docs.columns, ids="tokens")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded``, the text of ``ids`` (null: empty); replaces a column of that name."""
    path, tokens = path or model_path(), fresh(tokens, "decoded")

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
    path = path or model_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for part in slices(batches):
            counts, ids_digests, text_digests = [], [], []
            for text in part.column("text").to_pylist():
                ids = model.encode(text)
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(" ".join(map(model.decimals.__getitem__, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
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
