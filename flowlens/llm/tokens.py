"""Exact token ids of many texts with one of the public tokenizer files.

Encoding a word costs far more than looking it up, and a space always starts a
new pre-token in both kinds of vocabulary, so texts are cut at spaces and each
distinct piece is encoded once per worker. The few texts where a space stands
inside a run of white space that the vocabulary may treat as one token, or that
hold the string of a special token, are encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

END_ID = 2
# What a worker remembers before it starts anew, and between tasks; no effect on results.
MAX_PIECES = 1_300_000
MAX_IDS = 8_000_000
RESTING_PIECES = 1_300_000
MAX_PIECE_LENGTH = 64
BLOCK_CHARS = 1 << 16
PENDING_CHARS = 1 << 20
CHUNK_CHARS = 2_000_000
_CUT = re.compile(r"(?<=\w) (?=\w)")
_INNER_SPACE = re.compile(r"\s (?=\s|\Z)")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies show each byte as.

    Visible Latin-1 characters stand for themselves; the other bytes take the
    letters from U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()


class _Pieces(dict):
    """Piece -> number in the encoder's table, filled on first sight."""

    def __init__(self, encoder: PieceEncoder, prefix: str):
        super().__init__()
        self.encoder, self.prefix = encoder, prefix
        self.shown_prefix = prefix.translate(_LETTERS)

    def __missing__(self, piece: str) -> int:
        encoder = self.encoder
        if len(piece) <= MAX_PIECE_LENGTH:
            if (not encoder.keeps_space and piece.isascii() and piece != (low := piece.lower())
                    and not encoder.holds_special(low)):
                number = self[piece] = self[low]  # such vocabularies know lower case only
                return number
            number = self[piece] = encoder.reserve()
        else:
            number = encoder.reserve()
        # A full stop or comma after a letter or digit is a pre-token of its own.
        if len(piece) > 1 and piece[-1] in ".," and piece[-2].isascii() and piece[-2].isalnum():
            encoder.joined.append((number, self[piece[:-1]], encoder.bare[piece[-1]]))
        elif piece.isascii() and piece.isalpha():
            encoder.plain.append((number, self.shown_prefix + piece if encoder.keeps_space else piece.lower()))
        # So is a word of Latin-1 letters, which needs no normalising but lower case.
        elif piece.isalpha() and max(piece) < "\u0100":
            text = self.prefix + (piece if encoder.keeps_space else piece.lower())
            encoder.plain.append((number, text.encode().decode("latin-1").translate(_LETTERS)))
        else:
            encoder.waiting.append((number, self.prefix + piece))
        return number


class PieceEncoder:
    """Token ids of texts, equal to encoding each text as a whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Their strings in a text give their ids, as by the library's default.
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.spaced_special = any(re.search(r"\s", t) for t in self.special)
        self.model = self.tokenizer.model
        # Vocabularies that drop white space encode a piece alike wherever it stands.
        self.keeps_space = bool(self.tokenizer.encode(" a b", add_special_tokens=False).ids
                                != self.tokenizer.encode("a b", add_special_tokens=False).ids)
        self.forget()

    def holds_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def forget(self) -> None:
        self.waiting: list[tuple[int, str]] = []
        self.plain: list[tuple[int, str]] = []
        self.joined: list[tuple[int, int, int]] = []
        self.count = 0
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0
        self.bare = _Pieces(self, "")
        self.spaced = _Pieces(self, " ") if self.keeps_space else self.bare
        self.end = self.reserve()
        self._store([self.end], [[END_ID]])

    def reserve(self) -> int:
        self.count += 1
        return self.count - 1

    def _room(self, total: int) -> None:
        if self.count > len(self.starts):
            more = max(self.count, 2 * len(self.starts))
            self.starts, self.sizes = np.resize(self.starts, more), np.resize(self.sizes, more)
        if self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, max(self.used + total, 2 * len(self.ids)))

    def _store(self, numbers: list[int], found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        self._room(total)
        self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.sizes[numbers] = sizes
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def _encode_waiting(self) -> None:
        if self.plain:
            tokenize = self.model.tokenize
            self._store([n for n, _ in self.plain], [[t.id for t in tokenize(text)] for _, text in self.plain])
        low, held = 0, 0
        for high, (_, text) in enumerate(self.waiting, 1):
            held += len(text)
            if held >= 4 * BLOCK_CHARS or high == len(self.waiting):
                part = self.waiting[low:high]
                found = self.tokenizer.encode_batch_fast([text for _, text in part], add_special_tokens=False)
                self._store([n for n, _ in part], [e.ids for e in found])
                low, held = high, 0
        if self.joined:
            number, head, tail = np.array(self.joined, np.int64).T
            parts = np.stack([head, tail], axis=1).ravel()
            sizes = self.sizes[head] + self.sizes[tail]
            total = int(sizes.sum())
            self._room(total)
            self.ids[self.used:self.used + total] = self._spread(parts)
            self.sizes[number], self.starts[number] = sizes, self.used + np.cumsum(sizes) - sizes
            self.used += total
        self.waiting, self.plain, self.joined = [], [], []

    def _spread(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of numbered pieces in a row."""
        sizes = self.sizes[numbers]
        shift = np.repeat(self.starts[numbers] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[shift + np.arange(len(shift))]

    def _blocks(self, text: str) -> Iterator[str]:
        """Cuts of a long text at spaces between two letters or digits, where a pre-token always ends.

        Blocks but the first begin with their space. Vocabularies whose special
        tokens hold white space get the whole text.
        """
        low = 0
        while len(text) - low > 2 * BLOCK_CHARS and not self.spaced_special:
            found = _CUT.search(text, low + BLOCK_CHARS)
            if found is None:
                break
            yield text[low:found.start()]
            low = found.start()
        yield text[low:] if low else text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``END_ID``; sizes per text."""
        found: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        numbers, rows, counts, pending = array("i"), [], [], 0

        def flush() -> None:
            self._encode_waiting()
            of = np.frombuffer(numbers, np.int32) if len(numbers) else np.zeros(0, np.int32)
            found.append(self._spread(of))
            ends = np.concatenate([[0], np.cumsum(self.sizes[of])])
            edges = np.cumsum([0, *counts])
            np.add.at(sizes, rows, ends[edges[1:]] - ends[edges[:-1]])
            if self.count > MAX_PIECES or self.used > MAX_IDS:
                self.forget()

        for k, text in enumerate(texts):
            for i, block in enumerate(self._blocks(text) if text else ()):
                before = len(numbers)
                if (self.keeps_space and _INNER_SPACE.search(block)) or self.holds_special(block):
                    number = self.reserve()
                    self.waiting.append((number, block))
                    numbers.append(number)
                else:
                    head, *rest = block.split(" ")
                    if not i:
                        numbers.append(self.bare[head])
                    numbers.extend(map(self.spaced.__getitem__, rest))
                rows.append(k)
                counts.append(len(numbers) - before)
                pending += len(block)
                if pending >= PENDING_CHARS:
                    flush()
                    numbers, rows, counts, pending = array("i"), [], [], 0
            numbers.append(self.end)
            rows.append(k)
            counts.append(1)
        flush()
        return np.concatenate(found), sizes

    def rest(self) -> None:
        """Let go of most of what was remembered, at the end of a task."""
        if self.count > RESTING_PIECES:
            self.forget()


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch that hold about ``CHUNK_CHARS`` characters of text."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths) // CHUNK_CHARS).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:]):
        if high > low:
            part = batch.slice(low, high - low)
            yield part, part.column(part.schema.get_field_index(text)).to_pylist()


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def token_pieces(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): texts as token pieces of at most ``limit``.

    Only longer documents are cut; the first piece takes what does not fill one.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, sizes = worker.encode(texts)
                whole = sizes // limit
                counts = whole + (sizes % limit > 0)
                row = np.repeat(np.arange(len(texts)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = np.where(sizes % limit > 0, sizes % limit, limit)[row]
                start = np.where(piece == 0, 0, first + (piece - 1) * limit)
                length = np.where(piece == 0, first, limit)
                base = (np.cumsum(sizes) - sizes)[row] + start
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * b:4 * (b + n)]) for b, n in zip(base.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                    names=schema.fieldNames(),
                )
        worker.rest()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)
