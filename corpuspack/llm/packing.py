"""Sum-of-squares online packing of tokenized documents into windows of fixed length."""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuspack.llm.common import release_memory

WINDOW = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
# A task forgets the words it has encoded when it has so many.
CACHE_WORDS = 400_000

# A run of these is one pre-token, whatever letters stand before it.
_PUNCTUATION = b'.,!?;:"()[]{}<>#*$%&|/@+=~^_-'

_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_length bigint"
)


class WordIds(dict):
    """From a word (bytes without white space, A-Z lowered) to its ids as unsigned ints.

    White space ends every pre-token, so the ids of a text are those of its words. A
    word of plain letters, with or without punctuation behind it, goes straight to the
    tokenizer's model; others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenize = self._tokenizer.model.tokenize
        self._letters = "".join(_byte_letters())
        self._plain = re.compile("[a-zÀ-ÖØ-öø-ÿ]+").fullmatch

    def _piece(self, letters: str) -> bytes:
        if not letters.isascii():
            letters = codecs.charmap_decode(letters.encode(), "strict", self._letters)[0]
        return array("I", [t.id for t in self._tokenize(letters)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        base = word.rstrip(_PUNCTUATION)
        text = base.decode("utf-8", "replace")
        if self._plain(text):
            if len(base) < len(word):
                ids = self[base] + self[word[len(base) :]]
            else:
                ids = self._piece(text.lower())
        else:
            text = word.decode("utf-8", "replace")
            ids = array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def text_ids(self, text: bytes | None) -> bytes:
        """The ids of a text and the end id, four bytes each."""
        words = (text or b"").lower().split()
        return b"".join(map(self.__getitem__, words)) + END_ID.to_bytes(4, "little")


def _byte_letters() -> list[str]:
    """The letter that a byte-level model uses for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    others = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


@dataclass
class Piece:
    """Some ids of a document, four bytes each."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        head, tail = self.ids[: 4 * length], self.ids[4 * length :]
        return (
            Piece(self.doc_id, self.start, head, self.doc_tokens),
            Piece(self.doc_id, self.start + length, tail, self.doc_tokens),
        )


class SumOfSquares:
    """Open windows by fill level; an item goes where the squares of their counts sum least."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece of less than a window into one; a window that this fills, or None.

        Moving a window from level h to h + s changes the sum by
        2 (count[h + s] - count[h]) + 2; level 0 and the full one are not counted. Of
        equally good levels, the fullest is taken.
        """
        size = len(piece)
        levels = np.flatnonzero(self.count[1 : self.window - size + 1]) + 1
        best, change = 0, 2 * int(self.count[size]) + 1
        if len(levels):
            after = levels + size
            # to fill a window saves the second term
            changes = np.where(after == self.window, 0, 2 * self.count[after] + 1)
            changes += 1 - 2 * self.count[levels]
            k = len(levels) - 1 - int(np.argmin(changes[::-1]))
            if changes[k] <= change:
                best = int(levels[k])
        held = self.open[best].pop() if best else []
        held.append(piece)
        if best:
            self.count[best] -= 1
        if best + size == self.window:
            return held
        self.count[best + size] += 1
        self.open[best + size].append(held)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """The windows still open, without padding.

        The emptiest are taken apart to fill the fullest, cutting where one is full;
        what is left at last goes to windows of a power of two.
        """
        held = [w for level in range(self.window - 1, 0, -1) for w in self.open[level]]
        spare: list[Piece] = []
        first, last = 0, len(held) - 1
        while first <= last:
            window = held[first]
            room = self.window - sum(map(len, window))
            while room and (spare or first < last):
                if not spare:
                    spare = held[last][::-1]
                    last -= 1
                piece = spare.pop()
                if len(piece) > room:
                    piece, rest = piece.cut(room)
                    spare.append(rest)
                window.append(piece)
                room -= len(piece)
            first += 1
            if room:
                spare = window[::-1]
            else:
                yield window
        left = sum(map(len, spare))
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                piece = spare.pop()
                if len(piece) > room:
                    piece, rest = piece.cut(room)
                    spare.append(rest)
                window.append(piece)
                room -= len(piece)
            yield window


def _packing(path: str, window: int, with_ids: bool):
    # batches of rows go out as soon as there are so many
    flush = 20_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, levels = WordIds(path), SumOfSquares(window)
        base = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        sequence = 0

        def put(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset, total = 0, sum(map(len, pieces))
            for p in pieces:
                row = (
                    p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens,
                    base + sequence, offset, total,
                )
                rows.append((*row, p.ids) if with_ids else row)
                offset += len(p)
            sequence += 1

        def taken() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:8]]
            names = [f.split(" ")[0] for f in _SCHEMA.split(", ")]
            if with_ids:
                columns.append(pa.array([r[8] for r in rows], pa.binary()))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.text_ids(text.as_py())
                piece = Piece(doc_id, 0, ids, len(ids) // 4)
                while len(piece) >= window:
                    full, piece = piece.cut(window)
                    put([full])
                if len(piece) and (done := levels.place(piece)):
                    put(done)
                if len(rows) >= flush:
                    yield taken()
        for done in levels.close():
            put(done)
            if len(rows) >= flush:
                yield taken()
        if rows:
            yield taken()
        del words, levels
        release_memory()

    return run


def pack(
    documents: DataFrame,
    tokenizer_path: str | None = None,
    window: int = WINDOW,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence.

    Every task packs the documents it reads, so nothing is shuffled; its windows are
    numbered after its own number. A piece of less than a window goes to the fill level
    that the sum of squares prefers. At the end a task empties its open windows into
    each other, so all sequences are of full length but a few of a power of two. Null
    and empty texts are the end id alone; longer texts than a window fill whole ones
    first. Repeated rows are packed as often as they occur. ``with_ids`` adds the ids,
    four little-endian bytes each.
    """
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    return documents.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")
    ).mapInArrow(_packing(path, window, with_ids), _SCHEMA + ", ids binary" * with_ids)
