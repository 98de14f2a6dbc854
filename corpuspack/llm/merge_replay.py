"""Byte-pair encoding and decoding by replaying merges over a whole block of documents.

Every task gathers the distinct pre-tokens of its documents, block by block, and lays
their bytes out as one row of symbols. An inverted index holds, by rank of a pair of
neighbouring symbols, the positions where such a pair stands. Ranks are applied from the
least up, at all positions of the block at once; only pairs beside a merged one are
looked up again, and go to the index under their new rank. Words do not touch each other,
so this is what merging each alone would give.

Ranks are indexed in buckets of ``BUCKET`` neighbouring ones. Of a bucket, each word
takes its least rank first, so that within a word the order is exact.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import map_texts, release_memory

RANKS = "byte_bpe_multi_50k.tiktoken"
BUCKET = 7  # bits of a rank
# A block ends when its distinct pre-tokens have so many bytes, or its documents so many
# pre-tokens.
BLOCK_BYTES = 2_000_000
BLOCK_WORDS = 4_000_000
# A longer text's pre-tokens are found one by one, not listed.
LONG_TEXT = 1_000_000
OUT_ROWS = 500

_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}


class PairTable:
    """The rank of what two neighbouring tokens join to, for arrays of pairs.

    Open addressing: a pair is looked for at its hash and at the places behind it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        pairs: list[tuple[int, int, int]] = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank))
        table = np.array(pairs, np.int64).reshape(-1, 3)
        self._bits = max(4, int(4 * len(table)).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._ranks = np.full(1 << self._bits, _NONE, np.int32)
        keys, found = (table[:, 0] << 32) | table[:, 1], table[:, 2].astype(np.int32)
        at = self._slots(keys)
        while len(keys):
            free = self._keys[at] == -1
            _, first = np.unique(at, return_index=True)
            placed = np.zeros(len(keys), bool)
            placed[first] = True
            placed &= free
            self._keys[at[placed]], self._ranks[at[placed]] = keys[placed], found[placed]
            keys, found = keys[~placed], found[~placed]
            at = (at[~placed] + 1) & (len(self._keys) - 1)
        # tokens of which no pair has a lower rank than they have
        size = max(ranks.values(), default=0) + 1
        least = np.full(size, _NONE, np.int64)
        for side in (0, 1):
            np.minimum.at(least, table[:, side], table[:, 2])
        self.rising = least > np.arange(size)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_NONE`` for a pair that does not join."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slots(keys)
        held = self._keys[at]
        found = np.where(held == keys, self._ranks[at], _NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self._keys) - 1)
            held = self._keys[at[open_]]
            same = held == keys[open_]
            found[open_[same]] = self._ranks[at[open_[same]]]
            open_ = open_[~same & (held != -1)]
        return found


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The different positions in these, sorted."""
    at = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int32)
    return at[np.append(at[:-1] != at[1:], True)] if len(at) else at


class Replay:
    """Words to ids by the merges of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self._table = PairTable(ranks)
        self._bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has; no word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return np.zeros(0, np.int32), sizes
        symbol = self._bytes[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - sizes] = -1
        rank = np.full(n, _NONE, np.int32)  # of each symbol with the one after it
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Look the pairs at these positions up, and index those that join."""
            right = after[at]
            joined = right >= 0
            rank[at[~joined]] = _NONE
            at = at[joined]
            rank[at] = self._table.ranks(symbol[at], symbol[right[joined]])
            at = at[rank[at] != _NONE]
            bucket = rank[at] >> BUCKET
            order = np.argsort(bucket, kind="stable")
            at, bucket = at[order], bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(at)]):
                k = int(bucket[a])
                if k not in index:
                    index[k] = []
                    heapq.heappush(heap, k)
                index[k].append(at[a:b])

        enter(np.arange(n, dtype=np.int32))
        while heap:
            k = heap[0]
            at = _distinct(index[k])
            at = at[(rank[at] != _NONE) & (rank[at] >> BUCKET == k)]
            index[k] = []
            if not len(at):
                heapq.heappop(heap)
                del index[k]
                continue
            now = self._chosen(at, word[at], rank[at], symbol, before, after)
            rest = at[~now]
            if len(rest):
                index[k].append(rest)  # looked at again when nothing has a lower rank
            at = at[now]
            gone = after[at]
            behind = after[gone]
            symbol[at] = rank[at]
            alive[gone] = False
            rank[gone] = _NONE
            after[at] = behind
            before[behind[behind >= 0]] = at[behind >= 0]
            left = before[at]
            enter(_distinct([at, left[left >= 0]]))
        return symbol[alive], np.add.reduceat(alive, ends - sizes, dtype=np.int64)

    def _chosen(self, at, word, rank, symbol, before, after) -> np.ndarray:
        """Which of these pairs of a bucket are merged now: in each word, those of its least rank.

        Of pairs that share a symbol, every other one from the left. Where a merge makes a
        pair of a lower rank, that one is next, so the word's later ones wait.
        """
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sizes = np.diff(first, append=len(at))
        now = rank == np.repeat(np.minimum.reduceat(rank, first), sizes)
        place = np.flatnonzero(now)
        if len(place) == len(first):
            return now  # one in each word
        shares = after[at[place[:-1]]] == at[place[1:]]
        if shares.any():
            i = np.arange(len(place))
            run = np.maximum.accumulate(np.where(np.append(False, shares), 0, i))
            now[place[(i - run) % 2 == 1]] = False
            place = np.flatnonzero(now)
        falling = ~self._table.rising[rank[place]]
        again = word[place[1:]] == word[place[:-1]]
        if (falling[1:] & again).any():
            place = place[falling]
            again = word[place[1:]] == word[place[:-1]]
            made, own = rank[place], at[place]
            left, right = before[own], after[after[own]]
            merged = np.append(False, again & (right[:-1] == own[1:]))  # what stands before it
            beside = np.where(merged, made, symbol[left])
            low = (left >= 0) & (self._table.ranks(beside, made) < made)
            low |= (right >= 0) & (self._table.ranks(made, symbol[right]) < made)
            # lower pairs made by earlier ones of the word
            seen = np.cumsum(low) - low
            opens = np.flatnonzero(np.append(True, ~again))
            base = np.repeat(seen[opens], np.diff(opens, append=len(place)))
            now[place[seen > base]] = False
        return now


class _Numbers(dict):
    """Numbers words by first occurrence, and adds up the length of the distinct ones."""

    def __init__(self):
        super().__init__()
        self.size = 0

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.size += len(word)
        return number


def _encoding(path: str, pattern: str, n_kept: int, most_bytes: int, most_words: int, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        replay, split = Replay(ranks), regex.compile(pattern)
        decimal = [str(i) for i in range(max(ranks.values()) + 1)]
        numbers, held, n_words = _Numbers(), [], 0

        def words_of(text: str) -> np.ndarray:
            if len(text) <= long:
                found = map(numbers.__getitem__, split.findall(text))
            else:
                found = (numbers[m.group()] for m in split.finditer(text))
            return np.fromiter(found, np.int32)

        def encoded() -> Iterator[pa.RecordBatch]:
            nonlocal numbers, held, n_words
            words = [w.encode() for w in numbers]
            ids: list[str] = [""] * len(words)
            counts = np.ones(len(words), np.int64)
            merged = []
            for i, w in enumerate(words):  # a word that is a token is not merged
                if (own := ranks.get(w)) is not None:
                    ids[i] = decimal[own]
                else:
                    merged.append(i)
            flat, sizes = replay.encode([words[i] for i in merged])
            named, at = [decimal[i] for i in flat.tolist()], 0
            for i, size in zip(merged, sizes.tolist()):
                ids[i] = ",".join(named[at : at + size])
                at += size
            counts[merged] = sizes
            for start in range(0, len(held), OUT_ROWS):
                part = held[start : start + OUT_ROWS]
                kept = [pa.concat_arrays(c) for c in zip(*[k for k, _ in part])]
                texts = [",".join([ids[i] for i in w.tolist()]) for _, w in part]
                n = [int(counts[w].sum()) for _, w in part]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(n, pa.int64()), pa.array(texts, pa.string())],
                    names=[*(f"k{i}" for i in range(n_kept)), "n_tokens", "ids"],
                )
            numbers, held, n_words = _Numbers(), [], 0

        for batch in batches:
            texts = batch.column(n_kept)
            for i in range(batch.num_rows):
                data = texts[i].as_py() or b""
                words = words_of(data.decode("utf-8", "replace"))
                held.append(([batch.column(c).slice(i, 1) for c in range(n_kept)], words))
                n_words += len(words)
                if numbers.size >= most_bytes or n_words >= most_words:
                    yield from encoded()
        if held:
            yield from encoded()
        del numbers, held, replay, ranks
        release_memory()

    return run


def encode(
    documents: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """``keep``, ``n_tokens`` and ``ids`` (decimal, joined by commas) of every row's whole ``text``.

    Each match of ``pattern`` is encoded on its own, without special tokens: as itself if
    it is a token, else by merges. Null and empty texts have no ids. Nothing is shuffled,
    rows come out as often as they go in, and other columns are not read, so they may
    have any names. Bytes that are not UTF-8 count as the replacement character.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    held = documents.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        F.col("text").cast("binary").alias("t"),
    )
    kept = [f"k{i} {t}" for i, (_, t) in enumerate(held.dtypes[:-1])]
    run = _encoding(path, pattern, len(keep), BLOCK_BYTES, BLOCK_WORDS, LONG_TEXT)
    rows = held.mapInArrow(run, ", ".join([*kept, "n_tokens bigint, ids string"]))
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids")


def decode(
    encoded: DataFrame, keep: Sequence[str] = ("doc_id",), ranks_path: str | None = None
) -> DataFrame:
    """``keep`` and ``data``, the bytes that ``ids`` stand for; none for null or no ids.

    An id that the vocabulary lacks is an error.
    """
    path = ranks_path or public_tokenizers.path(RANKS)

    def prepare():
        tokens = {str(n).encode(): t for t, n in load_ranks(path).items()}

        def compute(rows):
            return [[b"".join(map(tokens.__getitem__, r.split(b","))) if r else b"" for r in rows]]

        return compute

    return map_texts(encoded, "ids", keep, "data binary", prepare)


def digests(documents: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: hashes of the ids and of their bytes."""
    encoded = encode(documents, ranks_path=ranks_path).withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = decode(encoded, ("doc_id", "n_tokens", "ids_sha256"), ranks_path)
    return decoded.select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("data", 256).alias("decoded_sha256")
    )
