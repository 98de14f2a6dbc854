"""Katz backoff language model over whole corpora, by blocks of documents.

A block of documents knows its distinct words and word pairs. It asks the shards of a
count table for theirs, once for each however often they occur, so a word that is
everywhere costs a row for each block. Shards add up counts and answer; blocks then
score their own texts.

Words and pairs of words are counted without a cut: each word met in training is a class
of its own. A caller may set a least share of all tokens; the words below it then are
one class, within which a word has its share as a single word. The probabilities of all
words, and of one more for all that were never met, sum to 1 after every word.

No table of words is broadcast or collected: blocks number their words by the answers of
the shards, and send with each pair how often its second word occurs. Pairs are sharded
by their first word, those of a very frequent one by their second as well; what is known
of a first word are sums, which its shards give in parts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import is_held_out, stage

FOLDS = 10
BLOCK_TOKENS = 3_000_000
SHARD_WORDS = 500_000
SHARD_TOKENS = 1_500_000
HASH_BYTES = 12  # of a word; two of a billion words are alike once in 10^11 corpora
CLASS_SHARE = 0.0  # of all tokens, that a word needs to be a class of its own
# Good-Turing estimates apply to counts up to this.
MOST = 5
END, OTHER = 0, 1  # classes; the other words' classes begin behind
MARK = 0xFFFFFFFF  # in place of a second word: asks for what is known of the first alone
ADDED = 0.1  # of the base score


def _pack(values: np.ndarray) -> bytes:
    """An array compressed, byte by byte of its numbers."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the total of each, and the place of every key among them."""
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, counts, len(distinct)).astype(np.int64), where


# -- blocks of documents --------------------------------------------------------------

_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.binary()),
        ("held", pa.binary()),
        ("tokens", pa.binary()),
        ("words", pa.binary()),
        ("counts", pa.binary()),
        ("n_tokens", pa.int64()),
        ("n_train", pa.int64()),
        ("n_train_docs", pa.int64()),
        ("n_words", pa.int64()),
    ]
)
_BLOCK_SCHEMA = (
    "block bigint, doc_ids array<bigint>, lengths binary, held binary, tokens binary, "
    "words binary, counts binary, n_tokens bigint, n_train bigint, n_train_docs bigint, "
    "n_words bigint"
)


def _block_row(number: int, ids: list, lengths: list, held: list, stream: array, found: dict):
    """One block: its words sorted by hash, and its tokens as their places, 0 for an end."""
    hashes = np.array([xxhash.xxh3_128_digest(w)[:HASH_BYTES] for w in found], f"S{HASH_BYTES}")
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order) + 1, np.int32)
    place[0] = 0
    place[order + 1] = np.arange(1, len(order) + 1)
    tokens = place[np.frombuffer(stream, np.int32)]
    train = np.repeat(~np.array(held, bool), lengths)
    counts = np.bincount(tokens[train], minlength=len(order) + 1)[1:].astype(np.int32)
    return pa.RecordBatch.from_pydict(
        {
            "block": [number],
            "doc_ids": [ids],
            "lengths": [_pack(np.array(lengths, np.int32))],
            "held": [_pack(np.array(held, np.uint8))],
            "tokens": [_pack(tokens.astype(np.int32))],
            "words": [hashes[order].tobytes()],
            "counts": [_pack(counts)],
            "n_tokens": [len(tokens)],
            "n_train": [int(train.sum())],
            "n_train_docs": [len(held) - sum(held)],
            "n_words": [len(order)],
        },
        schema=_BLOCK,
    )


def _blocking(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        ids, lengths, held, stream, found = [], [], [], array("i"), {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").lower().split()
                stream.extend([found.setdefault(w, len(found) + 1) for w in words])
                stream.append(0)
                ids.append(doc_id)
                lengths.append(len(words) + 1)
                held.append(is_held_out(doc_id, FOLDS))
                if len(stream) >= block_tokens:
                    yield _block_row(base + number, ids, lengths, held, stream, found)
                    number += 1
                    ids, lengths, held, stream, found = [], [], [], array("i"), {}
        if ids:
            yield _block_row(base + number, ids, lengths, held, stream, found)

    return run


# -- counts of words ------------------------------------------------------------------

_ASKED = "shard bigint, block bigint, keys binary, counts binary"
_ASKED_PAIRS = f"{_ASKED}, seconds binary"


def _asking_words(shards: int):
    """A block's distinct words and training counts, cut by ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*[c.to_pylist() for c in batch.columns]):
                heads = np.frombuffer(words, ">u4").reshape(-1, HASH_BYTES // 4)[:, 0].astype(np.uint64)
                shard = (heads * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                numbers = _unpack(counts, np.int32)
                for s, a, b in _runs(shard):
                    yield _asked(s, block, words[HASH_BYTES * a : HASH_BYTES * b], numbers[a:b])

    return run


def _asked(shard: int, block: int, keys: bytes, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"shard": [shard], "block": [block], "keys": [keys], "counts": [_pack(counts)]},
        schema=pa.schema(
            [("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
        ),
    )


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values: the value, where it begins, and where it ends."""
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
            yield int(values[a]), a, b


# An answer to a block, or (block null) a shard's own figures
_ANSWER = "block bigint, shard bigint, kind int, totals binary, more binary, figures array<bigint>"
WORDS, PAIRS = 1, 2


def _classes(totals: np.ndarray, least: float) -> np.ndarray:
    """Whether words with these totals are classes of their own."""
    return (totals >= least) & (totals > 0)


def _answer_words(least: float, heavy: int):
    """Totals of a shard's words to each block that asked, and their places as classes.

    Places are those of a word or the class before it, as differences. A shard's own
    figures: how many words were met, and how many of each count up to ``MOST + 1``; how
    many classes, of each count up to ``MOST``, and the tokens of those with more. Then
    the places and totals of classes with more than ``heavy`` tokens, few by their size.
    """

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        group = group.sort_values("block")
        parts = [np.frombuffer(k, f"S{HASH_BYTES}") for k in group["keys"]]
        counts = np.concatenate([_unpack(c, np.int32) for c in group["counts"]])
        _, totals, where = _sums(np.concatenate(parts), counts)
        own_class = _classes(totals, least)
        place = np.cumsum(own_class)
        rows, at = [], 0
        for block, part in zip(group["block"], parts):
            own = where[at : at + len(part)]
            at += len(part)
            steps = np.diff(place[own], prepend=0).astype(np.int32)
            rows.append((block, shard, WORDS, _pack(totals[own]), _pack(steps), None))
        met, among = totals[totals > 0], totals[own_class]
        large = own_class & (totals > heavy)
        figures = [
            len(met),
            *np.bincount(met[met <= MOST + 1], minlength=MOST + 2)[1:],
            len(among),
            *np.bincount(among[among <= MOST], minlength=MOST + 1)[1:],
            among[among > MOST].sum(),
        ]
        figures += [*place[large], *totals[large]]
        rows.append((None, shard, WORDS, None, None, [int(f) for f in figures]))
        return _answers(rows)

    return answer


def _answers(rows: list[tuple]) -> pd.DataFrame:
    names = ["block", "shard", "kind", "totals", "more", "figures"]
    frame = pd.DataFrame(rows, columns=names)
    frame["block"] = frame["block"].astype("Int64")
    return frame


# -- estimates ------------------------------------------------------------------------


def discounts(of_count: list[int]) -> np.ndarray:
    """By count r up to ``MOST``, what is kept of it; ``of_count[r]`` have the count r.

    Good-Turing, scaled so that larger counts are kept whole. Where that is not between
    0 and 1, as in small tables, half a count is taken off.
    """
    kept = np.ones(MOST + 1)
    n = of_count
    common = (MOST + 1) * n[MOST + 1] / n[1] if n[1] else 1.0
    for r in range(1, MOST + 1):
        d = -1.0
        if n[r] and common < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        kept[r] = d if 0 < d < 1 else (r - 0.5) / r
    return kept


def kept_counts(counts: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Counts after discounting."""
    return counts * np.where(counts <= MOST, kept[np.minimum(counts, MOST)], 1.0)


@dataclass(frozen=True)
class Estimates:
    """What blocks need besides their own answers; of bounded size."""

    n: int  # training tokens
    distinct: int
    ends: int
    least: float  # tokens of a class
    word_kept: np.ndarray
    unmet: float  # the probability of all words not met
    whole: float  # what single-word counts are divided by
    other: float  # the probability of the class of all others
    bases: np.ndarray  # by shard of words, the classes before it
    heavy: np.ndarray  # classes with the pairs of several shards
    spread: np.ndarray  # and of how many

    def single(self, counts: np.ndarray) -> np.ndarray:
        """The probability of words by their counts."""
        return np.where(counts > 0, kept_counts(counts, self.word_kept) / self.whole, self.unmet)


WORD_FIGURES = 2 * MOST + 4  # of a shard, before those of its heavy classes


def estimate(n: int, ends: int, least: float, shard_tokens: int, own: dict[int, list[int]], shards: int):
    """The estimates by the ``own`` figures of each shard of words."""
    figures = np.zeros((shards, WORD_FIGURES), np.int64)
    for s, f in own.items():
        figures[s] = f[:WORD_FIGURES]
    bases = np.cumsum(figures[:, MOST + 2]) - figures[:, MOST + 2]
    total = figures.sum(0).tolist()
    if total[MOST + 2] + 2 >= 1 << 31:
        raise RuntimeError("pairs hold the numbers of two words in 31 bits each")
    of_count = [0, *total[1 : MOST + 2]]
    if 0 < ends <= MOST + 1:  # the end is a token as well
        of_count[ends] += 1
    kept = discounts(of_count)
    lost = sum(of_count[r] * r * (1 - kept[r]) for r in range(1, MOST + 1))
    whole = float(n) if lost > 0 else n + 1.0
    unmet = (lost if lost > 0 else 1.0) / whole
    small, large = total[MOST + 3 : 2 * MOST + 3], total[-1]
    inside = large + sum(c * r * kept[r] for r, c in enumerate(small, 1))
    inside += kept_counts(np.array([ends]), kept)[0]
    rest = n - ends - large - sum(c * r for r, c in enumerate(small, 1))
    heavy = {END: ends, OTHER: rest}
    for s, f in own.items():
        places, totals = np.array(f[WORD_FIGURES:], np.int64).reshape(2, -1)
        heavy |= dict(zip((places + bases[s] + 1).tolist(), totals.tolist()))
    spread = {c: 1 + t // shard_tokens for c, t in sorted(heavy.items()) if t > shard_tokens}
    return Estimates(
        n, total[0] + (ends > 0), ends, least, kept, unmet, whole, max(unmet, 1.0 - inside / whole), bases,
        np.array([*spread], np.int64), np.array([*spread.values()], np.int64),
    )


# -- counts of pairs ------------------------------------------------------------------


def _words_of(answers: pd.DataFrame, e: Estimates, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals and classes of a block's words by the answers of all shards, the end before them."""
    totals, of_word = [np.array([e.ends], np.int64)], [np.array([END], np.int64)]
    for a in answers.sort_values("shard").itertuples(index=False):
        found = _unpack(a.totals, np.int64)
        place = np.cumsum(_unpack(a.more, np.int32), dtype=np.int64)
        totals.append(found)
        of_word.append(np.where(_classes(found, e.least), place + e.bases[a.shard] + 1, OTHER))
    counts = np.concatenate(totals)
    if len(counts) != n_words + 1:
        raise RuntimeError("a block did not get all its answers")
    return counts, np.concatenate(of_word)


def _pairs(tokens: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """Each token's class after the one before it, as a number; a text begins after an end."""
    classes = of_word[tokens]
    before = np.concatenate([[END], classes[:-1]]).astype(np.int64)
    return before << 32 | classes


def _shard_of(first: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    mixed = (first | part << 32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _distinct_pairs(pairs: np.ndarray, e: Estimates, shards: int):
    """Distinct pairs by shard and number, their shards, and the place of each pair among them.

    All successors of a class are together, but those of a heavy one are spread by the
    class behind. Each of its shards is asked for it, with a mark if no pair is.
    """
    distinct, where = np.unique(pairs, return_inverse=True)
    first, second = distinct >> 32, (distinct & 0xFFFFFFFF).astype(np.uint64)
    part = np.zeros(len(distinct), np.int64)
    if len(e.heavy):
        at = np.minimum(np.searchsorted(e.heavy, first), len(e.heavy) - 1)
        spread = np.where(e.heavy[at] == first, e.spread[at], 1)
        part = ((second * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)) % spread.astype(np.uint64)).astype(np.int64)
    shard = _shard_of(first, part, shards)
    here = np.isin(e.heavy, first)
    marked = np.repeat(e.heavy[here], e.spread[here])
    parts = np.concatenate([np.zeros(0, np.int64), *[np.arange(k) for k in e.spread[here]]])
    marks = np.unique(np.array([_shard_of(marked, parts, shards), marked << 32 | MARK]), axis=1)
    every, of = np.concatenate([distinct, marks[1]]), np.concatenate([shard, marks[0]])
    order = np.lexsort((every, of))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return every[order], of[order], place[where]


def _asking_pairs(held, shards: int):
    """A block's distinct pairs and training counts, with the totals of their second words."""

    def ask(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        e, rows = Estimates(**held.value), []
        for b in blocks.itertuples(index=False):
            counts, of_word = _words_of(answers, e, b.n_words)
            tokens = _unpack(b.tokens, np.int32)
            distinct, shard, where = _distinct_pairs(_pairs(tokens, of_word), e, shards)
            train = np.repeat(_unpack(b.held, np.uint8) == 0, _unpack(b.lengths, np.int32))
            times = np.bincount(where[train], minlength=len(distinct)).astype(np.int32)
            seconds = np.zeros(len(distinct), np.int64)
            seconds[where] = np.where(of_word == OTHER, 0, counts)[tokens]
            for s, x, y in _runs(shard):
                keys = _pack(np.diff(distinct[x:y], prepend=0))
                rows.append((s, b.block, keys, _pack(times[x:y]), _pack(seconds[x:y])))
        return pd.DataFrame(rows, columns=["shard", "block", "keys", "counts", "seconds"])

    return ask


FIRST_FIGURES = 3 + 2 * MOST


def _answer_pairs(group: pd.DataFrame) -> pd.DataFrame:
    """Totals of a shard's pairs, and what blocks need of each class that they follow.

    Of a class: the tokens behind it; of the classes behind it the tokens of those with
    more than ``MOST``, whether the class of all others is one, and how many have each
    small count; and how many pairs have each small count.
    """
    shard = int(group["shard"].iloc[0])
    group = group.sort_values("block")
    parts = [np.cumsum(_unpack(k, np.int64)) for k in group["keys"]]
    counts = np.concatenate([_unpack(c, np.int32) for c in group["counts"]])
    distinct, totals, where = _sums(np.concatenate(parts), counts)
    of_second = np.zeros(len(distinct), np.int64)
    of_second[where] = np.concatenate([_unpack(s, np.int64) for s in group["seconds"]])
    firsts, of_first = np.unique(distinct >> 32, return_inverse=True)
    seen = totals > 0
    other = seen & ((distinct & 0xFFFFFFFF) == OTHER)
    table = [
        np.bincount(of_first, totals, len(firsts)),
        np.bincount(of_first, np.where(seen & (of_second > MOST), of_second, 0), len(firsts)),
        np.bincount(of_first, other, len(firsts)),
        *[np.bincount(of_first, seen & (of_second == r), len(firsts)) for r in range(1, MOST + 1)],
        *[np.bincount(of_first, totals == r, len(firsts)) for r in range(1, MOST + 1)],
    ]
    table = np.array(table).astype(np.int64)
    rows, at = [], 0
    for block, part in zip(group["block"], parts):
        own = where[at : at + len(part)]
        at += len(part)
        asked = np.searchsorted(firsts, np.unique(part >> 32))
        rows.append((block, shard, PAIRS, _pack(totals[own]), _pack(table[:, asked].reshape(-1)), None))
    met = totals[seen & (totals <= MOST + 1)]
    figures = np.bincount(met, minlength=MOST + 2)[1:].tolist()
    rows.append((None, shard, PAIRS, None, None, figures))
    return _answers(rows)


def after(totals: np.ndarray, first: np.ndarray, single: np.ndarray, kept: np.ndarray, e: Estimates) -> np.ndarray:
    """The probability of a class by what is known of the class before it.

    ``first`` has, for each pair, the figures of the class before, ``single`` the single
    probability of the one behind. A pair met has its discounted share; others share what
    is left, as their single probabilities are to each other.
    """
    small = np.arange(1, MOST + 1)
    whole = first[:, 0]
    met = (first[:, 1] + first[:, 3 : 3 + MOST] @ (small * e.word_kept[1:])) / e.whole + first[:, 2] * e.other
    lost = first[:, 3 + MOST :] @ (small * (1 - kept[1 : MOST + 1]))
    every = met > 1 - 1e-9  # nothing is left that did not follow
    spare = np.where(lost > 0, lost, 1.0)  # where no count is small, one more is added
    size = np.where(lost > 0, whole, whole + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(every, totals / whole, kept_counts(totals, kept) / size)
        rest = spare / size / np.maximum(1 - met, 1e-12) * single
    return np.where(whole == 0, single, np.where(totals > 0, own, rest))


# -- scoring --------------------------------------------------------------------------

_SCORE = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def _scoring(held, shards: int):
    def score(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        fields, kept = held.value
        e = Estimates(**fields)
        parts = [_score_block(b, answers, e, kept, shards) for b in blocks.itertuples(index=False)]
        names = [f.split(" ")[0] for f in _SCORE.split(", ")]
        return pd.concat(parts) if parts else pd.DataFrame(columns=names)

    return score


def _score_block(block, answers: pd.DataFrame, e: Estimates, kept: np.ndarray, shards: int):
    lengths = _unpack(block.lengths, np.int32).astype(np.int64)
    tokens = _unpack(block.tokens, np.int32)
    counts, of_word = _words_of(answers[answers["kind"] == WORDS], e, block.n_words)
    distinct, _, where = _distinct_pairs(_pairs(tokens, of_word), e, shards)
    firsts, of_first = np.unique(distinct >> 32, return_inverse=True)
    table = np.zeros((len(firsts), FIRST_FIGURES), np.int64)
    numbers, at = [np.zeros(0, np.int64)], 0
    for a in answers[answers["kind"] == PAIRS].sort_values("shard").itertuples(index=False):
        own = _unpack(a.totals, np.int64)
        asked = np.unique(of_first[at : at + len(own)])
        table[asked] += _unpack(a.more, np.int64).reshape(FIRST_FIGURES, -1).T
        at += len(own)
        numbers.append(own)
    if at != len(distinct):
        raise RuntimeError("a block did not get all its answers")
    if e.n:
        single = np.zeros(len(distinct))
        of_class = np.where(of_word == OTHER, e.other, e.single(counts))
        single[where] = of_class[tokens]
        with np.errstate(divide="ignore"):  # marks are no pairs
            p = np.log10(after(np.concatenate(numbers), table[of_first], single, kept, e))
        # a word of the class of all others: its share of the class
        within = np.where(of_word == OTHER, np.log10(e.single(counts) / e.other), 0.0)
    else:  # nothing was met, so every token is the one not met
        p, within = np.zeros(len(distinct)), np.zeros(len(counts))
    base = np.log10((counts + ADDED) / (e.n + ADDED * (e.distinct + 1)))
    ends = np.cumsum(lengths)
    starts = ends - lengths

    def by_document(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, starts)

    return pd.DataFrame(
        {
            "doc_id": pd.array(list(block.doc_ids), dtype="Int64"),
            "held_out": _unpack(block.held, np.uint8) > 0,
            "n_tokens": lengths,
            "n_known": by_document((counts > 0).astype(np.int64)[tokens]),
            "train_tokens": e.n,
            "base_score": by_document(base[tokens]),
            "score": by_document(p[where] + within[tokens]),
        }
    )


def score(documents: DataFrame, block_tokens: int = BLOCK_TOKENS, share: float = CLASS_SHARE) -> DataFrame:
    """Score every whole text by a model of those outside the held-out tenth.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row for
    each row of ``documents``. Null texts are empty: the end alone. Nulls among ids are
    not held out or are, as empty text is. Without training texts every token is one not
    met and has probability 1. Repeated rows count as often as they occur.

    Words with less than ``share`` of all training tokens are one class. The tables of
    the model, counts by shard with the answers to blocks, are written to the shared
    folder. What the driver holds are sums, and the few words with more tokens than a
    shard has.
    """
    spark = documents.sparkSession
    blocks = stage(
        documents.select("doc_id", F.col("text").cast("binary"))
        .select(F.col("doc_id").cast("bigint"), "text")
        .mapInArrow(_blocking(block_tokens), _BLOCK_SCHEMA),
        "katz-blocks",
    )
    sizes = blocks.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_train", "n_train_docs", "n_words")]
    ).first()
    n_tokens, n_train, ends, n_words = map(int, sizes)
    word_shards = max(1, -(-n_words // SHARD_WORDS))
    words = stage(
        blocks.select("block", "words", "counts")
        .mapInArrow(_asking_words(word_shards), _ASKED)
        .groupBy("shard")
        .applyInPandas(_answer_words(n_train * share, SHARD_TOKENS), _ANSWER),
        "katz-words",
    )
    own = words.filter("block IS NULL").select("shard", "figures").collect()
    own = {r["shard"]: r["figures"] for r in own}
    estimates = estimate(n_train, ends, n_train * share, SHARD_TOKENS, own, word_shards)
    pair_shards = max(1, -(-n_tokens // SHARD_TOKENS))
    held = spark.sparkContext.broadcast(vars(estimates))
    pairs = stage(
        _with_answers(blocks.select("block", "lengths", "held", "tokens", "n_words"), words)
        .applyInPandas(_asking_pairs(held, pair_shards), _ASKED_PAIRS)
        .groupBy("shard")
        .applyInPandas(_answer_pairs, _ANSWER),
        "katz-pairs",
    )
    of_pairs = pairs.filter("block IS NULL").select(F.posexplode("figures")).groupBy("pos").agg(
        F.sum("col").alias("n")
    )
    of_count = [0] * (MOST + 2)
    for row in of_pairs.collect():
        of_count[row["pos"] + 1] = row["n"]
    return _scores(blocks, words.unionByName(pairs), estimates, discounts(of_count), pair_shards)


def _with_answers(blocks: DataFrame, answers: DataFrame):
    """Blocks and the answers to them."""
    answers = answers.filter("block IS NOT NULL").drop("figures").withColumnRenamed("block", "to")
    return blocks.groupBy("block").cogroup(answers.groupBy("to"))


def _scores(blocks: DataFrame, answers: DataFrame, estimates: Estimates, kept, shards: int) -> DataFrame:
    held = blocks.sparkSession.sparkContext.broadcast((vars(estimates), kept))
    texts = blocks.select("block", "doc_ids", "lengths", "held", "tokens", "n_words")
    return _with_answers(texts, answers).applyInPandas(_scoring(held, shards), _SCORE)
