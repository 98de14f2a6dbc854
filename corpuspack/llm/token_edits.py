"""Token counts that follow edits of documents without counting them anew.

A document is a segment tree over its pre-tokens: leaves hold some of them, inner nodes
the characters and tokens below. An edit re-encodes the pre-tokens it touches and as many
beside it as may come out otherwise, and updates the sums above their leaves.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.tiktoken"
LEAF = 64
# A pre-token depends on no more than so many characters behind its end.
LOOKAHEAD = 3
CACHE_PIECES = 700_000


class Counts(dict):
    """From a pre-token to its number of tokens."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._encode = coder.encode_ordinary
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = n = len(self._encode(piece))
        return n


class Document:
    """The segment tree of a text."""

    def __init__(self, text: str, counts: Counts):
        self._counts = counts
        self.reencoded = 0
        self._build(counts.pattern.findall(text))

    def _build(self, pieces: list[str]) -> None:
        self._leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        size = 1
        while size < len(self._leaves):
            size *= 2
        self._size = size
        token, length = self._counts.__getitem__, len
        tokens = [0] * size + [sum(map(token, leaf)) for leaf in self._leaves]
        chars = [0] * size + [sum(map(length, leaf)) for leaf in self._leaves]
        tokens += [0] * (2 * size - len(tokens))
        chars += [0] * (2 * size - len(chars))
        for i in range(size - 1, 0, -1):
            tokens[i] = tokens[2 * i] + tokens[2 * i + 1]
            chars[i] = chars[2 * i] + chars[2 * i + 1]
        self._tokens, self._chars = tokens, chars

    @property
    def tokens(self) -> int:
        return self._tokens[1]

    @property
    def chars(self) -> int:
        return self._chars[1]

    @property
    def text(self) -> str:
        return "".join(p for leaf in self._leaves for p in leaf)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf with a character, the last one at the end, and where the leaf begins."""
        node, begin = 1, 0
        while node < self._size:
            node *= 2
            if position >= begin + self._chars[node] and self._chars[node + 1]:
                begin += self._chars[node]
                node += 1
        return min(node - self._size, len(self._leaves) - 1), begin

    def _update(self, leaf: int) -> None:
        node = self._size + leaf
        self._tokens[node] = sum(map(self._counts.__getitem__, self._leaves[leaf]))
        self._chars[node] = sum(map(len, self._leaves[leaf]))
        node //= 2
        while node:
            self._tokens[node] = self._tokens[2 * node] + self._tokens[2 * node + 1]
            self._chars[node] = self._chars[2 * node] + self._chars[2 * node + 1]
            node //= 2

    def edit(self, start: int, length: int, inserted: str) -> int:
        """Replace ``length`` characters from ``start`` on; the new number of tokens.

        What lies outside the text is cut off.
        """
        start = min(max(0, start), self.chars)
        end = min(start + max(0, length), self.chars)
        first, begin = self._leaf_at(max(0, start - LOOKAHEAD))
        # pre-tokens before this one end early enough to stay as they are
        at, skip = begin, 0
        for piece in self._leaves[first]:
            if at + len(piece) + LOOKAHEAD > start:
                break
            at += len(piece)
            skip += 1
        last, wider = self._leaf_at(end)[0], 1
        while True:
            old = [p for leaf in self._leaves[first : last + 1] for p in leaf][skip:]
            whole = last == len(self._leaves) - 1
            found = self._match(old, at, start, end, inserted, whole)
            if found is not None:
                break
            last = min(last + wider, len(self._leaves) - 1)
            wider *= 2
        new, gone = found
        self.reencoded += len(new)
        kept = self._leaves[first][:skip] + new + old[gone:]
        self._put(first, last, kept)
        return self.tokens

    def _match(
        self, old: list[str], at: int, start: int, end: int, inserted: str, whole: bool
    ) -> tuple[list[str], int] | None:
        """New pre-tokens from ``at`` on, and how many of the old ones they stand for.

        They end where an old pre-token begins behind the edit. None if more text must
        be looked at.
        """
        text = "".join(old)
        new_text = text[: start - at] + inserted + text[end - at :]
        shift = len(new_text) - len(text)
        bounds, place = {}, 0
        for i, piece in enumerate(old):
            bounds[place] = i
            place += len(piece)
        bounds[place] = len(old)
        changed = start - at + len(inserted)
        new: list[str] = []
        here = 0
        matches = self._counts.pattern.finditer(new_text)
        while True:
            if here >= changed and here - shift in bounds:
                return new, bounds[here - shift]
            match = next(matches, None)
            if match is None:
                return (new, len(old)) if whole else None
            if not whole and match.end() + LOOKAHEAD > len(new_text):
                return None
            new.append(match.group())
            here = match.end()

    def _put(self, first: int, last: int, pieces: list[str]) -> None:
        """Lay pieces into a run of leaves, evenly; build anew if they would be too full."""
        slots = last - first + 1
        if len(pieces) > 4 * LEAF * slots:
            leaves = [*self._leaves[:first], pieces, *self._leaves[last + 1 :]]
            self._build([p for leaf in leaves for p in leaf])
            return
        each = -(-len(pieces) // slots)
        for i in range(slots):
            self._leaves[first + i] = pieces[i * each : (i + 1) * each]
            self._update(first + i)


_SCHEMA = (
    "doc_id bigint, n_tokens bigint, n_pretokens bigint, n_edits int, tokens_after bigint, "
    "chars_after bigint, n_reencoded bigint"
)


def _counting(path: str, pattern: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path, pattern)
        names = [f.split(" ")[0] for f in _SCHEMA.split(", ")] + ["text"] * with_text
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3]
        kinds += [pa.string()] * with_text
        for batch in batches:
            rows = []
            for doc_id, text, edits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                document = Document((text.as_py() or b"").decode("utf-8", "replace"), counts)
                before, pieces = document.tokens, sum(map(len, document._leaves))
                done = 0
                for e in edits.as_py() or ():
                    if e is not None:
                        document.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")
                        done += 1
                row = (
                    doc_id, before, pieces, done, document.tokens, document.chars,
                    document.reencoded,
                )
                rows.append((*row, document.text) if with_text else row)
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

    return run


def count(
    documents: DataFrame, edits: str = "edits", path: str | None = None, with_text: bool = False
) -> DataFrame:
    """Tokens of every document before and after its edits.

    ``edits`` is a column of arrays of ``(start, length, text)``, applied in order, each
    to the text that the one before left: ``length`` characters from ``start`` (from 0)
    are replaced. ``doc_id, n_tokens, n_pretokens, n_edits, tokens_after, chars_after,
    n_reencoded``, the last being pre-tokens that the edits encoded again. A null text is
    empty; null edits are none, a null in an edit is 0 or no text. Rows are counted each
    for themselves, also if they are equal. ``with_text`` adds the edited text.
    """
    return documents.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"), F.col(f"`{edits}`")
    ).mapInArrow(
        _counting(
            path or public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, with_text
        ),
        _SCHEMA + ", text string" * with_text,
    )


def with_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents with the edits of a table ``(doc_id, seq, start, length, text)``.

    In the order of ``seq``. Every edit is in its document's row afterwards, so edits of
    one document must fit a row.
    """
    lists = edits.groupBy("doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "start", "length", "text"))),
            lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["text"].alias("text")),
        ).alias("edits")
    )
    return documents.join(lists, "doc_id", "left")


def revisions(text: Column, doc_id: Column, n: int = 3, size: int = 24) -> Column:
    """Some edits of a text: at places that the id fixes, a few words of it come elsewhere.

    Each takes out up to ``size`` characters and puts in ``size`` from another place.
    """
    length = F.coalesce(F.length(text), F.lit(0))

    def one(j: Column) -> Column:
        return F.struct(
            F.pmod(F.xxhash64(doc_id, j, F.lit("at")), length + 1).alias("start"),
            F.pmod(F.xxhash64(doc_id, j, F.lit("out")), F.lit(size)).alias("length"),
            F.substring(text, (F.pmod(F.xxhash64(doc_id, j, F.lit("in")), length + 1) + 1).cast("int"), F.lit(size)).alias("text"),
        )

    return F.array(*[one(F.lit(j)) for j in range(n)])
