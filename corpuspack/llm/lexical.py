"""Ranked lexical search over a length-stratified index.

Documents of equal normaliser ``m`` form a stratum. Within one, all postings of a term
with the same frequency have the same impact, which is worked out once. The greatest
frequency of each term bounds what a query can score in a stratum, so strata are visited
in order of their bounds until none can have a better document than those found.

Queries are taken in blocks of bounded size. For each, one pass over the texts makes the
postings of its terms; N, L and the terms' document frequencies are counted over all
documents. A stratum is split into rows of at most ``ROW_DOCUMENTS``, so a length that
very many documents have is many rows, dealt over all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.llm.common import map_texts, release_memory, stage
from corpuspack.operators.ordering import running_totals

TOP = 10
# Distinct terms of the queries of a block, summed over queries. A block's queries are
# broadcast; a single query may go beyond.
BLOCK_TERMS = 200_000
ROW_DOCUMENTS = 4096
# Strata that a task holds at a time, as documents.
HELD_DOCUMENTS = 65_536

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters that are not ASCII, A-Z lower-cased."""
    return (text or b"").translate(_LETTERS).split()


@dataclass(frozen=True)
class Queries:
    """A block of queries over numbered terms; ``start[i]`` is where query ``i`` begins."""

    numbers: list[int]
    start: np.ndarray
    term: np.ndarray
    count: np.ndarray


def _blocks(items: DataFrame, block_terms: int) -> tuple[DataFrame, list[int]]:
    """Queries ``q, item_id, terms, counts, block`` and the blocks there are."""

    def prepare():
        def compute(texts):
            counted = [Counter(terms_of(t)) for t in texts]
            return [
                [list(c) for c in counted],
                [list(c.values()) for c in counted],
            ]

        return compute

    fields = "terms array<binary>, counts array<bigint>"
    counted = map_texts(items, "text", ("item_id",), fields, prepare)
    numbered = stage(
        counted.filter(F.size("terms") > 0).withColumn("q", F.monotonically_increasing_id()), "search-queries"
    )
    sizes = numbered.select(F.lit(0).alias("one"), "q", F.size("terms").alias("n"))
    before = running_totals(sizes, "one", ["q"], {"before": F.col("n")})
    blocks = before.select("q", F.floor(F.col("before") / block_terms).alias("block"))
    placed = stage(numbered.join(blocks, "q"), "search-blocks")
    return placed, [r[0] for r in placed.select("block").distinct().orderBy("block").collect()]


def _postings(documents: DataFrame, asked: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document: all its terms, and the asked ones by number."""
    held = documents.sparkSession.sparkContext.broadcast(asked)

    def prepare():
        numbers = held.value

        def compute(texts):
            sizes, terms, counts = [], [], []
            for text in texts:
                words = terms_of(text)
                found = Counter(filter(numbers.__contains__, words))
                sizes.append(len(words))
                terms.append([numbers[w] for w in found])
                counts.append(list(found.values()))
            return sizes, terms, counts

        return compute

    return map_texts(
        documents, "text", ("doc_id",), "n bigint, terms array<int>, tfs array<int>", prepare
    )


_INDEX = (
    "m bigint, ids array<bigint>, term array<int>, tf array<int>, size array<int>, doc array<int>"
)


def _strata(part: pa.RecordBatch) -> pa.RecordBatch:
    """Index rows of documents sorted by ``m``: in each, lists of documents by term and frequency."""
    m = part.column("m").to_numpy()
    lists = part.column("terms")
    sizes = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(m)), sizes)
    term = lists.flatten().to_numpy()
    tf = part.column("tfs").flatten().to_numpy()
    first = np.flatnonzero(np.diff(m, prepend=-1))
    stratum = np.repeat(np.arange(len(first)), np.diff(first, append=len(m)))[doc]
    order = np.lexsort((doc, tf, term, stratum))
    doc, term, tf, stratum = doc[order], term[order], tf[order], stratum[order]
    rows = []
    edges = np.searchsorted(stratum, np.arange(len(first) + 1))
    for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        begin = int(first[s])
        end = int(first[s + 1]) if s + 1 < len(first) else len(m)
        new = (np.diff(term[a:b], prepend=-1) != 0) | (np.diff(tf[a:b], prepend=-1) != 0)
        opens = np.flatnonzero(new)
        rows.append(
            (
                int(m[begin]),
                part.column("doc_id").slice(begin, end - begin).to_pylist(),
                term[a:b][opens],
                tf[a:b][opens],
                np.diff(opens, append=b - a).astype(np.int32),
                (doc[a:b] - begin).astype(np.int32),
            )
        )
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4]
    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in _INDEX.split(", ")])


def _stratify(row_documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, row_documents):
                yield _strata(batch.slice(at, row_documents))

    return run


def index(postings: DataFrame, documents: int, terms: int) -> DataFrame:
    """The stratified index of ``postings (doc_id, n, terms, tfs, row)``, documents without any left out.

    ``documents`` is N and ``terms`` is L. A row is a stratum or a part of one: ``m``, its
    documents' ``ids``, and lists of documents, by number within the row: ``term``,
    ``tf`` and ``size`` of each list, and ``doc``, the lists one after the other.
    """
    m = F.expr(f"25 + (75L * n * {documents}L) div {max(terms, 1)}L")
    placed = postings.filter(F.size("terms") > 0).select("row", "doc_id", m.alias("m"), "terms", "tfs")
    sorted_ = placed.repartitionByRange("m", "row").sortWithinPartitions("m", "row")
    return sorted_.select("doc_id", "m", "terms", "tfs").mapInArrow(_stratify(ROW_DOCUMENTS), _INDEX)


class _Best:
    """The best documents of a query so far: by score, then by id, null ids last."""

    def __init__(self, k: int):
        self._k = k
        self.scores = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.int64)
        self._nulls = np.zeros(0, bool)
        self.least = 1  # a score below is of no use

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores = np.concatenate([self.scores, scores])
        ids = np.concatenate([self._ids, ids])
        nulls = np.concatenate([self._nulls, nulls])
        order = np.lexsort((ids, nulls, -scores))[: self._k]
        self.scores, self._ids, self._nulls = scores[order], ids[order], nulls[order]
        if len(order) == self._k:
            self.least = int(self.scores[-1])

    def rows(self) -> Iterator[tuple[int | None, int]]:
        for score, doc_id, null in zip(self.scores.tolist(), self._ids.tolist(), self._nulls.tolist()):
            yield None if null else doc_id, score


class _Stratum:
    """An index row, with the impact of every list and the greatest one of each term."""

    def __init__(self, row: dict, weights: np.ndarray):
        ids = row["ids"]
        self.nulls = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        term, tf = row["term"].to_numpy(), row["tf"].to_numpy().astype(np.int64)
        sizes = row["size"].to_numpy()
        self.doc = row["doc"].to_numpy()
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * row["m"]) * weights[term]
        self.impact = np.repeat(impact, sizes)  # of every posting
        first = np.flatnonzero(np.diff(term, prepend=-1))
        self.term = term[first]
        starts = np.cumsum(sizes) - sizes
        self.start = np.append(starts[first], len(self.doc))
        self.most = impact[np.append(first[1:], len(term)) - 1]  # frequencies ascend

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where these terms are among those of the stratum, or how many it has."""
        at = np.searchsorted(self.term, terms)
        found = np.minimum(at, len(self.term) - 1)
        return np.where(self.term[found] == terms, found, len(self.term))

    def bounds(self, queries: Queries) -> np.ndarray:
        most = np.append(self.most, 0)[self.places(queries.term)] * queries.count
        return np.add.reduceat(most, queries.start[:-1])

    def scores(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of all documents of the stratum."""
        at = self.places(terms)
        met = at < len(self.term)
        at, counts = at[met], counts[met]
        sizes = self.start[at + 1] - self.start[at]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + sizes, sizes)
        values = self.impact[place] * np.repeat(counts, sizes)
        if values.sum(dtype=np.float64) < 2**52:  # then sums of floats are exact
            return np.bincount(self.doc[place], values, len(self.ids)).astype(np.int64)
        found = np.zeros(len(self.ids), np.int64)
        np.add.at(found, self.doc[place], values)
        return found


def _visit(strata: list[_Stratum], queries: Queries, best: list[_Best]) -> None:
    bounds = np.stack([s.bounds(queries) for s in strata])
    for i, held in enumerate(best):
        a, b = queries.start[i], queries.start[i + 1]
        for s in np.argsort(-bounds[:, i], kind="stable").tolist():
            if bounds[s, i] < held.least:
                break
            scores = strata[s].scores(queries.term[a:b], queries.count[a:b])
            good = np.flatnonzero(scores >= held.least)
            if len(good):
                held.add(scores[good], strata[s].ids[good], strata[s].nulls[good])


def _searching(held, k: int, most_documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = held.value
        best = [_Best(k) for _ in queries.numbers]
        strata: list[_Stratum] = []
        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("ids", "term", "tf", "size", "doc")}
                strata.append(_Stratum(row | {"m": batch.column("m")[i].as_py()}, weights))
                n += len(strata[-1].ids)
                if n >= most_documents:
                    _visit(strata, queries, best)
                    strata, n = [], 0
        if strata:
            _visit(strata, queries, best)
        rows = [(q, d, s) for q, b in zip(queries.numbers, best) for d, s in b.rows()]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in columns], names=["q", "doc_id", "score"]
        )
        del strata, best
        release_memory()

    return run


def _block(placed: DataFrame, block: int) -> tuple[pd.DataFrame, dict[bytes, int]]:
    """The queries of a block and the numbers of their terms."""
    rows = placed.filter(F.col("block") == block).orderBy("q").select("q", "terms", "counts").toPandas()
    numbers: dict[bytes, int] = {}
    for terms in rows["terms"]:
        for t in terms:
            numbers.setdefault(bytes(t), len(numbers))
    return rows, numbers


def search(
    documents: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    ``documents`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``;
    other columns are not read. Every row of ``items`` is a query of its own, also if
    ids repeat or are null; every row of ``documents`` is a document of its own. Equal
    scores go by id, null ids last. Null texts, and texts without terms, find nothing and
    are not found; a document without any asked term scores 0 and is not returned.
    """
    spark = documents.sparkSession
    placed, blocks = _blocks(items, block_terms)
    found = []
    for block in blocks:
        rows, numbers = _block(placed, block)
        made = _postings(documents, numbers).filter("n > 0")
        made = stage(made.withColumn("row", F.monotonically_increasing_id()), "search-postings")
        n, total = made.agg(F.count("*"), F.sum("n")).first()
        counted = made.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
        weights = np.zeros(len(numbers), np.int64)
        for r in counted.collect():  # at most as many as the block has terms
            weights[r["t"]] = weight(r["c"], n)
        sizes = [len(t) for t in rows["terms"]]
        queries = Queries(
            rows["q"].tolist(),
            np.cumsum([0, *sizes]),
            np.array([numbers[bytes(t)] for terms in rows["terms"] for t in terms], np.int64),
            np.concatenate([np.asarray(c, np.int64) for c in rows["counts"]]),
        )
        held = spark.sparkContext.broadcast((queries, weights))
        strata = stage(index(made, n, total or 0), "search-index")
        found.append(strata.mapInArrow(_searching(held, k, HELD_DOCUMENTS), "q bigint, doc_id bigint, score bigint"))
    if not found:
        return placed.select(
            "item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"),
            F.lit(0).cast("bigint").alias("score"),
        ).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(placed.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def weight(df: int, n: int) -> int:
    """Of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_CLASS}') AS t
  FROM documents),
queries AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_CLASS}') AS t
  FROM benchmark),
totals AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM docs WHERE len(t) > 0),
asked AS (SELECT q, term, count(*) AS qf FROM (SELECT q, unnest(t) AS term FROM queries) GROUP BY ALL),
postings AS (
  SELECT r, term, count(*) AS tf
  FROM (SELECT r, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term),
sizes AS (SELECT r, doc_id, 25 + (75 * len(t) * n) // l AS m FROM docs, totals WHERE len(t) > 0),
scored AS (
  SELECT q, r, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (r)
  GROUP BY q, r),
ranked AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN sizes USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM ranked JOIN queries USING (q) WHERE rank <= {TOP}
"""
