"""Exact top-k search by inner product over vectors bucketed by length.

Vectors are sorted by length and cut into buckets. What a query has found so far gives
each bucket a local threshold on the cosine: below it nothing can be among its best. By
that threshold a bucket is left out, searched in its longer vectors only, or pruned by
coordinates; products of what is left are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.llm.common import stage

SCALE = 1024
K = 10
BUCKET_ROWS = 1024
GROUP_BUCKETS = 16
QUERY_BLOCK = 2048
# From this cosine on, a bucket is pruned by coordinates.
COORDINATE_COSINE = 0.75
FOCUS = 4
_SLACK = 1e-9
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def valid(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantized(vector: Column) -> Column:
    """Components as floor(1024 x); beyond the range of a long, its ends."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def _rows(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    square = F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    return (
        vectors.filter(valid(v) & F.col(f"`{vec_id}`").isNotNull())
        .select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), quantized(v).alias("v"))
        .select("id", "v", F.size("v").alias("dim"), F.sqrt(square).alias("length"))
    )


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as buckets: a row for each, with ids and components as bytes."""
    held: list[tuple] = []
    number = 0

    def bucket() -> pa.RecordBatch:
        nonlocal number
        part, dim = held[0][4], held[0][2]
        row = {
            "part": [part],
            "number": [number],
            "dim": [dim],
            "n": [len(held)],
            "length": [held[0][3]],
            "ids": [np.array([h[0] for h in held], "<i8").tobytes()],
            "components": [np.array([h[1] for h in held], "<i8").tobytes()],
        }
        number += 1
        held.clear()
        return pa.RecordBatch.from_pydict(row, schema=_BUCKET)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and (len(held) == BUCKET_ROWS or held[0][2] != row[2]):
                yield bucket()
            held.append(row)
    if held:
        yield bucket()


_BUCKET = pa.schema(
    [
        ("part", pa.int64()),
        ("number", pa.int64()),
        ("dim", pa.int64()),
        ("n", pa.int64()),
        ("length", pa.float64()),
        ("ids", pa.binary()),
        ("components", pa.binary()),
    ]
)
_BUCKET_SCHEMA = (
    "part bigint, number bigint, dim bigint, n bigint, length double, ids binary, components binary"
)


def _buckets(rows: DataFrame) -> DataFrame:
    """Buckets, the longest vectors first, in groups of buckets of like lengths."""
    packed = stage(
        rows.repartitionByRange("dim", F.desc("length"), "id")
        .sortWithinPartitions("dim", F.desc("length"), "id")
        .select("id", "v", "dim", "length", F.spark_partition_id().cast("bigint").alias("part"))
        .mapInArrow(_packing, _BUCKET_SCHEMA),
        "topk-buckets",
    )
    n, parts = packed.agg(F.sum("n"), F.max("part") + 1).first()
    groups = max(1, -(-(n or 0) // (BUCKET_ROWS * GROUP_BUCKETS)))
    slot = F.floor(F.col("part") * groups / F.lit(parts or 1)).cast("bigint")
    group = slot * (1 << 24) + F.floor(F.col("number") / GROUP_BUCKETS).cast("bigint")
    return packed.withColumn("grp", group)


class Found:
    """The best of each query so far: scores, ids, and what a score must reach."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.lengths = np.sqrt((matrix.astype(float) ** 2).sum(1))
        self.floor = floor.astype(float)
        self.best: list[list[tuple]] = [[] for _ in ids]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        merged = self.best[query] + [(-int(s), int(i)) for s, i in zip(scores, ids)]
        merged.sort()
        self.best[query] = merged[: self.k]
        if len(self.best[query]) == self.k:
            self.floor[query] = max(self.floor[query], float(-self.best[query][-1][0]))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products: in floating point where all sums are exact, else in whole numbers."""
    top = max(map(lambda m: int(np.abs(m.astype(float)).max(initial=0)), (a, b)), default=0)
    if top * top * max(1, a.shape[1]) < _EXACT:
        return a.astype(float) @ b.astype(float).T
    return a.astype(object) @ b.astype(object).T


def search_bucket(found: Found, ids: np.ndarray, matrix: np.ndarray, length: float) -> None:
    """Add what a bucket has for each query; its rows are sorted by length, longest first."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(found.floor > 0, found.floor / (found.lengths * length), -np.inf)
        needed = np.where(found.floor > 0, found.floor / found.lengths, 0.0)
    cosine = np.where(np.isnan(cosine), -np.inf, cosine)
    open_ = cosine <= 1 + _SLACK
    narrow = open_ & (cosine >= COORDINATE_COSINE)
    lengths = np.sqrt((matrix.astype(float) ** 2).sum(1))
    broad = np.flatnonzero(open_ & ~narrow)
    for at in range(0, len(broad), 256):
        some = broad[at : at + 256]
        least = float(np.min(needed[some])) * (1 - _SLACK)
        rows = int(np.searchsorted(-lengths, -least, side="right"))
        if not rows:
            continue
        products = _products(found.matrix[some], matrix[:rows])
        for query, scores in zip(some, products):
            keep = np.flatnonzero((scores >= found.floor[query]) & (ids[:rows] != found.ids[query]))
            if len(keep) > 4 * found.k:  # nothing below the k-th of these matters
                kth = np.partition(scores[keep], len(keep) - found.k)[len(keep) - found.k]
                keep = keep[scores[keep] >= kth]
            found.add(query, scores[keep], ids[keep])
    if narrow.any():
        unit = matrix / np.where(lengths > 0, lengths, 1)[:, None]
        for query in np.flatnonzero(narrow):
            rows = _feasible(found.matrix[query] / found.lengths[query], unit, float(cosine[query]))
            rows = rows[ids[rows] != found.ids[query]]
            if len(rows):
                scores = _products(found.matrix[query : query + 1], matrix[rows])[0]
                keep = scores >= found.floor[query]
                found.add(query, scores[keep], ids[rows][keep])


def _feasible(query: np.ndarray, unit: np.ndarray, cosine: float) -> np.ndarray:
    """Rows that may reach a cosine with the query, by its largest coordinates.

    At cosine t, a coordinate of the other is within q t -+ sqrt((1 - t^2) (1 - q^2)).
    A shorter vector than the bucket's longest needs a larger cosine still. Where the
    largest cosine of all, 1, is nearer to the query's own coordinate, the range ends
    there.
    """
    t = min(1.0, cosine)
    rows = np.arange(len(unit))
    for i in np.argsort(-np.abs(query))[:FOCUS]:
        q = float(query[i])
        reach = np.sqrt(max(0.0, (1 - t * t) * (1 - q * q)))
        low = -1.0 if q < 0 and -q >= t else q * t - reach
        high = 1.0 if q > 0 and q >= t else q * t + reach
        x = unit[rows, i]
        rows = rows[(x >= low - _SLACK) & (x <= high + _SLACK)]
    return rows


_HITS = "query_id bigint, vec_id bigint, score bigint"


def _searching(k: int):
    def search(buckets: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(buckets) and len(queries):
            dim = int(queries["q_dim"].iloc[0])
            found = Found(
                queries["q_id"].to_numpy(np.int64),
                np.array([list(v) for v in queries["q_v"]], np.int64).reshape(len(queries), dim),
                queries["q_floor"].to_numpy(float),
                k,
            )
            for b in buckets.sort_values("length", ascending=False).itertuples(index=False):
                ids = np.frombuffer(b.ids, "<i8")
                matrix = np.frombuffer(b.components, "<i8").reshape(len(ids), dim)
                search_bucket(found, ids, matrix, b.length)
            for query, best in zip(found.ids.tolist(), found.best):
                rows += [(query, i, max(-_LONG - 1, min(_LONG, -s))) for s, i in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def _hits(buckets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best that each group of buckets has for the queries of its dimension.

    Every block of queries goes to every group of its dimension, both of bounded size.
    """
    blocks = queries.select("dim", "block").distinct()
    groups = buckets.select("dim", "grp").distinct()
    keys = ("dim", "grp", "block")
    left = buckets.join(blocks, "dim")
    right = queries.join(groups, "dim")
    right = right.toDF(*["q_" + c for c in right.columns])
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*["q_" + c for c in keys]))
        .applyInPandas(_searching(k), _HITS)
    )


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best vectors of each query.

    By integer inner product of quantized vectors, ties to the smaller id. Vectors that
    are null, hold a null, NaN or infinite component, or have a null id take no part;
    vectors are compared with queries of as many components only. All rows with the
    query's id are its own and left out. A repeated row counts as often as it occurs; of
    several queries with one id, the least vector is asked for. The longest group of
    vectors is searched first, for the thresholds of all others.
    """
    buckets = _buckets(_rows(vectors, vec_id, vector))
    asked = _rows(queries, vec_id, vector).groupBy("id").agg(
        F.min(F.struct("v", "dim")).alias("q")
    )
    asked = stage(asked.select("id", "q.v", F.col("q.dim").cast("bigint").alias("dim")), "topk-queries")
    blocks = -(-asked.count() // QUERY_BLOCK) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    leading = buckets.groupBy("dim").agg(F.min("grp").alias("lead"))
    marked = buckets.join(leading, "dim").withColumn("leads", F.col("grp") == F.col("lead")).drop("lead")
    none = F.lit(float("-inf"))
    first = stage(
        _hits(marked.filter("leads"), asked.withColumn("floor", none), k), "topk-first"
    )
    reached = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floors = asked.join(reached, F.col("id") == F.col("query_id"), "left").withColumn(
        "floor", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(none)
    )
    rest = _hits(marked.filter("NOT leads"), floors.select(*asked.columns, "floor"), k)
    return best(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
