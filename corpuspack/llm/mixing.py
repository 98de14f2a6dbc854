"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's documents lie in shards, and a shard's words, in a seeded order of documents,
in blocks of equal length. Blocks are apportioned to sources by highest quotients, the
blocks of a source to its shards in the same way, and a shard takes its quota of blocks
in an order that the seed fixes: all of them as often as they are all needed, and some
once more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.llm.common import WORD, stage

WEIGHTS = (1.0, 2.0, 3.0)
MOST_TIMES = 3
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 20
SEED = 2024


def apportion(targets: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients ``target / (2 k + 1)``, at most ``most`` of each.

    Equal quotients: the party that comes first. A bisection finds a divisor that gives
    no more than the seats; the rest go one by one to the highest quotients.
    """
    targets = np.asarray(targets, float)
    seats = min(int(seats), int(most.sum()))

    def given(divisor: float) -> np.ndarray:
        if divisor <= 0:
            return most.copy()
        return np.minimum(np.floor(targets / divisor + 0.5 - 1e-12).astype(np.int64), most)

    high = 2 * float(targets.max(initial=0)) * 2 + 1
    low = 0.0
    for _ in range(200):
        middle = (low + high) / 2
        if given(middle).sum() > seats:
            low = middle
        else:
            high = middle
    quota = given(high)
    for _ in range(seats - int(quota.sum())):
        quotients = np.where(quota < most, targets / (2 * quota + 1), -1.0)
        quota[int(np.argmax(quotients))] += 1
    return quota


def capped_shares(weights: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """Shares of a total by weight, none above its most; the excess goes to the others."""
    shares = np.zeros(len(weights))
    free = np.ones(len(weights), bool)
    while free.any():
        left = total - shares[~free].sum()
        offered = weights * (left / weights[free].sum())
        over = free & (offered > most)
        if not over.any():
            shares[free] = offered[free]
            break
        shares[over] = most[over]
        free &= ~over
    return shares


def words(text: Column) -> Column:
    """The number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _targets(weights: Sequence[float]):
    def add(group: pd.DataFrame) -> pd.DataFrame:
        # strings compare by code point in Python; null comes last
        rows = sorted(group.itertuples(index=False), key=lambda r: (r.source is None, r.source or ""))
        sizes = np.array([r.source_size for r in rows], float)
        own = np.array([weights[i % len(weights)] for i in range(len(rows))])
        target = capped_shares(own, MOST_TIMES * sizes, sizes.sum())
        blocks = -(-sizes.astype(np.int64) // BLOCK_WORDS)
        quota = apportion(target, round(target.sum() / BLOCK_WORDS), MOST_TIMES * blocks)
        return pd.DataFrame(
            {
                "source": [r.source for r in rows],
                "target": target,
                "quota": quota,
            }
        )

    return add


def _shard_quotas(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("shard")
    sizes = group["shard_size"].to_numpy(np.int64)
    blocks = -(-sizes // BLOCK_WORDS)
    quota = apportion(sizes, int(group["quota"].iloc[0]), MOST_TIMES * blocks)
    return pd.DataFrame(
        {
            "_source": group["source"],
            "_shard": group["shard"],
            "shard_blocks": np.maximum(blocks, 1),
            "shard_quota": quota,
        }
    )


def _order(*columns: str) -> Column:
    return F.xxhash64(F.lit(SEED), *columns)


def _plan(sizes: DataFrame, weights: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Targets and numbers of shards of sources, and the quotas of their shards."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = (
        sources.groupBy(F.lit(1).alias("_all"))
        .applyInPandas(_targets(tuple(weights)), "source string, target double, quota bigint")
        .withColumnRenamed("source", "_source")
    )
    plan = stage(
        sources.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
            "_source",
            "source_size",
            "target",
            "quota",
            F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))
            .cast("bigint")
            .alias("shards"),
        ),
        "mix-sources",
    )
    quotas = (
        _dealt(sizes, plan)
        .groupBy("source", "shard", "quota")
        .agg(F.sum("size").alias("shard_size"))
        .withColumn("_group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
        .groupBy("_group")
        .applyInPandas(
            _shard_quotas,
            "_source string, _shard bigint, shard_blocks bigint, shard_quota bigint",
        )
        # where the blocks begin that are taken once more
        .withColumn(
            "spread", F.pmod(_order("_source", "_shard"), F.greatest(F.lit(1), "shard_blocks"))
        )
    )
    return plan, stage(quotas, "mix-shards")


def _dealt(rows: DataFrame, plan: DataFrame) -> DataFrame:
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("shard", F.pmod(_order("doc_id", "size"), F.col("shards")))


def _placed(rows: DataFrame, sizes: DataFrame, weights: Sequence[float], *ties: str) -> DataFrame:
    """Rows with their places in shards, and the quotas of these."""
    plan, quotas = _plan(sizes, weights)
    before = (
        Window.partitionBy("source", "shard")
        .orderBy(_order("doc_id"), "doc_id", "size", *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        _dealt(rows, plan)
        .withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(
            quotas,
            F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")),
        )
        .drop("_source", "_shard", "quota", "shards")
    )


def _sizes(documents: DataFrame) -> DataFrame:
    return stage(
        documents.select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes"
    )


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """What a mix takes of each document: a row for every row of ``documents``.

    ``doc_id, source, size, source_size, target, taken``, and where its words lie:
    ``shard``, ``first`` (words of the shard before them), ``shard_blocks``,
    ``shard_quota`` and ``spread``. The sizes and targets of sources, and of their shards,
    are tables of a row each; a window holds one shard, whose size is bounded however
    large a source is. Null texts have no words, and nothing is taken of them; null is a
    source of its own. Equal rows are documents of their own, side by side in their shard.
    """
    sizes = _sizes(documents)
    placed = _placed(sizes, sizes, weights)
    places = ("shard", "first", "shard_blocks", "shard_quota", "spread")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", taken().alias("taken"), *places
    )


def mixed_documents(documents: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The mix itself: ``documents`` with the texts that ``mix`` takes of them.

    A document taken more than once becomes a row for each time; one of which only some
    blocks are taken, or taken once more, a row with their words, runs of neighbouring
    blocks as they stand, with a line end between runs. One that is not taken is gone.
    ``n_chars``, where there is one, is that of the text. Texts move once, to their shards.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(
        "doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), row
    )
    placed = _placed(rows, _sizes(documents), weights, "tie").filter("size > 0")
    cut = placed.select(
        "row",
        F.col("row.text").cast("binary").alias("text"),
        *[F.col(c).cast("bigint") for c in ("first", "size", "shard_blocks", "shard_quota", "spread")],
    )
    kind = cut.schema["row"].dataType.simpleString()
    out = cut.mapInArrow(_cutting, f"row {kind}, text string")
    columns = [
        F.col("text")
        if c == "text"
        else F.length("text").cast(t).alias(c)
        if c == "n_chars"
        else F.col("row").getField(c).alias(c)
        for c, t in documents.dtypes
    ]
    return out.select(*columns)


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row as often as its most often taken block, with the text taken each time."""
    for batch in batches:
        rows, texts = [], []
        numbers = [batch.column(i).to_pylist() for i in range(2, 7)]
        for i, (text, *place) in enumerate(zip(batch.column(1), *numbers)):
            for taken_text in _copies(text.as_py(), *place):
                rows.append(i)
                texts.append(taken_text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())],
            names=["row", "text"],
        )


def _copies(
    text: bytes, first: int, size: int, blocks: int, quota: int, spread: int
) -> Iterator[str]:
    """The text as it is taken the first time, the second time, and so on."""
    numbers = np.arange(first // BLOCK_WORDS, (first + size - 1) // BLOCK_WORDS + 1)
    every, rest = divmod(quota, blocks)
    at = (numbers + spread) % blocks
    times = every + (at + 1) * rest // blocks - at * rest // blocks
    spans = None
    for time in range(1, int(times.max()) + 1):
        held = times >= time
        if held.all():
            yield text.decode("utf-8", "replace")
            continue
        if spans is None:
            spans = [m.span() for m in re.finditer(WORD.encode(), text)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], held.astype(np.int8), [0]])))
        runs = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            begin = max(0, int(numbers[a]) * BLOCK_WORDS - first)
            end = min(size, int(numbers[b - 1] + 1) * BLOCK_WORDS - first)
            runs.append(text[spans[begin][0] : spans[end - 1][1]])
        yield b"\n".join(runs).decode("utf-8", "replace")


def _times(block: Column) -> Column:
    """How often a shard takes one of its blocks.

    Each as often as all can be. The rest of the quota, r of n blocks, is spread evenly
    from a seeded beginning: ``floor((b + 1) r / n) - floor(b r / n)`` is 1 for r of them.
    """
    blocks, quota = F.col("shard_blocks"), F.col("shard_quota")
    every = F.floor(quota / blocks)
    rest = quota - every * blocks
    at = F.pmod(block + F.col("spread"), blocks)
    more = F.floor((at + 1) * rest / blocks) - F.floor(at * rest / blocks)
    return (every + more).cast("bigint")


def taken() -> Column:
    """The words a mix takes of a document that lies at ``first`` in its shard."""
    first, end = F.col("first"), F.col("first") + F.col("size")
    each = F.transform(
        F.sequence(F.floor(first / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS)),
        lambda b: _times(b)
        * (F.least(end, (b + 1) * BLOCK_WORDS) - F.greatest(first, b * BLOCK_WORDS)).cast("bigint"),
    )
    total = F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(F.col("size") > 0, total).otherwise(F.lit(0)).cast("bigint")
