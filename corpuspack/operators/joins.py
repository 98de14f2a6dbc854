"""Choosing how to join with lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.sources.staging import stage

# Of a table with a row for each key, so much is broadcast. Beyond it, so many rows are,
# none longer than that, and of the keys that the other side has most rows of.
KEYED_BYTES = 10 * 1024 * 1024
HOT_KEYS = 1000
HOT_BYTES = 64 * 1024

BROADCAST_BYTES = 256 * 1024 * 1024
ROW_OVERHEAD = 64


def small_enough(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of a table allows to broadcast it.

    Adds up the bytes of its string and binary columns and an allowance per row.
    """
    width = F.lit(ROW_OVERHEAD)
    for field in table.schema.fields:
        if field.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    size = table.agg(F.sum(width.cast("bigint"))).first()[0]
    return (size or 0) <= max_bytes


def join_by_key(rows: DataFrame, table: DataFrame, key: str, max_bytes: int | None = None) -> DataFrame:
    """Left join of many rows with a ``table`` of one row for each key.

    A small table is broadcast. Of a larger one, only the rows of keys that very many rows
    have are, so that these stay where they are; all others meet by key, and no key has
    very many of them.
    """
    if small_enough(table, KEYED_BYTES if max_bytes is None else max_bytes):
        return rows.join(F.broadcast(table), key, "left")
    width = sum((F.octet_length(c) for c, t in table.dtypes if t in ("string", "binary")), F.lit(0))
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(HOT_KEYS)
    marked = table.join(often.select(key, F.lit(True).alias("_often")), key, "left")
    hot = F.coalesce("_often", F.lit(False)) & (width <= HOT_BYTES)
    marked = stage(marked.withColumn("_hot", hot).drop("_often"), "by-key")
    values = [c for c in table.columns if c != key]
    known = marked.filter("_hot").select(
        F.col(key).alias("_key"), *[F.col(v).alias(f"_{v}") for v in values]
    )
    tried = rows.join(F.broadcast(known), rows[key] == F.col("_key"), "left")
    met = tried.filter("_key IS NOT NULL").select(
        *rows.columns, *[F.col(f"_{v}").alias(v) for v in values]
    )
    rest = tried.filter("_key IS NULL").select(*rows.columns)
    missed = rest.join(marked.filter("NOT _hot").drop("_hot"), key, "left")
    return met.unionByName(missed.select(*met.columns))
