"""Placing rows on shards through a lookup table that permutations fill.

Every shard prefers the slots of a prime-sized table in an order of its own. The shards
take turns, each claiming the next slot in its order that is free, until all are taken.
So shards get equal shares to one slot, and few slots change when a shard comes or goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 6421  # a prime, about 100 slots for each shard
_HEX = 15


def _number(text: str) -> int:
    """The first hexadecimal digits of a text's MD5 as a number."""
    return int(hashlib.md5(text.encode()).hexdigest()[:_HEX], 16)


def preferences(name: str, slots: int) -> tuple[int, int]:
    """The offset and step of a shard's order of slots: ``(offset + j * step) % slots``."""
    return _number(f"offset/{name}") % slots, _number(f"step/{name}") % (slots - 1) + 1


def lookup_table(names: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot; ``slots`` must be a prime."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    if not 0 < len(set(names)) == len(names) <= slots:
        raise ValueError("shards need distinct names and a slot each")
    orders = [preferences(name, slots) for name in names]
    nexts = [0] * len(names)
    table = [-1] * slots
    left = slots
    while True:
        for shard, (offset, step) in enumerate(orders):
            while table[slot := (offset + nexts[shard] * step) % slots] >= 0:
                nexts[shard] += 1
            table[slot] = shard
            nexts[shard] += 1
            left -= 1
            if not left:
                return table


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """A lookup table as rows ``(slot, shard)``, of which there are a fixed number."""
    joined = ",".join(map(str, table))
    return spark.sql(
        "SELECT pos AS slot, CAST(col AS INT) AS shard FROM (SELECT posexplode(split(:t, ',')))",
        args={"t": joined},
    )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, by its MD5; null is a key like any other, of no text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(slots).cast("bigint")).cast("int")


def place(
    rows: DataFrame, names: Sequence[str], key: str = "doc_id", slots: int = SLOTS
) -> DataFrame:
    """All columns of ``rows``, with ``slot``, ``shard`` and ``shard_name`` from the key.

    Nothing is shuffled: the table has ``slots`` rows whatever the input and is
    broadcast. Columns of these names in ``rows`` are replaced. Equal keys go to one
    shard.
    """
    spark = rows.sparkSession
    own = [c for c in rows.columns if c not in ("slot", "shard", "shard_name")]
    held = table_frame(spark, lookup_table(names, slots)).select(
        F.col("slot").alias("_slot"),
        F.col("shard").alias("_shard"),
        F.element_at(F.array(*map(F.lit, names)), F.col("shard") + 1).alias("_name"),
    )
    placed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        slot_of(F.col(f"`{key}`"), slots).alias("_at"),
    ).join(F.broadcast(held), F.col("_at") == F.col("_slot"))
    return placed.select(
        *[F.col("_row").getField(c).alias(c) for c in own],
        F.col("_slot").alias("slot"),
        F.col("_shard").alias("shard"),
        F.col("_name").alias("shard_name"),
    )


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def write_shards(placed: DataFrame, path: str) -> None:
    """Write placed rows, a folder for each shard; replaces what is at ``path``.

    Every task writes the rows it has of a shard, so none is one task's work.
    """
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)


ORACLE = f"""
WITH RECURSIVE hashed(i, o, s) AS (
  SELECT i, md5('offset/shard-' || lpad(i::varchar, 5, '0')),
         md5('step/shard-' || lpad(i::varchar, 5, '0'))
  FROM range({SHARDS}) t(i)
),
orders AS (
  SELECT i, ('0x' || o[1:{_HEX}])::bigint % {SLOTS} AS o,
         ('0x' || s[1:{_HEX}])::bigint % ({SLOTS} - 1) + 1 AS s
  FROM hashed
),
ways AS (SELECT list(o ORDER BY i) AS os, list(s ORDER BY i) AS ss FROM orders),
filled(turn, taken, nexts, slot) AS (
  SELECT 0, repeat('0', {SLOTS})::bit, list_transform(range({SHARDS}), lambda x: 0::bigint), NULL::int
  UNION ALL
  SELECT turn + 1, set_bit(taken, ((o + step * s) % {SLOTS})::int, 1),
         list_transform(nexts, lambda n, k: CASE WHEN k = shard THEN step + 1 ELSE n END),
         ((o + step * s) % {SLOTS})::int
  FROM (
    SELECT *, begun + coalesce(soon, CASE WHEN soon IS NULL THEN list_position(list_transform(
             range({SLOTS}), lambda j: get_bit(taken, ((o + (begun + j) * s) % {SLOTS})::int)), 0)
           END) - 1 AS step
    FROM (
      SELECT *, list_position(list_transform(
               range(50), lambda j: get_bit(taken, ((o + (begun + j) * s) % {SLOTS})::int)), 0) AS soon
      FROM (
        SELECT turn, taken, nexts, turn % {SHARDS} + 1 AS shard, os[turn % {SHARDS} + 1] AS o,
               ss[turn % {SHARDS} + 1] AS s, nexts[turn % {SHARDS} + 1] AS begun
        FROM filled, ways WHERE turn < {SLOTS}
      )
    )
  )
),
lookup AS (SELECT slot, ((turn - 1) % {SHARDS})::int AS shard FROM filled WHERE turn > 0)
SELECT d.doc_id, l.slot, l.shard, 'shard-' || lpad(l.shard::varchar, 5, '0') AS shard_name
FROM documents d JOIN lookup l
  ON l.slot = ('0x' || md5(coalesce(d.doc_id::varchar, ''))[1:{_HEX}])::bigint % {SLOTS}
"""
