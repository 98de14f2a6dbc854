"""Near-duplicates by SimHash fingerprints, found by multi-index hashing.

A fingerprint has two segments of 32 bits. If two differ in at most three bits, they
differ in at most one within some segment. So the table of each segment is asked for
all segments at distance 0 or 1, and what it has is compared in full.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.llm.common import free_name, map_texts, row_key, stage
from corpuspack.llm.components import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
_SEGMENT_BITS = 32
_POWERS = 1 << np.arange(64, dtype=np.uint64)


def shingle_hashes(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """The hash of every run of ``width`` words, or of all words if these are fewer."""
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    else:
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *[e + 1 for e in ends]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]
    return np.array(hashes, np.uint64)


def majority(rows: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(rows), 1 << 16):
        part = rows[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_POWERS[2 * ones > len(rows)].sum(dtype=np.uint64))


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text; zero without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space
    return majority(shingle_hashes(words, width))


def fingerprints(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the fingerprint ``fp`` as a bigint of the same bits."""

    def prepare():
        def compute(texts):
            found = np.array([fingerprint(t) for t in texts], np.uint64)
            return [found.view(np.int64)]

        return compute

    return map_texts(documents, "text", keep, "fp bigint", prepare)


def segments(prints: DataFrame) -> DataFrame:
    low = F.col("fp").bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned("fp", _SEGMENT_BITS)
    both = F.array(
        F.struct(F.lit(0).alias("side"), low.alias("part"), high.alias("rest")),
        F.struct(F.lit(1).alias("side"), high.alias("part"), low.alias("rest")),
    )
    return prints.select("*", F.explode(both).alias("s")).select(*prints.columns, "s.*")


def apart(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _chains(prints: DataFrame) -> DataFrame:
    """Some links, one for each fingerprint and segment at most.

    Each with the one before it among those that share a segment.
    """
    near = Window.partitionBy("side", "part").orderBy("rest")
    pairs = segments(prints).withColumn("b", F.lag("fp").over(near))
    return pairs.filter(apart("fp", "b") <= MOST_BITS).select(F.col("fp").alias("a"), "b")


def links(prints: DataFrame) -> DataFrame:
    """Pairs of groups ``(a, b)`` between which some fingerprints differ in 3 bits or less.

    ``prints`` holds distinct fingerprints ``fp`` and the ``group`` of each, so that of
    the very many pairs within a group none is made. Of two segments at distance 1, the
    one whose bit is 0 asks for the other, so each pair is found from one side.

    Both sides are shuffled: by Spark's estimate, which leaves out how many rows an array
    becomes, what asks would be broadcast while it is some hundred times as large.
    """
    table = segments(prints).select(
        "side", "part", F.col("fp").alias("b"), F.col("group").alias("group_b")
    )
    # the bit to set, or 0: as it is
    bits = F.array(*[F.lit(b).cast("bigint") for b in (0, *(1 << i for i in range(_SEGMENT_BITS)))])
    unset = F.col("part").bitwiseAND(F.col("bit")) == 0
    asked = (
        segments(prints)
        .select("side", "part", F.col("fp").alias("a"), F.col("group").alias("group_a"), F.explode(bits).alias("bit"))
        .filter(unset)
        .select(
            "side",
            F.col("part").bitwiseOR(F.col("bit")).alias("part"),
            "a",
            "group_a",
            (F.col("bit") == 0).alias("same"),
        )
    )
    met = asked.hint("merge").join(
        table,
        (asked["side"] == table["side"])
        & (asked["part"] == table["part"])
        & (F.col("group_a") != F.col("group_b"))
        & (~F.col("same") | (F.col("a") < F.col("b")))
        & (apart("a", "b") <= MOST_BITS),
    )
    return met.select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))


def grouped_by(prints: DataFrame, roots: DataFrame) -> DataFrame:
    joined = prints.join(roots.withColumnRenamed("a", "group"), "group", "left")
    return joined.select(*[c for c in prints.columns if c != "group"], F.coalesce("root", "group").alias("group"))


def _groups(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` and the ``group`` each is linked into, staged.

    First some links in each segment's groups, then all links between the groups these make.
    """
    alone = prints.withColumn("group", F.col("fp"))
    grouped = stage(grouped_by(alone, components(_chains(alone))), "simhash-groups")
    return stage(grouped_by(grouped, components(links(grouped))), "simhash-components")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``documents``.

    Fingerprints at 3 differing bits or fewer are linked; ``component_id`` is the least
    id that can be reached. Copies share one fingerprint, so only distinct fingerprints
    are compared. Texts without words (null ones too) have fingerprint zero. Null
    ids are never the least; a component of null ids has a null one. Repeated rows come
    out as often as they go in. Other columns are not read.
    """
    marked = stage(fingerprints(documents), "simhash-fingerprints")
    prints = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    ids = _groups(prints)
    least = ids.groupBy("group").agg(F.min("first").alias("component_id"))
    by_print = ids.join(least, "group").select("fp", "component_id")
    return marked.join(by_print, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def representatives(documents: DataFrame) -> DataFrame:
    """Exactly one row of each component, with all its columns.

    The row of the least id, null ids last, then of the least hash of its text. Rows are
    told apart by id and whole text, so neither null ids nor repeated ones stand for each
    other; of rows that share both, one is returned. Null texts are without words. An
    empty table gives an empty one, and columns may have any names.
    """
    key = free_name(documents, "row_key")
    keyed = documents.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    marked = fingerprints(keyed, ("doc_id", key)).withColumnRenamed(key, "key")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    prints = stage(marked.groupBy("fp").agg(order.alias("first")), "simhash-distinct")
    chosen = stage(
        _groups(prints).groupBy("group").agg(F.min("first")["key"].alias(key)).select(key),
        "simhash-chosen",
    )
    return keyed.join(chosen, key, "left_semi").dropDuplicates([key]).drop(key)
