"""Rank-greedy pair merging, for vocabularies that come with a merge table.

Only distinct pretokens are merged, and the merge table is joined, never collected. The
shortest go in rounds: each joins the pairs of neighbours with the table, takes the least
rank of every pretoken, and merges that pair wherever it stands. A round writes and reads
all that is still open, so for others, nearly all of a dictionary, one join of their
substrings with what merges make gives all merges that can take part, and a heap over a
linked list applies them within the row.

Inside, a pretoken is text of one character per byte, and its parts are hex digits in angle
brackets: ``<61><6263>``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.functions.text import single_bytes
from corpuspack.operators.tokens import Vocabulary
from corpuspack.sources.staging import stage

SHORT = 4  # bytes; a pretoken of so many has fewer rounds than that


def _digits(text: Column) -> Column:
    return F.hex(F.encode(text, "ISO-8859-1"))


def _parts(state: Column) -> Column:
    return F.split(F.regexp_replace(state, "^<|>$", ""), "><")


def _keyed(merges: DataFrame) -> DataFrame:
    """The merge table in hex; of equal pairs, the least rank."""
    keyed = merges.groupBy(F.hex("first").alias("first"), F.hex("second").alias("second"))
    return stage(keyed.agg(F.min("rank").alias("rank")), "merges")


def _in_rounds(units: DataFrame, table: DataFrame) -> DataFrame:
    """``(unit, state)`` of short pretokens, each round staged."""
    start = F.concat_ws("", F.transform(single_bytes(F.col("unit")), lambda b: F.concat(F.lit("<"), _digits(b), F.lit(">"))))
    open_, done = stage(units.select("unit", start.alias("state")), "merging"), []
    while not open_.isEmpty():
        parts = open_.select("unit", "state", _parts(F.col("state")).alias("p"))
        neighbours = F.arrays_zip(
            F.slice("p", F.lit(1), F.size("p") - 1).alias("first"), F.slice("p", F.lit(2), F.size("p")).alias("second")
        )
        pairs = parts.select("unit", "state", F.posexplode(neighbours).alias("at", "pair"))
        best = (
            pairs.select("unit", "state", "at", "pair.*")
            .join(table, ["first", "second"])
            .groupBy("unit", "state")
            .agg(F.min(F.struct("rank", "at", "first", "second")).alias("b"))
        )
        apart = F.concat(F.lit("<"), F.col("b.first"), F.lit("><"), F.col("b.second"), F.lit(">"))
        joined = F.concat(F.lit("<"), F.col("b.first"), F.col("b.second"), F.lit(">"))
        merged = stage(
            open_.join(best, ["unit", "state"], "left").select(
                "unit",
                # from the left, each part in one pair only
                F.when(F.col("b").isNull(), F.col("state")).otherwise(F.replace("state", apart, joined)).alias("state"),
                F.col("b").isNotNull().alias("more"),
            ),
            "merging",
        )
        done.append(merged.filter("NOT more").drop("more"))
        open_ = merged.filter("more").drop("more")
    found = units.select("unit", F.lit("").alias("state")).limit(0)
    for part in done:
        found = found.unionByName(part)
    return found


def merge_with_heap(token: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The parts of a pretoken: the pair of least rank, the first one of it, merged everywhere.

    A list of neighbours and a heap of pairs, so nothing is looked at again that did not change.
    """
    parts: list[bytes | None] = [token[i : i + 1] for i in range(len(token))]
    after = [*range(1, len(parts)), -1] if parts else []
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int]] = []

    def rank_at(i: int) -> int | None:
        if parts[i] is None or after[i] < 0:
            return None
        return ranks.get((parts[i], parts[after[i]]))

    def push(i: int) -> None:
        if (rank := rank_at(i)) is not None:
            heapq.heappush(heap, (rank, i))

    for i in range(len(parts)):
        push(i)
    while heap:
        rank, i = heapq.heappop(heap)
        if rank_at(i) != rank:
            continue  # changed meanwhile
        pair, merged, others = (parts[i], parts[after[i]]), [], []
        while True:
            if rank_at(i) == rank:
                if (parts[i], parts[after[i]]) == pair:
                    j = after[i]
                    parts[i], parts[j], after[i] = b"".join(pair), None, after[j]
                    if after[j] >= 0:
                        before[after[j]] = i
                    merged.append(i)
                else:
                    others.append(i)
            if not heap or heap[0][0] != rank:
                break
            i = heapq.heappop(heap)[1]
        for i in merged:
            push(i)
            if before[i] >= 0:
                push(before[i])
        for i in others:
            push(i)
    return [p for p in parts if p is not None]


def _text(digits: Column) -> Column:
    return F.decode(F.unhex(digits), "ISO-8859-1")


def _made(table: DataFrame) -> DataFrame:
    """The merge table as text, with what each merge makes."""
    first, second = _text(F.col("first")), _text(F.col("second"))
    made = table.select(first.alias("first"), second.alias("second"), "rank", F.concat(first, second).alias("made"))
    return stage(made.withColumn("n", F.length("made")), "made")


def _able(units: DataFrame, made: DataFrame) -> DataFrame:
    """``(unit, merges)``: pretokens with the rows of ``made`` that are within them, NULL for none."""
    sizes = made.select("n").distinct()  # no more than there are lengths of tokens
    places = units.join(F.broadcast(sizes.agg(F.array_sort(F.collect_set("n")).alias("sizes")))).select(
        "unit", F.explode("sizes").alias("n")
    )
    substrings = places.filter(F.length("unit") >= F.col("n")).select(
        "unit",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.length("unit") - F.col("n") + 1),
                    lambda i: F.substr("unit", i, F.col("n")),
                )
            )
        ).alias("made"),
    )
    fields = [c for c in made.columns if c != "n"]
    able = substrings.join(made, "made").groupBy("unit").agg(F.collect_list(F.struct(*fields)).alias("merges"))
    return units.join(able, "unit", "left").select("unit", "merges")


def _merged(unit: pa.Array, merges: pa.Array) -> Iterator[list[bytes]]:
    """The parts of each pretoken."""
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(merges), 0)).to_pylist()
    rows = merges.flatten()
    firsts, seconds, order = (rows.field(f).to_pylist() for f in ("first", "second", "rank"))
    octets = {t: t.encode("latin-1") for t in {*firsts, *seconds}}
    for u, a, b in zip(unit.to_pylist(), [0, *ends], ends):
        token = u.encode("latin-1")
        ranks = {(octets[firsts[k]], octets[seconds[k]]): order[k] for k in range(a, b)}
        parts = merge_with_heap(token, ranks) if ranks else [token[k : k + 1] for k in range(len(token))]
        yield parts


def _with_heap(units: DataFrame, table: DataFrame) -> DataFrame:
    """``(unit, chunks)`` of pretokens, each merged within its row."""

    @F.arrow_udf("array<string>")
    def chunks(unit: pa.Array, merges: pa.Array) -> pa.Array:
        found = [[p.decode("latin-1") for p in parts] for parts in _merged(unit, merges)]
        return pa.array(found, pa.list_(pa.string()))

    return _able(units, _made(table)).select("unit", chunks("unit", "merges").alias("chunks"))


def _ids_with_heap(units: DataFrame, table: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(unit, packed)`` of pretokens, each merged within its row.

    A part is a byte or what a merge makes, so the ids of these are looked up first, and
    come to the pretokens with the merges.
    """
    made = _made(table)
    parts = made.select(F.col("made").alias("unit"), F.lit(0).alias("chunk_pos"), F.col("made").alias("chunk"))
    ids = vocabulary.packed_ids(parts.distinct()).withColumnRenamed("unit", "made")
    made, single = stage(made.join(ids, "made"), "made-ids"), vocabulary.packed_bytes()

    @F.arrow_udf("binary")
    def packed(unit: pa.Array, merges: pa.Array) -> pa.Array:
        rows = merges.flatten()
        names, values = rows.field("made").to_pylist(), rows.field("packed").to_pylist()
        known = {t.encode("latin-1"): v for t, v in zip(names, values)} | single
        return pa.array([b"".join([known[p] for p in parts]) for parts in _merged(unit, merges)], pa.binary())

    return _able(units, made).select("unit", packed("unit", "merges").alias("packed"))


def merged_units(units: DataFrame, merges: DataFrame, short: int = SHORT) -> DataFrame:
    """``(unit, chunks)`` of distinct pretokens ``unit``, both of one character per byte.

    ``merges`` is ``(first, second, rank)``; of pairs of equal rank, the first one goes first.
    """
    table = _keyed(merges)
    is_short = F.length("unit") <= short
    return _short_units(units.filter(is_short), table).unionByName(_with_heap(units.filter(~is_short), table))


def _short_units(units: DataFrame, table: DataFrame) -> DataFrame:
    chunks = F.transform(_parts(F.col("state")), _text)
    return _in_rounds(units, table).select("unit", chunks.alias("chunks"))


def dictionary_ids(merges: DataFrame, vocabulary: Vocabulary, short: int = SHORT):
    """A function from distinct pretokens ``unit`` to ``(unit, packed)``, their ids by the merge table."""

    def look_up(units: DataFrame) -> DataFrame:
        table = _keyed(merges)
        is_short = F.length("unit") <= short
        chunks = _short_units(units.filter(is_short), table)
        chunks = chunks.select("unit", F.posexplode("chunks").alias("chunk_pos", "chunk"))
        return vocabulary.packed_ids(chunks).unionByName(_ids_with_heap(units.filter(~is_short), table, vocabulary))

    return look_up
