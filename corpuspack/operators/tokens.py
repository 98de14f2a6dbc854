"""Token ids and counts against a vocabulary table.

A text is cut into pretokens, a pretoken that is not in the vocabulary into
chunks, and a chunk that is not in it into bytes; bytes the vocabulary lacks
vanish. The vocabulary is looked up in hash joins on the exploded units. It is
broadcast when its measured size allows, so the text itself is not shuffled, and
what leaves a task are per-text sums or id lists. Id arrays of texts whose keys occur
once are made within the row, so nothing is shuffled for them.

Inside, texts and tokens have one character per byte, so that tokens which are
not valid UTF-8 need no special care.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.functions.text import (
    PRETOKEN,
    as_bytes,
    as_bytes_text,
    fallback_chunks,
    pretokens,
    single_bytes,
)
from corpuspack.operators.joins import small_enough
from corpuspack.sources.staging import stage

BLOCK_UNITS = 65_536  # pretokens of a row of ids
# Pretokens that are one of so many or more are looked up by broadcast, if they are not longer.
HOT_UNITS = 500_000
HOT_LENGTH = 64

CACHED_UNITS = 200_000  # of a task, none longer than HOT_LENGTH

LookUp = Callable[[DataFrame], DataFrame]  # from (unit) to (unit, packed)


class Vocabulary:
    """Lookup tables of a vocabulary, broadcast if it is small enough."""

    def __init__(self, vocab: DataFrame) -> None:
        keyed = vocab.select(as_bytes_text(F.col("token")).alias("unit"), "id", "is_special")
        self.is_small = small_enough(keyed)
        self.keyed = keyed
        hint = F.broadcast if self.is_small else lambda table: table
        regular = keyed.filter(~F.col("is_special")).select("unit", "id")
        self.special = hint(keyed.filter("is_special").select("unit", "id"))
        # a special token hides a regular one with the same bytes
        self.whole = hint(keyed.groupBy("unit").agg(F.max_by("id", "is_special").alias("id")))
        self.chunks = hint(regular)
        # at most 256 rows
        single = regular.filter(F.length("unit") == 1).groupBy("unit").agg(F.max("id").alias("id"))
        self._byte_ids = {ord(row["unit"]): row["id"] for row in single.collect()}

    def byte_ids(self, chunk: Column) -> Column:
        """Ids of the bytes of a chunk, without those that have none."""
        known = F.array(*[F.lit(self._byte_ids.get(b)).cast("int") for b in range(256)])
        ids = F.transform(single_bytes(chunk), lambda b: F.get(known, F.ascii(b)))
        return F.filter(ids, lambda i: i.isNotNull())

    def packed_bytes(self) -> dict[bytes, bytes]:
        """The id of each byte in 4 bytes, none for those that have none."""
        known = {b: i.to_bytes(4, "big", signed=True) for b, i in self._byte_ids.items()}
        return {bytes([b]): known.get(b, b"") for b in range(256)}

    def known_bytes(self, chunk: Column) -> Column:
        """How many bytes of a chunk have an id."""
        unknown = "".join(chr(b) for b in range(1, 256) if b not in self._byte_ids)
        if 0 not in self._byte_ids:
            chunk = F.replace(chunk, F.char(F.lit(0)), F.lit(""))
        return F.length(F.translate(chunk, unknown, "") if unknown else chunk)


    def ids(self, found: str, chunk: str) -> Column:
        """The ids of a chunk: the one found for it, or those of its bytes."""
        return F.when(F.col(found).isNotNull(), F.array(found)).otherwise(self.byte_ids(F.col(chunk)))

    def packed(self, found: str, chunk: str) -> Column:
        """:meth:`ids`, 4 bytes each."""
        one = F.unhex(F.lpad(F.hex(F.col(found)), 8, "0"))
        return F.when(F.col(found).isNotNull(), one).otherwise(_packed(self.byte_ids(F.col(chunk))))

    def pack(self, chunks: DataFrame) -> DataFrame:
        """``(unit, packed)`` from ``(unit, chunk_pos, chunk, id)``."""
        return chunks.select("unit", "chunk_pos", self.packed("id", "chunk").alias("p")).groupBy("unit").agg(
            F.expr("listagg(p) WITHIN GROUP (ORDER BY chunk_pos)").alias("packed")
        )

    def packed_ids(self, chunks: DataFrame) -> DataFrame:
        """``(unit, packed)`` from ``(unit, chunk_pos, chunk)``, chunks that are cut already."""
        return self.pack(_look_up(chunks, F.col("chunk"), self.chunks, "id"))


def _look_up(units: DataFrame, unit: Column, table: DataFrame, name: str) -> DataFrame:
    ids = table.select(F.col("unit").alias(f"_{name}_unit"), F.col("id").alias(name))
    return units.join(ids, unit == F.col(f"_{name}_unit"), "left").drop(f"_{name}_unit")


def _units(
    texts: DataFrame, keys: Sequence[str], text: str, vocabulary: Vocabulary, whole_texts: bool = True
) -> DataFrame:
    """``(keys, pos, unit)``: the pretokens of every text in order.

    A text that is a special token as a whole is one unit; without ``whole_texts``, the
    texts are parts of others, and none is a special token.
    """
    whole = texts.select(*keys, as_bytes_text(F.col(text)).alias("_text"))
    if whole_texts:
        whole = _look_up(whole, F.col("_text"), vocabulary.special, "special_id")
    else:
        whole = whole.withColumn("special_id", F.lit(None))
    return whole.select(
        *keys,
        F.posexplode(
            F.when(F.col("special_id").isNotNull(), F.array("_text")).otherwise(
                pretokens(F.col("_text"))
            )
        ).alias("pos", "unit"),
    )


def _looked_up_chunks(units: DataFrame, keys: Sequence[str], vocabulary: Vocabulary) -> DataFrame:
    """``(keys, chunk_pos, chunk, id)`` of units; ``id`` is NULL if only bytes are left to try.

    A pretoken found as a whole is its own only chunk.
    """
    found = _look_up(units, F.col("unit"), vocabulary.whole, "whole_id")
    chunks = found.select(
        *keys,
        "whole_id",
        F.posexplode(
            F.when(F.col("whole_id").isNotNull(), F.array("unit")).otherwise(
                fallback_chunks(F.col("unit"))
            )
        ).alias("chunk_pos", "chunk"),
    )
    return _look_up(chunks, F.col("chunk"), vocabulary.chunks, "chunk_id").select(
        *keys, "chunk_pos", "chunk", F.coalesce("whole_id", "chunk_id").alias("id")
    )


def _packed(ids: Column) -> Column:
    """Ids as 4 bytes each."""
    digits = F.transform(ids, lambda i: F.lpad(F.hex(i), 8, "0"))
    return F.unhex(F.array_join(digits, ""))


def unpacked(packed: Column) -> Column:
    """The ids in 4 bytes each."""
    size = F.octet_length(packed)
    places = F.filter(F.sequence(F.lit(0), (size / 4).cast("int")), lambda i: 4 * i < size)
    return F.transform(
        places,
        lambda i: F.conv(F.hex(F.substr(packed, 4 * i + 1, F.lit(4))), 16, 10).cast("int"),
    )


def _dictionary(dictionary: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``dictionary`` of a ``unit`` each, in two: the frequent ones, to be broadcast, and the rest.

    Frequent are units that one row of ``HOT_UNITS`` or more has, so many of bounded length
    at most. ``counts`` is ``(unit, n)``.
    """
    least = (counts.agg(F.sum("n")).first()[0] or 0) / HOT_UNITS
    hot = counts.filter((F.length("unit") <= HOT_LENGTH) & (F.col("n") >= least)).select("unit")
    entries = stage(dictionary.join(hot.withColumn("hot", F.lit(True)), "unit", "left"), "dictionary")
    often = entries.filter("hot").select(*[F.col(c).alias(f"_{c}") for c in dictionary.columns])
    return F.broadcast(often), entries.filter("hot IS NULL").drop("hot")


def _dictionary_join(rows: DataFrame, dictionary: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with what ``dictionary`` has for their ``unit``.

    Frequent units are broadcast, so that their rows stay where they are. Others are joined
    by unit. ``counts`` is ``(unit, n)``.
    """
    often, rest = _dictionary(dictionary, counts)
    values = [c for c in dictionary.columns if c != "unit"]
    tried = rows.join(often, F.col("unit") == F.col("_unit"), "left")
    met = tried.filter("_unit IS NOT NULL").select(*rows.columns, *[F.col(f"_{v}").alias(v) for v in values])
    missed = tried.filter("_unit IS NULL").select(*rows.columns).join(rest, "unit")
    return met.unionByName(missed.select(*met.columns))


def _priced(units: DataFrame, keys: Sequence[str], prices: DataFrame, counts: DataFrame) -> DataFrame:
    """The sum of ``_price`` per key over its ``units``, which are gone through once.

    Frequent ones are added up where they are; the others of a key, each with how often it
    stands there, meet their prices by unit.
    """
    often, rest = _dictionary(prices.withColumnRenamed("_price", "price"), counts)
    tried = units.join(often, F.col("unit") == F.col("_unit"), "left")
    tried = tried.withColumn("unit", F.when(F.col("_unit").isNull(), F.col("unit")))
    sums = tried.groupBy(*keys, "unit").agg(F.sum("_price").alias("tokens"), F.count("*").alias("_times"))
    sums = stage(sums, "sums")
    parts = sums.join(rest, "unit", "left").select(
        *keys, F.coalesce("tokens", F.col("_times") * F.col("price")).alias("tokens")
    )
    return parts.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))


def _own_look_up(vocabulary: Vocabulary) -> LookUp:
    """From distinct pretokens to ``(unit, packed)`` by the vocabulary alone."""

    def look_up(units: DataFrame) -> DataFrame:
        found = _looked_up_chunks(units, ["unit"], vocabulary)
        return vocabulary.pack(found)

    return look_up


def _special_units(dictionary: DataFrame, vocabulary: Vocabulary, look_up: LookUp) -> DataFrame:
    """``(unit, packed)`` of distinct pretokens; one that is a special token is that."""
    found = _look_up(dictionary, F.col("unit"), vocabulary.special, "special_id")
    special = found.filter("special_id IS NOT NULL").select("unit", _packed(F.array("special_id")).alias("packed"))
    return special.unionByName(look_up(found.filter("special_id IS NULL").select("unit")))


def count_tokens_vocab(
    texts: DataFrame,
    keys: Sequence[str],
    text: str,
    vocabulary: Vocabulary,
    look_up: LookUp | None = None,
    whole_texts: bool = True,
) -> DataFrame:
    """Number of tokens per key; empty texts get no row.

    With a small vocabulary, pretokens are looked up where the texts are. Otherwise, or with
    a ``look_up`` of their own (see ``merges.dictionary_ids``), the distinct pretokens of all
    texts are priced once. Texts are cut again to meet the prices, of frequent ones where
    the texts are, so that only rare pretokens are shuffled.
    """
    if vocabulary.is_small and look_up is None:
        units = _units(texts, keys, text, vocabulary, whole_texts)
        chunks = _looked_up_chunks(units, keys, vocabulary)
        price = F.when(F.col("id").isNotNull(), 1).otherwise(vocabulary.known_bytes(F.col("chunk")))
        return chunks.groupBy(*keys).agg(F.sum(price.cast("bigint")).alias("tokens"))
    units = _units(texts, keys, text, vocabulary, whole_texts).select(*keys, "unit")
    counts = stage(units.groupBy("unit").agg(F.count("*").alias("n")), "units")
    packed = _special_units(counts.select("unit"), vocabulary, look_up or _own_look_up(vocabulary))
    prices = packed.select("unit", (F.octet_length("packed") / 4).cast("bigint").alias("_price"))
    return _priced(units, keys, prices, counts)


def encode_blocks(
    texts: DataFrame,
    keys: Sequence[str],
    text: str,
    vocabulary: Vocabulary,
    look_up: LookUp | None = None,
    block_units: int = BLOCK_UNITS,
) -> DataFrame:
    """``(keys, block, start, ids)``: the ids of every text, 4 bytes each, in bounded rows.

    A block has the ids of ``block_units`` pretokens, ``start`` is how many ids come before it.
    The ids of a long text are many rows, made by different tasks. Empty texts get none.
    """
    block = F.floor(F.col("pos") / block_units).alias("block")
    units = _units(texts, keys, text, vocabulary)
    if vocabulary.is_small and look_up is None:
        chunks = _looked_up_chunks(units, [*keys, "pos"], vocabulary)
        rows = chunks.select(*keys, block, "pos", "chunk_pos", vocabulary.packed("id", "chunk").alias("packed"))
    else:
        counts = stage(units.groupBy("unit").agg(F.count("*").alias("n")), "units")
        packed = stage(
            _special_units(counts.select("unit"), vocabulary, look_up or _own_look_up(vocabulary)), "packed"
        )
        joined = _dictionary_join(units, packed, counts)
        rows = joined.select(*keys, block, "pos", F.lit(0).alias("chunk_pos"), "packed")
    made = rows.groupBy(*keys, "block").agg(
        F.expr("listagg(packed) WITHIN GROUP (ORDER BY pos, chunk_pos)").alias("ids")
    )
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stage(made.filter(F.octet_length("ids") > 0), "id-blocks")
    sizes = blocks.select(*keys, "block", (F.octet_length("ids") / 4).cast("bigint").alias("_n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return blocks.join(starts, [*keys, "block"]).select(*keys, "block", "start", "ids")


class _Chunks(dict):
    """From a pretoken to the ids of each of its chunks; remembers those asked for."""

    def __init__(self, table: pa.Table) -> None:
        super().__init__()
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("token", "is_special", "id")]))
        self.chunks = {token: i for token, special, i in rows if not special}
        self.special = {token: i for token, special, i in rows if special}

    def __missing__(self, unit: bytes) -> list[tuple[int, ...]]:
        whole = self.special.get(unit, self.chunks.get(unit))
        if whole is not None:
            return self._kept(unit, [(whole,)])
        n = len(unit)
        if not unit.isascii() or n > 4 and unit[:1].isdigit():
            size = 1
        else:
            size = 4 if n <= 8 else 3 if n <= 16 else 2
        return self._kept(unit, [self._ids(unit[i : i + size]) for i in range(0, n, size)])

    def _ids(self, chunk: bytes) -> tuple[int, ...]:
        found = self.chunks.get(chunk)
        if found is not None:
            return (found,)
        single = (self.chunks.get(chunk[i : i + 1]) for i in range(len(chunk)))
        return tuple(i for i in single if i is not None)

    def _kept(self, unit: bytes, ids: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        if len(unit) <= HOT_LENGTH:
            if len(self) >= CACHED_UNITS:
                self.clear()
            self[unit] = ids
        return ids


def _array_encoder(spark, vocabulary: Vocabulary):
    """A column function: the texts (binary) of a key to its ids, by place where there are several."""
    token = as_bytes(F.col("unit")).alias("token")
    held = spark.sparkContext.broadcast(vocabulary.keyed.select(token, "id", "is_special").toArrow())

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, pretoken = _Chunks(held.value), re.compile(PRETOKEN.replace("|(?s).", r"|[\x00-\xff]").encode())
        for batch in batches:
            sizes, values = [0], []
            for texts in batch.to_pylist():
                units = [[t] if t in known.special else pretoken.findall(t) for t in texts]
                if len(units) == 1:
                    ids = chain.from_iterable(chain.from_iterable(map(known.__getitem__, units[0])))
                else:
                    placed = ((p, c, i) for u in units for p, w in enumerate(u) for c, i in enumerate(known[w]))
                    ids = chain.from_iterable(i for _, _, i in sorted(placed))
                values.append(np.fromiter(ids, np.int32))
                sizes.append(sizes[-1] + len(values[-1]))
            flat = np.concatenate([*values, np.zeros(0, np.int32)])
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))

    return run


def _same_keys(keys: Sequence[str]) -> Column:
    """A join condition with columns ``_k0``, ``_k1``, ...; null keys are equal."""
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return condition


def encode_ids(
    texts: DataFrame,
    keys: Sequence[str],
    text: str,
    vocabulary: Vocabulary,
    look_up: LookUp | None = None,
) -> DataFrame:
    """The ordered id array per key, which is bounded by its text.

    With a small vocabulary, the text of a key that occurs once is encoded where it is. Only
    the texts of other keys are brought together; their ids go by pretoken, chunk and id.
    For texts that are too long for one array, there is :func:`encode_blocks`.
    """
    if vocabulary.is_small and look_up is None:
        encode = _array_encoder(texts.sparkSession, vocabulary)
        given = texts.select(*keys, F.col(text).cast("binary").alias("_text"))
        given = given.filter(F.octet_length("_text") > 0)
        counts = given.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
        repeated = stage(counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), "repeated")
        same = _same_keys(keys)
        once = given.join(repeated, same, "left_anti").select(*keys, F.array("_text").alias("_texts"))
        more = given.join(repeated, same, "left_semi").groupBy(*keys).agg(F.collect_list("_text").alias("_texts"))
        return once.unionByName(more).select(*keys, encode(F.col("_texts")).alias("ids"))
    blocks = encode_blocks(texts, keys, text, vocabulary, look_up)
    whole = blocks.groupBy(*keys).agg(F.expr("listagg(ids) WITHIN GROUP (ORDER BY block)").alias("ids"))
    return whole.select(*keys, unpacked(F.col("ids")).alias("ids"))


def special_token_ids(
    texts: DataFrame, keys: Sequence[str], text: str, vocabulary: Vocabulary
) -> DataFrame:
    """Texts that are, as a whole, one special token, with its id."""
    hits = _look_up(
        texts.select(*keys, text), as_bytes_text(F.col(text)), vocabulary.special, "id"
    )
    return hits.filter(F.col("id").isNotNull()).select(*keys, "id")


def pretoken_counts(texts: DataFrame, text: str) -> DataFrame:
    """The distinct pretokens of a corpus and how often each occurs."""
    units = texts.select(F.explode(pretokens(as_bytes_text(F.col(text)))).alias("unit"))
    return (
        units.select(as_bytes(F.col("unit")).cast("string").alias("pretoken"))
        .groupBy("pretoken")
        .agg(F.count("*").alias("n"))
    )


def vocab_lookup(dictionary: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Id of each distinct pretoken, NULL where the vocabulary lacks it."""
    return _look_up(dictionary, as_bytes_text(F.col("pretoken")), vocabulary.whole, "id")


def chunks_of_unknown(dictionary: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Chunks (as bytes) of the distinct pretokens that are not in the vocabulary."""
    unit = as_bytes_text(F.col("pretoken"))
    return (
        vocab_lookup(dictionary, vocabulary)
        .filter(F.col("id").isNull())
        .select("pretoken", F.posexplode(fallback_chunks(unit)).alias("chunk_pos", "chunk"))
        .withColumn("chunk", as_bytes(F.col("chunk")))
    )


def price_pretokens(dictionary: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Tokens each distinct pretoken costs; 0 if all its bytes are unknown."""
    keyed = dictionary.select("pretoken", F.col("pretoken").alias("_text"))
    return count_tokens_vocab(keyed, ["pretoken"], "_text", vocabulary).withColumnRenamed(
        "tokens", "price"
    )


def token_histogram(texts: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """How often each id occurs in a corpus.

    Every distinct pretoken is encoded once and weighted by its count, so what is
    shuffled is the dictionary, not the text. Texts that are a special token as a
    whole are counted separately.
    """
    whole = _look_up(
        texts.select(text), as_bytes_text(F.col(text)), vocabulary.special, "id"
    )
    specials = (
        whole.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n"))
    )
    dictionary = pretoken_counts(whole.filter(F.col("id").isNull()), text)
    keyed = dictionary.select("n", F.col("pretoken").alias("_text"))
    units = _units(keyed, ["n"], "_text", vocabulary)
    found = _looked_up_chunks(units, ["n"], vocabulary)
    regular = found.select("n", F.explode(vocabulary.ids("id", "chunk")).alias("id"))
    return regular.unionByName(specials).groupBy("id").agg(F.sum("n").alias("n"))
