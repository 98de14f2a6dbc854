"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpuspack.sources.staging import fresh_path

# White space between words, in a regex class, as bytes, and as a string.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

SLICE = 1000  # rows

_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<binary>": pa.list_(pa.binary()),
    "array<bigint>": pa.list_(pa.int64()),
}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)) == 0


def is_held_out(doc_id: int | None, modulus: int) -> bool:
    """``held_out`` for one id."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == 0


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` needs."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of a row's id and whole text; null ids and null texts have their own."""
    number = F.coalesce(F.concat(F.lit("+"), doc_id.cast("string")), F.lit("-"))
    digest = F.coalesce(F.md5(text.cast("binary")), F.lit("-"))
    return F.unhex(F.md5(F.concat(number, F.lit("/"), digest).cast("binary")))


def release_memory() -> None:
    """Give what a task no longer needs back to the system, as its worker goes on living."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def with_columns_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns, in this order."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def tables(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slices(batches):
    """Rows in smaller batches, which bounds what a task computes on at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def map_texts(documents: DataFrame, text: str, keep: Sequence[str], fields: str, prepare) -> DataFrame:
    """Add columns computed from each row's whole text, slice by slice, in its own task.

    ``prepare()`` runs once in each task and gives a function from a list of texts
    (bytes or None) to one list or array for each of ``fields`` (a schema string). Only
    ``keep`` and the text are read; of these, ``keep`` is returned before ``fields``.
    """
    added = [f.strip().split(" ") for f in fields.split(",")]
    held = documents.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    passed = to_arrow_schema(held.schema)
    arrow = pa.schema([*passed, *[pa.field(n, _ARROW[t]) for n, t in added]])

    def run(batches):
        compute = prepare()
        for batch in _slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            columns = compute(texts) if texts else [[] for _ in added]
            yield pa.RecordBatch.from_arrays(
                [
                    *[c.cast(f.type) for c, f in zip(batch.columns, passed)],
                    *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(passed) :])],
                ],
                schema=arrow,
            )
        del compute
        release_memory()

    schema = ", ".join([*(f"k{i} {t}" for i, (_, t) in enumerate(held.dtypes)), fields])
    rows = documents.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(f"`{text}`").cast("binary").alias("t"),
    ).mapInArrow(run, schema)
    return rows.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[n for n, _ in added]
    )
