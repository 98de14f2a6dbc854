"""Writing documents, parts and reconstructed files."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack import fixed
from corpuspack.operators.pieces import line_start_of


READ_BYTES = 8 * fixed.MEGABYTE


def _without_last_newline(text: Column) -> Column:
    """Cut off as a byte, as a regex would replace bytes that are not UTF-8."""
    shorter = F.substr(text.cast("binary"), F.lit(1), F.octet_length(text) - 1)
    return F.when(F.endswith(text, F.lit("\n")), shorter.cast("string")).otherwise(text)


def write_pack(placed: DataFrame, path: str, block_bytes: int = 64 * fixed.MEGABYTE) -> None:
    """Documents as text below ``repo=<name>/block=<number>``.

    All earlier output at ``path`` goes, so no block of an older, longer document
    stays behind.

    Offsets are known, so one shuffle brings the pieces of a block together, and
    the blocks of a large document are written by different tasks. Its files, in
    the order of their blocks, are the document.
    """
    start = line_start_of(placed)
    block = F.format_string("%09d", F.floor(F.col(start) / block_bytes))  # longer ones stay whole
    rows = placed.select("repo", block.alias("block"), F.col(start).alias("at"), "start", "text")
    rows = rows.repartition("repo", "block")
    if start != "start":  # the writer takes a row for a line
        parts = rows.groupBy("repo", "block", "at")
        rows = parts.agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY start)").alias("text"))
    (
        rows.withColumn("start", F.col("at"))
        .sortWithinPartitions("repo", "block", "start")
        # the writer ends every line itself
        .select("repo", "block", _without_last_newline(F.col("text")).alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("repo", "block")
        .text(path)
    )


def write_parts(parts: DataFrame, path: str) -> None:
    """Parts as a Parquet table, one folder per repository and part; replaces ``path``.

    The folders are named after copies: ``repo`` and ``part`` are columns of the files, as
    the type of what is only in a folder's name is guessed when it is read.
    """
    (
        parts.withColumns({"in_repo": F.col("repo"), "in_part": F.col("part")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("in_repo", "in_part")
        .parquet(path)
    )


def export_parts(parts: DataFrame, root: str) -> DataFrame:
    """Write parts as files ``<root>/<repo>/<file_name>``, the blocks of one after each other.

    ``root`` must be on a file system that all executors mount. Lazy: returns a manifest
    ``(repo, part, file_name, n_bytes, crc32)`` of what its action writes. A task holds a
    block at a time. A file appears whole or not at all, and a repeated task writes it
    again. Unsafe names are refused.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stream, size, check = None, None, 0, 0

        def done() -> pa.RecordBatch:
            stream.close()
            os.replace(stream.name, os.path.join(root, now[0], now[2]))
            row = dict(zip(("repo", "part", "file_name", "n_bytes", "crc32"), (*now, size, check)))
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for batch in batches:
            for i in range(batch.num_rows):
                repo, part, name, body = (batch.column(c)[i].as_py() for c in range(4))
                if (repo, part, name) != now:
                    if stream is not None:
                        yield done()
                    now, size, check = (repo, part, name), 0, 0
                    os.makedirs(os.path.join(root, repo), exist_ok=True)
                    stream = open(os.path.join(root, repo, f"{name}.{uuid.uuid4().hex}.part"), "wb")
                stream.write(body)
                size, check = size + len(body), zlib.crc32(body, check)
        if stream is not None:
            yield done()

    safe = safe_path(F.col("repo")) & safe_path(F.col("file_name"))
    flat = ~F.col("repo").contains("/") & ~F.col("file_name").contains("/")
    rows = parts.filter(safe & flat).repartition("repo", "part").sortWithinPartitions("repo", "part", "block")
    named = rows.select("repo", F.col("part").cast("bigint"), "file_name", "body")
    return named.mapInArrow(write, "repo string, part bigint, file_name string, n_bytes bigint, crc32 bigint")


_MANIFEST = pa.schema(
    [
        ("repo", pa.string()),
        ("part", pa.int64()),
        ("file_name", pa.string()),
        ("n_bytes", pa.int64()),
        ("crc32", pa.int64()),
    ]
)


def differing_parts(manifest: DataFrame, root: str) -> DataFrame:
    """Rows of a manifest whose file is missing or has another content, read back in pieces."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, row in enumerate(batch.to_pylist()) if _measured(root, row) != (row["n_bytes"], row["crc32"])]
            yield batch.take(pa.array(kept, pa.int64()))

    return manifest.mapInArrow(read, manifest.schema)


def _measured(root: str, row: dict) -> tuple[int, int] | None:
    """Size and checksum of a part's file as it is."""
    size = check = 0
    try:
        with open(os.path.join(root, row["repo"], row["file_name"]), "rb") as f:
            while data := f.read(READ_BYTES):
                size, check = size + len(data), zlib.crc32(data, check)
    except OSError:
        return None
    return size, check


def write_reconstructed(files: DataFrame, path: str) -> None:
    """Reconstructed files as a Parquet table."""
    files.write.mode("overwrite").parquet(path)


def safe_path(path):
    """Whether a relative path stays below the folder it is resolved in."""
    return ~(
        F.startswith(path, F.lit("/"))
        | F.array_contains(F.split(path, "/"), "..")
        | (path == "")
        | F.endswith(path, F.lit("/"))
    )


def export_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``(repo, path, content)`` as files ``<root>/<repo>/<path>``.

    ``root`` must be on a file system that all executors mount. Lazy: returns
    ``(repo, path, n_bytes)`` of what its action writes. A file appears whole or
    not at all, and a repeated task writes it again. Unsafe paths are refused.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for repo, path, content in zip(batch["repo"], batch["path"], batch["content"]):
                target = os.path.join(root, repo, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                partial = f"{target}.{uuid.uuid4().hex}.part"
                with open(partial, "wb") as f:
                    f.write(content)
                os.replace(partial, target)
                sizes.append(len(content))
            yield pd.DataFrame({"repo": batch["repo"], "path": batch["path"], "n_bytes": sizes})

    checked = files.select("repo", "path", F.col("content").cast("binary").alias("content")).filter(
        safe_path(F.col("path")) & safe_path(F.col("repo")) & ~F.col("repo").contains("/")
    )
    return checked.mapInPandas(write, "repo string, path string, n_bytes bigint")
