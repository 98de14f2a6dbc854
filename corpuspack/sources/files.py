"""Directory trees on a file system that all executors mount."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack import fixed
from corpuspack.operators.chunks import (
    CHUNK_BYTES,
    CHUNK_SCHEMA,
    CHUNKS,
    cut_stream,
    join_contents,
)
from corpuspack.operators.entries import filter_vcs
from corpuspack.operators.ignore import prune
from corpuspack.sources.staging import stage

LISTED_ROWS = 5000  # that a task holds of a directory
_LISTING = "repo string, root string, path string, is_dir boolean, size bigint"


def _list_directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The direct children of every directory, some thousand at a time; what cannot be read is skipped.

    So is a link to a directory that the path already goes through, which has no end.
    """
    rows: list[tuple] = []

    def taken() -> pd.DataFrame:
        batch = pd.DataFrame(rows, columns=["repo", "root", "path", "is_dir", "size"])
        rows.clear()
        return batch

    for batch in batches:
        for repo, root, path in zip(batch["repo"], batch["root"], batch["path"]):
            above = None
            for child in _children(os.path.join(root, path)):
                try:
                    info = child.stat()  # follows links
                    if child.is_symlink() and child.is_dir():
                        above = above if above is not None else _places(root, path)
                        if (info.st_dev, info.st_ino) in above:
                            continue
                except OSError:
                    continue
                rel = f"{path}/{child.name}" if path else child.name
                rows.append((repo, root, rel, child.is_dir(), info.st_size))
                if len(rows) >= LISTED_ROWS:
                    yield taken()
    yield taken()


def _children(folder: str) -> Iterator[os.DirEntry]:
    """The entries of a folder as they are read; none, or no more, where that fails."""
    try:
        with os.scandir(folder) as found:
            yield from found
    except OSError:
        return


def _places(root: str, path: str) -> set[tuple[int, int]]:
    """Device and inode of the directories of a path, the root included."""
    names = path.split("/") if path else []
    found = (os.stat(os.path.join(root, *names[:i])) for i in range(len(names) + 1))
    return {(info.st_dev, info.st_ino) for info in found}


def scan_tree(
    roots: DataFrame, matchers: DataFrame | None = None, include_vcs: bool = True
) -> DataFrame:
    """Entries ``(repo, root, path, is_dir, size, depth)`` below ``roots (repo, root)``.

    Goes down level by level: the directories of a level are spread over all
    tasks, so one huge repository is listed in parallel too. Pruned directories
    are not listed at all. Each level is staged, and only the number of its
    directories reaches the driver.
    """
    level = roots.select("repo", "root", F.lit("").alias("path"))
    found: DataFrame | None = None
    depth = 0
    while True:
        spread = level.repartition(F.xxhash64("repo", "path"))
        children = filter_vcs(spread.mapInPandas(_list_directories, _LISTING), include_vcs)
        if matchers is not None:
            children = prune(children, matchers)
        children = stage(children.withColumn("depth", F.lit(depth)), "listing")
        found = children if found is None else found.unionByName(children)
        level = children.filter("is_dir").select("repo", "root", "path")
        if level.isEmpty():
            return found
        depth += 1


def read_contents(entries: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Files of scanned entries in chunks ``(repo, path, chunk, start, last, line, content, size)``.

    A task holds one chunk at a time, whatever the size of a file. An unreadable file is one
    chunk without content and becomes binary; if only the rest of a file cannot be read,
    it becomes an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for chunk, start, last, line, content in _file_chunks(row, chunk_bytes):
                    part = {
                        "repo": row["repo"], "path": row["path"], "chunk": chunk, "start": start,
                        "last": last, "line": line, "content": content, "size": row["size"],
                    }
                    yield pa.RecordBatch.from_pylist([part], schema=CHUNK_SCHEMA)

    files = entries.filter(~F.col("is_dir")).select("repo", "root", "path", "size")
    return files.repartition(F.xxhash64("repo", "path")).mapInArrow(read, CHUNKS)


def _file_chunks(row: dict, chunk_bytes: int) -> Iterator[tuple]:
    try:
        stream = open(os.path.join(row["root"], row["path"]), "rb")
    except OSError:
        yield 0, 0, True, 0, None
        return
    with stream:
        yield from cut_stream(stream, chunk_bytes)


def read_ignore_files(roots: DataFrame) -> DataFrame:
    """The top-level ignore file of every root, as files."""
    listed = roots.select(
        "repo",
        "root",
        F.lit(fixed.IGNORE_FILE).alias("path"),
        F.lit(0).cast("bigint").alias("size"),
        F.lit(False).alias("is_dir"),
    )
    return join_contents(read_contents(listed).filter(F.col("content").isNotNull()))
