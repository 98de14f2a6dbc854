"""Corpora held as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def files_table(
    table: DataFrame, repo: Column | str, path: Column | str, content: Column | str
) -> DataFrame:
    """Any table as files ``(repo, path, content)``; content becomes bytes."""

    def col(c: Column | str) -> Column:
        return table[c] if isinstance(c, str) else c

    return table.select(
        col(repo).cast("string").alias("repo"),
        col(path).cast("string").alias("path"),
        col(content).cast("binary").alias("content"),
    )
