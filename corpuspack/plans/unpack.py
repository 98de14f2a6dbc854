"""From documents or parts back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpuspack.operators import reconstruct as rc
from corpuspack.operators.split import join_parts
from corpuspack.sources.staging import stage


def unpack_documents(documents: DataFrame) -> DataFrame:
    """Files ``(repo, path, content)`` of assembled documents."""
    blocks = documents.withColumnRenamed("repo", "doc").select("doc", "block", "text")
    return rc.reconstruct(blocks).withColumnRenamed("doc", "repo")


def unpack_parts(parts: DataFrame) -> DataFrame:
    """Files ``(repo, path, content)`` of split documents.

    The joined text is staged: it takes a shuffle, and is read more than once.
    """
    blocks = stage(join_parts(parts), "joined")
    return rc.reconstruct(blocks).withColumnRenamed("doc", "repo")
