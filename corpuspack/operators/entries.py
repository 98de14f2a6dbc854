"""Entries (files and directories) of many repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.functions.paths import ancestors, depth, in_vcs_dir, parent


def entries(files: DataFrame) -> DataFrame:
    """File rows plus one row per directory that holds them, with depth.

    Only ``repo`` and ``path`` are read. Directories come from the distinct
    parents, so a directory is expanded into its ancestors once, not per file.
    """
    paths = files.select("repo", "path")
    parents = (
        paths.select("repo", parent(F.col("path")).alias("path"))
        .filter(F.col("path").isNotNull())
        .distinct()
    )
    directories = parents.select(
        "repo", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("path")
    ).distinct()
    both = paths.withColumn("is_dir", F.lit(False)).unionByName(
        directories.withColumn("is_dir", F.lit(True))
    )
    return both.withColumn("depth", depth(F.col("path")))


def filter_vcs(rows: DataFrame, include_vcs: bool = False) -> DataFrame:
    """Drop version control folders and all that is in them."""
    return rows if include_vcs else rows.filter(~in_vcs_dir(F.col("path")))


def entry_counts(rows: DataFrame) -> DataFrame:
    """Number of entries and of directories per repository."""
    return rows.groupBy("repo").agg(
        F.count("*").alias("n_entries"), F.count_if(F.col("is_dir")).alias("n_dirs")
    )


def corpus_status(repos: DataFrame, listing: DataFrame) -> DataFrame:
    """``ok``, ``all_ignored`` or ``empty`` for every repository in ``repos``.

    ``listing`` are all entries, with ``kept`` false where a filter drops them.
    They are reduced to counts per repository before the join.
    """
    counts = listing.groupBy("repo").agg(
        F.count("*").alias("n_found"), F.count_if("kept").alias("n_kept")
    )
    n_found = F.coalesce("n_found", F.lit(0))
    n_kept = F.coalesce("n_kept", F.lit(0))
    return (
        repos.select("repo")
        .distinct()
        .join(counts, "repo", "left")
        .select(
            "repo",
            n_found.alias("n_found"),
            n_kept.alias("n_kept"),
            F.when(n_kept > 0, "ok")
            .when(n_found > 0, "all_ignored")
            .otherwise("empty")
            .alias("status"),
        )
    )
