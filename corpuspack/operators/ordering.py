"""Positions and running totals within each repository, safe for huge ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.functions.paths import sort_key
from corpuspack.sources.staging import stage


def running_totals(
    rows: DataFrame, group: str, order: Sequence[str], totals: Mapping[str, Column]
) -> DataFrame:
    """Add, per measure, the sum over all earlier rows of the same group.

    ``order`` must be unique within a group. The rows (keep them narrow) are
    range-partitioned into slices and staged, so that the slice boundaries stay
    fixed; a slice then starts from the totals of the slices before it. The
    largest window is one slice, however many rows a single group has.
    """
    slice_no = "_slice"
    measures = [value.cast("bigint").alias(f"_{name}") for name, value in totals.items()]
    sliced = stage(
        rows.select("*", *measures)
        .repartitionByRange(group, *order)
        .withColumn(slice_no, F.spark_partition_id()),
        "slices",
    )
    earlier = Window.partitionBy(group).orderBy(slice_no).rowsBetween(
        Window.unboundedPreceding, -1
    )
    within = Window.partitionBy(group, slice_no).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = (
        sliced.groupBy(group, slice_no)
        .agg(*[F.sum(f"_{name}").alias(f"_sum_{name}") for name in totals])
        .select(
            group,
            slice_no,
            *[
                F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}")
                for name in totals
            ],
        )
    )
    return sliced.join(bases, [group, slice_no]).select(
        *rows.columns,
        *[
            (F.col(f"_base_{name}") + F.coalesce(F.sum(f"_{name}").over(within), F.lit(0))).alias(
                name
            )
            for name in totals
        ],
    )


def entry_order(entries: DataFrame) -> DataFrame:
    """Position of each entry in hierarchical order, from 1."""
    keyed = entries.withColumn("_key", sort_key(F.col("path")))
    numbered = running_totals(keyed, "repo", ["_key"], {"position": F.lit(1)})
    return numbered.select(*entries.columns, (F.col("position") + 1).alias("position"))


def hier_sort(entries: DataFrame) -> DataFrame:
    """Total order: by repository, then path component by component."""
    return entries.orderBy("repo", sort_key(F.col("path")))


def ranks(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``rank``, from 0, in a total order over all rows."""
    keys = [f"_order{i}" for i in range(len(order))]
    keyed = rows.withColumns({"_all": F.lit(0), **dict(zip(keys, order))})
    return running_totals(keyed, "_all", keys, {"rank": F.lit(1)}).select(*rows.columns, "rank")
