"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.llm.common import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link every vertex's neighbours, larger or smaller ones, to its least neighbour.

    A joined back least neighbour instead of a window, so that Spark can split the
    links of a vertex that has very many.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # from the larger to the smaller end only
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(a, root)``: the least vertex that each linked vertex ``a`` can reach.

    ``links`` holds pairs ``(a, b)`` of bigints, in any direction, repeats allowed. A
    least vertex itself is not in the result, nor are vertices without links. Each round
    is written to the shared folder; only a count and a hash reach the driver. The links
    at least halve in depth in each pair of rounds.
    """
    now = stage(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before, seen = None, _sum(now)
    while seen != before and seen[0]:
        now = stage(_star(_star(now, True), False), "links")
        before, seen = seen, _sum(now)
    return now.select("a", F.col("b").alias("root"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "a bigint, b bigint")
