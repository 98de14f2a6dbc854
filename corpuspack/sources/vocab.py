"""Vocabulary files: one ``<base64> <id>`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack import fixed
from corpuspack.functions.text import from_base64


def read_vocab_lines(spark: SparkSession, path: str, skip_header: bool = False) -> DataFrame:
    """Lines of vocabulary files as ``value``; ``skip_header`` drops each file's first."""
    if not skip_header:
        return spark.read.text(path)
    return spark.read.csv(
        path, schema="value STRING", sep="\u0001", quote="", header=True, enforceSchema=True
    )


def _parsed(lines: DataFrame) -> DataFrame:
    # one trailing separator ends the last field, it does not start another
    parts = F.split(F.regexp_replace("value", r" \z", ""), " ")
    digits = F.regexp_extract(F.get(parts, F.lit(1)), r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
    token = from_base64(F.get(parts, F.lit(0)))
    specials = F.create_map(*[F.lit(x) for kv in fixed.SPECIAL_TOKENS.items() for x in kv])
    return lines.select(
        "value",
        token.alias("token"),
        digits.try_cast("int").alias("id"),
        F.when((F.size(parts) != 2) | token.isNull(), "malformed")
        .when(digits == "", "bad id")
        .when(digits.try_cast("int").isNull(), "id out of range")
        .alias("reason"),
    ).withColumn(
        "is_special",
        F.coalesce(
            F.try_element_at(specials, F.col("token").cast("string")) == F.col("id"),
            F.lit(False),
        ),
    )


def load_vocab(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse lines into the vocabulary and the rejected lines with a reason.

    A special token counts as special only under its expected id. Of several ids
    for the same bytes the largest stays.
    """
    parsed = _parsed(lines)
    vocab = (
        parsed.filter(F.col("reason").isNull())
        .groupBy("token", "is_special")
        .agg(F.max("id").alias("id"))
        .select("token", "id", "is_special")
    )
    rejects = parsed.filter(F.col("reason").isNotNull()).select("value", "reason")
    return vocab, rejects
