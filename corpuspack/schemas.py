"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)

ENTRIES = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("depth", T.IntegerType()),
    ]
)

PATTERNS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("pattern", T.StringType()),
    ]
)

VOCAB = T.StructType(
    [
        T.StructField("token", T.BinaryType()),
        T.StructField("id", T.IntegerType()),
        T.StructField("is_special", T.BooleanType()),
    ]
)

MERGES = T.StructType(
    [
        T.StructField("first", T.BinaryType()),
        T.StructField("second", T.BinaryType()),
        T.StructField("rank", T.IntegerType()),
    ]
)

BLOCKS = T.StructType(
    [
        T.StructField("doc", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)
