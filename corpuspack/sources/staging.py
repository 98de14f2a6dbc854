"""Tables written to the cluster's shared folder to fix intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Or else the one given to ``SparkContext.setCheckpointDir``. There is no other: a
    folder that only one machine sees loses tables.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nothing else uses, for a table or for exported files."""
    return f"{shared_folder(spark)}/corpuspack/{name}-{uuid.uuid4().hex}"


def shared_posix_path(path: str) -> str:
    """The path as Python functions in tasks open it: the shared folder as mounted."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"tasks cannot open {path} as a file; name a mounted shared folder")
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Every later use sees the same rows, whatever is recomputed after a lost
    executor, and Spark knows the real size when it picks a join.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
