import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("corpuspack-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="corpuspack-test-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def files_df(spark, files, repo="r"):
    """Files from ``{path: text or bytes}``."""
    rows = [
        (repo, path, text if isinstance(text, bytes) else text.encode())
        for path, text in files.items()
    ]
    return spark.createDataFrame(rows, "repo string, path string, content binary")


def column(df, *names):
    """Rows as tuples of the named columns."""
    return [tuple(row[n] for n in names) for row in df.select(*names).collect()]
