"""The given tables, seen as corpora of files.

The SQL texts are valid in Spark and in standard dialects; they give every
repository rule files, fences and headings inside content, empty files, code and
folders that are ignored. All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.functions.text import pretokens
from corpuspack.operators import ordering
from corpuspack.sources.staging import stage
from corpuspack.sources.tables import files_table

DOCUMENT_FILES = """
SELECT source AS repo,
       concat(
         CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/lib/'
           WHEN 3 THEN 'build/' WHEN 4 THEN concat('docs/', lang, '/')
           WHEN 5 THEN '.git/objects/' ELSE 'src/lib-old/' END,
         'd', doc_id,
         CASE doc_id % 11 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.c'
           WHEN 3 THEN '.H' WHEN 4 THEN '.log' WHEN 5 THEN '.html'
           WHEN 6 THEN '.json' WHEN 7 THEN '.sql' WHEN 8 THEN '.png'
           WHEN 9 THEN '' ELSE '.txt' END) AS path,
       CASE doc_id % 9
         WHEN 0 THEN concat(text, chr(10), '```', chr(10), 'x', chr(10), '```', chr(10))
         WHEN 1 THEN concat(text, chr(10), chr(10), '## h', chr(10))
         WHEN 2 THEN concat(text, chr(10))
         WHEN 3 THEN concat('### 📄 fake', chr(10), text)
         WHEN 4 THEN concat('/** d */', chr(10), 'int f(void) {', chr(10), '}', chr(10),
                chr(10), 'int g(int x) {', chr(10), text, chr(10), '}', chr(10))
         ELSE text END AS text
FROM documents
UNION ALL
SELECT DISTINCT source, '.gitignore',
       concat('# rules', chr(10), '*.log', chr(10), '!important.log', chr(10), '  build/ ', chr(10),
              'temp*', chr(10), '!temp_keep.txt', chr(10), '/config/', chr(10))
FROM documents
UNION ALL
SELECT DISTINCT source, '.keep', '' FROM documents
"""

PAGE_FILES = """
SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS repo,
       concat(regexp_extract(url, '^https?://[^/]+/([^?#]*[^?#/])', 1), '/p', page_id, '.html') AS path,
       html AS text
FROM pages
"""

# Rules for the pages, in order.
PAGE_PATTERNS = ("*.log", "!important.log", "build/", "temp*", "!temp_keep.txt", "/config/", "/en/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, spread over the cores if it has fewer splits than these."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _from_sql(spark: SparkSession, sf_dir: str, name: str, query: str) -> DataFrame:
    escaped = query.replace("{", "{{").replace("}", "}}")
    source = table(spark, sf_dir, name)
    rows = spark.sql(escaped.replace(f"FROM {name}", "FROM {source}"), source=source)
    return files_table(rows, "repo", "path", "text")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files, one repository per source."""
    return _from_sql(spark, sf_dir, "documents", DOCUMENT_FILES)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as files, one repository per host."""
    return _from_sql(spark, sf_dir, "pages", PAGE_FILES)


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def document_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All single bytes, then all pretokens of ``benchmark`` by frequency.

    Those of another table, so that ``documents`` have known and unknown ones.
    """
    counts = stage(
        table(spark, sf_dir, "benchmark")
        .select(F.explode(pretokens(F.col("text"))).alias("pretoken"))
        .groupBy("pretoken")
        .agg(F.count("*").alias("n")),
        "pretokens",
    )
    longer = counts.filter(F.octet_length("pretoken") > 1)
    ranked = ordering.ranks(longer, [-F.col("n"), F.col("pretoken")])
    single = spark.range(256).select(
        F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token"), F.col("id").cast("int").alias("id")
    )
    both = single.unionByName(
        ranked.select(
            F.col("pretoken").cast("binary").alias("token"),
            (F.col("rank") + 256).cast("int").alias("id"),
        )
    )
    return stage(both.withColumn("is_special", F.lit(False)), "vocab")
