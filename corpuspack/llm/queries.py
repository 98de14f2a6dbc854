"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.llm import (
    katz,
    kneser_ney,
    lexical,
    merge_replay,
    mixing,
    packing,
    prefix_trie,
    quality_rules,
    sharding,
    simhash,
    token_edits,
    topk,
    toxicity,
)
from corpuspack.llm.common import tables


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors of every hundredth one."""
    vectors = tables(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    return quality_rules.judge(tables(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(tables(spark, sf_dir, "documents"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document."""
    return katz.score(tables(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(tables(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    documents = tables(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(documents, sharding.shard_names())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    return kneser_ney.classify(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.judge(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op9_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits."""
    documents = tables(spark, sf_dir, "documents")
    edits = token_edits.revisions(F.col("text"), F.col("doc_id"))
    return token_edits.count(documents.withColumn("edits", edits))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of every document."""
    return mixing.mix(tables(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as hashes."""
    return merge_replay.digests(tables(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations."""
    return prefix_trie.trie(tables(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_katz": op4_katz,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op9_token_edits": op9_token_edits,
    "op10_mixing": op10_mixing,
    "op11_lexical": op11_lexical,
    "op12_merge_replay": op12_merge_replay,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_topk": topk.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op11_lexical": lexical.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
