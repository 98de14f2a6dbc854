"""The pipeline's stages against brute force, on the smallest tables."""

from collections import Counter

import corpus_pipeline
import duckdb
from test_operators import brute_components, check_packing

from corpuspack.llm import packing, queries, quality_rules, simhash
from corpuspack.llm.common import is_held_out

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for i, (_, stage_of) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage_of(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns
        tables.append(docs)
    texts = [dict(t.select("doc_id", "text").collect()) for t in tables[:4]]

    def ok(text):
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text.encode())))
        limits = [(m["dup_line_chars"], 30)]
        limits += [(m[f"dup_chars_{n}"], p) for n, p in quality_rules.MAX_RUN_PERCENT.items()]
        return (
            m["n_words"] >= 50
            and 2 * m["n_repeat_words"] <= m["n_words"]
            and 10 * m["n_symbols"] <= m["n_words"]
            and all(100 * a <= p * m["word_chars"] for a, p in limits)
        )

    assert set(texts[1]) == {d for d, t in texts[0].items() if ok(t)}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(texts[2]) <= set(texts[1])
    gone = set(texts[1]) - set(texts[2])
    assert not [d for d in gone if labels.get(d) == 1] and len(gone) <= 0.05 * len(texts[1])
    prints = [(d, simhash.fingerprint(t.encode())) for d, t in texts[2].items()]
    assert set(texts[3]) == set(brute_components(prints))
    mixed = [(r["doc_id"], r["text"]) for r in tables[4].collect()]
    assert {d for d, _ in mixed} <= set(texts[3])
    check_packing(mixed, packing.pack(tables[4], with_ids=True).collect())
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_held_out_toxicity_and_language_model(spark):
    """What was not learned from: labels are found, and texts are likelier than by the base."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.op8_toxicity(spark, sf).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and sum(p == t for p, t in held) >= 0.95 * len(held)
    scores = [r for r in queries.op4_katz(spark, sf).collect() if r["held_out"]]
    assert all(is_held_out(r["doc_id"], 10) for r in scores)
    assert sum(r["score"] for r in scores) > sum(r["base_score"] for r in scores)


def test_queries_with_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        ours = queries.QUERIES[name](spark, SF)
        theirs = con.execute(sql)
        names = [c[0] for c in theirs.description]
        assert sorted(names) == sorted(ours.columns)
        assert Counter(tuple(r) for r in ours.select(*names).collect()) == Counter(theirs.fetchall())
