"""Ranked search against scoring every document."""

import random
import re
from collections import Counter

import duckdb
import pytest
from test_operators import LONG, TEXTS, frame, rows

from corpuspack.llm import lexical

ITEMS = "item_id bigint, text string, rank int, score string"


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in found]


def brute(documents, items, k):
    held = [(d, terms(t)) for d, t in documents]
    held = [(d, Counter(t), len(t)) for d, t in held if t]
    n, total = len(held), sum(size for _, _, size in held)
    df = Counter(t for _, counts, _ in held for t in counts)
    found = []
    for item, text in items:
        scored = []
        for d, counts, size in held:
            m = 25 + 75 * size * n // total
            score = 0
            for t in terms(text):
                if tf := counts[t]:
                    score += lexical.weight(df[t], n) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score:
                scored.append((-score, d is None, d or 0))
        for i, (score, null, d) in enumerate(sorted(scored)[:k]):
            found.append((item, i + 1, None if null else d, -score))
    return Counter(found)


def items_df(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)


def test_terms():
    text = "A-Z the_Cat ÉTÉ 12x\x7f\u00a0日本 'don't'\x00b\U0001f600"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)
    assert lexical.terms_of(None) == []


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, small):
    """Ties, repeats and nulls; with small blocks, strata and holds too."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["été", "日本"]
    texts = [*TEXTS, *[" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(300)]]
    texts += ["w1 W2 w3"] * 40 + [" ".join(rng.choices(words, k=20)) for _ in range(100)]
    ids = [None, None, *range(len(texts) - 4), 7, 7]
    items = [(1, "w1 w2, w2 W3"), (2, None), (3, ""), (None, "cat mat end"), (1, "w5"), (4, "nowhere")]
    items += [(5, "été 日本"), (6, LONG), *[(10 + i, " ".join(rng.choices(words, k=9))) for i in range(12)]]
    if small:
        monkeypatch.setattr(lexical, "ROW_DOCUMENTS", 7)
        monkeypatch.setattr(lexical, "HELD_DOCUMENTS", 20)
    df = frame(spark, texts, ids).withColumnRenamed("source", "q").withColumnRenamed("lang", "n")
    found = lexical.search(df, items_df(spark, items), block_terms=15 if small else 10**6)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(rows(found)) == brute(list(zip(ids, texts)), items, lexical.TOP)


def test_nothing_to_find(spark):
    none, items = frame(spark, []), items_df(spark, [(1, "w1")])
    assert lexical.search(none, items).count() == 0
    assert lexical.search(frame(spark, [None, "", "--"]), items).count() == 0
    empty = lexical.search(frame(spark, TEXTS), items_df(spark, [(1, None)]))
    assert empty.count() == 0 and empty.dtypes == lexical.search(none, items).dtypes


def test_strata_are_split_and_bounded(spark):
    """A length that all documents have is many index rows, and poor strata are not scored."""
    texts = [f"x{i} common" for i in range(1000)] + ["rare common " * 400]
    made = lexical._postings(frame(spark, texts), {b"common": 0, b"rare": 1})
    made = made.selectExpr("*", "monotonically_increasing_id() AS row")
    found = lexical.index(made, len(texts), 2000 + 800).collect()
    assert sum(len(r["ids"]) for r in found) == len(texts)
    assert {len(set(zip(r["term"], r["tf"]))) for r in found} == {1, 2}
    assert all(sum(r["size"]) == len(r["doc"]) for r in found)


def test_sql(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = lexical.search(
        spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    )
    assert Counter(rows(found)) == Counter(con.execute(lexical.ORACLE).fetchall())
