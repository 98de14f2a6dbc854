"""The trie of conversations against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from corpuspack.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, path string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def frame(spark, turns):
    return spark.createDataFrame([(*t, "k", "p") for t in turns], SCHEMA)


def brute(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(cs) - 1) * (len(node[-1][1]) if node else 0)
    found = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if built[c] == node))
        parent = min(members[node[:-1]]) if node else None
        found.append(
            (min(cs), len(node), parent, len(cs), children[node], leaves[node], saved[node],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return Counter(found)


def given(rng, n):
    turns = []
    for _ in range(n):
        c = rng.choice([rng.randrange(60), 100 * rng.randrange(4), rng.randrange(1000)])
        for t in range(rng.randint(1, 9)):
            turns.append((c, rng.randrange(10**6), rng.choice(["user", "bot"]), rng.choice(["a", "é\U0001f600", "bb", ""])))
    return turns


@pytest.mark.parametrize("shard_bytes", [None, 400, 60])
def test_trie(spark, shard_bytes):
    """One shard; many; and many rounds."""
    rng = random.Random(shard_bytes)
    turns = given(rng, 400)
    turns += [(7, None, None, None), (8, 5, "user", None), (9, 1, "x", "long " * 5000), (None, 1, "user", "a")]
    same = [(t, "user", f"turn {t}") for t in range(40)]  # copies, and a deep common way
    turns += [(5000 + i, *t) for i in range(80) for t in same[: 40 - (i % 7 == 0)]]
    found = prefix_trie.trie(frame(spark, turns), shard_bytes)
    assert found.columns == COLUMNS
    assert Counter(tuple(r) for r in found.collect()) == brute(turns)


def test_turnless_and_empty(spark):
    assert prefix_trie.trie(frame(spark, [])).count() == 0
    assert prefix_trie.trie(frame(spark, [(None, 0, "user", "x")])).count() == 0
    ids = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1][:5]
    turns = [(c, 0, "user", "gone") for c in ids]  # fewer turns than they take from no base
    found = [tuple(r) for r in prefix_trie.trie(frame(spark, turns)).collect()]
    assert Counter(found) == brute(turns) and len(found) == 1


def test_findclose():
    rng = random.Random(2)
    for n in (1, 2, 3, 50, 1000):
        bits, depth, left = [], 0, n
        while left or depth:
            opened = left and (not bits or depth and rng.random() < 0.5 or depth == 1)
            bits.append(bool(opened))
            depth, left = (depth + 1, left - 1) if opened else (depth - 1, left)
        tree = prefix_trie.Parentheses(np.array(bits))
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        assert tree.findclose().tolist() == [close[i] for i in tree.opens.tolist()]


def test_sql(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rows = con.execute(prefix_trie.ORACLE)
    names = [c[0] for c in rows.description]
    ours = queries.op13_prefix_trie(spark, sf).select(*names).collect()
    assert Counter(tuple(r) for r in ours) == Counter(rows.fetchall())
