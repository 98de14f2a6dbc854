"""Encoding and decoding against the tokenizer library and against merging one pair at a time."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from test_operators import TEXTS, frame, rows

from corpuspack.llm import merge_replay, queries

RANKS = merge_replay.load_ranks(public_tokenizers.path(merge_replay.RANKS))
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
SPARSE = {bytes([b]): b for b in range(256)} | {
    t: 256 + i for i, t in enumerate([b"abc", b"bc", b"ab", b"cab", b"aa", b"aab", b"aaaa"])
}


def brute(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        ranked = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not ranked:
            return [ranks[p] for p in parts]
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def check(words, ranks):
    ids, sizes = merge_replay.Replay(ranks).encode(words)
    at = 0
    for word, size in zip(words, sizes.tolist()):
        assert ids[at : at + size].tolist() == brute(word, ranks)
        at += size
    assert at == len(ids)


def test_replay_equals_merging_one_pair_at_a_time():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"abc", k=rng.randint(1, 40))) for _ in range(3000)]
    words += [b"a" * k for k in range(1, 120)]
    check(words, SPARSE)  # with merges that make pairs of lower rank
    some = list(RANKS)
    words += [b"".join(rng.choices(rng.choices(some, k=3), k=8)) for _ in range(2000)]
    words += [bytes(rng.choices(range(256), k=rng.randint(1, 30))) for _ in range(1000)]
    check(words, RANKS)
    check([], RANKS)


def test_one_long_word():
    rng = random.Random(4)
    word = bytes(rng.choices(b"abcdefgh", k=50_000))
    ids, _ = merge_replay.Replay(RANKS).encode([word])
    assert ids.tolist() == LIBRARY._encode_single_piece(word.decode())


def test_vocabulary_without_all_bytes():
    with pytest.raises(ValueError):
        merge_replay.Replay({b"a": 0})


def digest(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("small", [False, True])
def test_documents(spark, monkeypatch, small):
    if small:  # many blocks, and texts whose words are not listed
        monkeypatch.setattr(merge_replay, "BLOCK_WORDS", 7)
        monkeypatch.setattr(merge_replay, "LONG_TEXT", 5)
    odd = "".join(chr(c) for c in [*range(1, 0x250), 0x2028, 0x3000, 0x1680, 0x200B, 0xFEFF, 0x1F600])
    texts = [*TEXTS, odd, " ".join(odd), "it's  we're\n\n  x \t", "\u65e5\u672c\u8a9e" * 2000, "one", "one"]
    if small:
        texts = [t for t in texts if not t or len(t) < 1000]
    df = frame(spark, texts).withColumnRenamed("source", "ids").withColumnRenamed("lang", "data")
    found = rows(merge_replay.digests(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        joined = ",".join(map(str, ids)).encode()
        want.append((i, len(ids), digest(joined), digest((t or "").encode())))
    assert sorted(found) == want


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    found = queries.op12_merge_replay(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = LIBRARY.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == digest(",".join(map(str, ids)).encode())
        assert r["decoded_sha256"] == digest(texts[r["doc_id"]].encode())


def test_empty_table(spark):
    none = frame(spark, [])
    assert merge_replay.digests(none).count() == 0
    assert merge_replay.encode(none).columns == ["doc_id", "n_tokens", "ids"]
