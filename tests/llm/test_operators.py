"""The operators against brute force, and on odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuspack.llm import (
    katz,
    kneser_ney,
    mixing,
    packing,
    quality_rules,
    sharding,
    simhash,
    token_edits,
    topk,
    toxicity,
)
from corpuspack.llm.common import is_held_out, stage
from corpuspack.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "Two words",
    "the cat sat on the mat " * 30,
    "the cat sat on the mat " * 30,
    "Ünïcode ß words; don't 12 <|endoftext|> ### $$$\n\n日本 text",
    "a\x0bb\x0cc\rd e f",
    LONG,
    LONG + " end",
]


def frame(spark, texts, ids=None):
    rows = [
        (i if ids is None else ids[n], t, ["en", "de", None][i % 3], ["s1", "s2", None, "Z"][i % 4], None)
        for n, (i, t) in enumerate(zip(range(len(texts)), texts))
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS, [None, 1, 2, 3, 4, 5, 6, 7, 7, 9, 10])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    """Random texts with copies and near copies."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(120)]
    texts += [texts[3], texts[3], texts[4].upper(), texts[5] + " tail", None, ""]
    return frame(spark, texts)


def rows(df, *names):
    return [tuple(r[n] for n in names or df.columns) for r in df.collect()]


def words_of(text):
    return (text or "").encode().lower().split()


# -- top-k ----------------------------------------------------------------------------


def brute_top(vectors, k, every):
    ok = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in vectors
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q, a in ok:
        if q % every == 0:
            hits = [
                (-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b)
            ]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(hits)[:k])}
    return out


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_top_k(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "GROUP_BUCKETS", 2)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6))
    data = [
        (i, (centres[i % 4] * math.exp(spread * rng.normal()) + 0.05 * rng.normal(size=6)).tolist())
        for i in range(300)
    ]
    data += [(300, data[7][1]), (301, data[7][1]), (302, [0.0] * 6), (303, None), (None, [1.0] * 6)]
    data += [(304, [float("nan")] * 6), (305, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (310, [1.0, 2.0])]
    data += [(306, [float("inf")] * 6), (320, [3.0, 1.0]), (330, [])]
    vectors = spark.createDataFrame(
        [(i, v, "x", 1) for i, v in data], "vec_id bigint, embedding array<double>, id string, v int"
    )
    found = rows(topk.top_k(vectors, vectors.filter("vec_id % 10 = 0")), "query_id", "rank", "vec_id", "score")
    assert len(found) == len(set(found))
    assert set(found) == brute_top(data, 10, 10)


def test_top_k_empty(spark):
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(vectors, vectors).count() == 0


def test_coordinate_ranges_lose_nothing():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(4000, 3))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for t in (0.75, 0.9, 0.99, 1.0):
        for q in (unit[0], np.array([1.0, 0, 0]), np.array([-1.0, 0, 0])):
            need = set(np.flatnonzero(unit @ q >= t))
            assert need <= set(topk._feasible(q, unit, t))


def test_huge_components(spark):
    vectors = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id bigint, embedding array<double>")
    found = rows(topk.top_k(vectors, vectors.filter("vec_id = 0")), "vec_id", "score")
    assert found == [(1, (1 << 63) - 1), (2, -(1 << 63))]


# -- quality rules --------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.split()]
    tri = Counter(zip(words, words[1:], words[2:]))
    again = set()
    for i in range(len(words) - 2):
        if tri[tuple(words[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    out = [
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(again),
    ]
    seen, chars = set(), 0
    for x in lines:
        chars += sum(len(w.decode()) for w in x.split()) if x in seen else 0
        seen.add(x)
    out.append(chars)
    for n in quality_rules.LENGTHS:
        seen, inside = set(), set()
        for i in range(len(words) - n + 1):
            w = tuple(words[i : i + n])
            if w in seen:
                inside |= set(range(i, i + n))
            seen.add(w)
        out.append(sum(len(words[i].decode()) for i in inside))
    return tuple(out)


def test_quality_measures(spark, docs, corpus, none):
    for df in (docs, corpus):
        found = rows(quality_rules.judge(df.withColumnRenamed("lang", "k0"), keep=("doc_id", "text")), "text", *quality_rules.MEASURES)
        assert Counter(found) == Counter((t, *brute_rules(t)) for (t,) in rows(df, "text"))
    assert quality_rules.judge(none).count() == 0


def test_quality_verdicts(spark):
    rng = random.Random(3)
    clean = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(300))
    part = " ".join(clean.split()[:40])
    texts = [clean, "x y z " * 100, clean.replace(" ", "%%% "), (part + "\n") * 2 + part, None]
    kept = dict(rows(quality_rules.judge(frame(spark, texts)), "doc_id", "kept"))
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert rows(quality_rules.accepted(frame(spark, texts)), "text") == [(clean,)]


# -- SimHash --------------------------------------------------------------------------


def brute_components(prints):
    """``{row: least id}`` from ``[(id, print)]``."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)].append(d)
    return [min(least[find(i)], default=None) for i in range(len(prints))]


def test_near_duplicates(spark, docs, corpus, none):
    for df in (docs, corpus):
        given = rows(df, "doc_id", "text")
        prints = [(d, simhash.fingerprint(t.encode() if t is not None else None)) for d, t in given]
        want = [(d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints))]
        found = rows(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id")
        assert Counter(found) == Counter(want)
        assert {d for (d,) in rows(simhash.representatives(df), "doc_id")} == {c for _, _, c in want}
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.representatives(none).count() == 0


def test_one_row_of_each_component(spark):
    """Rows without ids or with equal ones do not take each other away."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    copy = c.upper()  # other text, equal fingerprint
    given = [(None, a), (None, b), (None, a.upper()), (1, a), (7, c), (7, d), (8, c), (3, copy), (None, None), (9, "e"), (9, "e")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in given], "doc_id bigint, text string, Row_Key string, source string, fp bigint")
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    want = [(1, a), (None, b), (3, copy), (7, d), (None, None), (9, "e")]
    assert Counter(rows(kept, "doc_id", "text")) == Counter(want)


def test_links_of_many_near_prints(spark):
    """All prints within three bits of each other, and chains of them, in one component."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = [(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for b in base for _ in range(60)]
    walk = [rng.getrandbits(64)]
    for _ in range(40):
        walk.append(walk[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(set(prints + walk))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(s, s) for s in signed], "fp bigint, group bigint")
    pairs = rows(components(simhash.links(table)))
    group = {s: s for s in signed} | dict(pairs)
    want = brute_components([(s, p) for s, p in zip(signed, prints)])
    assert [group[s] for s in signed] == want


def test_what_asks_for_links_is_not_broadcast(spark, capsys):
    """However few bytes the prints are on disk, the rows that they become do not reach the driver."""
    signed = [(i << 40) + 7 * i for i in range(1, 300)] + [(5 << 40) + 34]  # one bit from 5's
    table = stage(spark.createDataFrame([(s, s) for s in signed], "fp bigint, group bigint"), "test-prints")
    found = simhash.links(table)
    found.explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "Broadcast" not in plan
    pairs = {(a, b) for a in signed for b in signed if a < b and (a ^ b).bit_count() <= 3}
    assert len(pairs) > 1 and {(min(p), max(p)) for p in rows(found)} == pairs


def test_fingerprint_of_shingles():
    import xxhash

    words = "a b c d a b c".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)
    assert simhash.fingerprint(b"A b\tC d a  b c") == want
    assert simhash.fingerprint(b"Ab") == xxhash.xxh64_intdigest("ab", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" ") == 0


# -- Katz -----------------------------------------------------------------------------


def brute_katz(given, share):
    tokens = [[*words_of(t), None] for _, t in given]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % katz.FOLDS == 0 for d, _ in given]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)

    def kept(counts):
        of = [0] * 7
        for x in counts:
            if x <= 6:
                of[x] += 1
        d = katz.discounts(of)
        return (lambda x: x * d[x] if x <= 5 else x), sum(of[r] * r * (1 - d[r]) for r in range(1, 6))

    cut, lost = kept(c.values())
    whole, spare = (n, lost) if lost > 0 else (n + 1, 1)

    def single(w):
        return cut(c[w]) / whole if c[w] else spare / whole

    def kind(w):
        return w if c[w] and (w is None or c[w] >= n * share) else "other"

    p1 = {kind(w): single(w) for w in c if kind(w) != "other"}
    p1["other"] = 1 - sum(p1.values())
    after = defaultdict(Counter)
    for ws, h in zip(tokens, held):
        if not h:
            for a, b in zip([None, *ws], ws):
                after[kind(a)][kind(b)] += 1
    cut2, _ = kept([x for f in after.values() for x in f.values()])

    def p(b, a):
        follow = after.get(a)
        if not follow:
            return p1[b]
        total = sum(follow.values())
        lost = total - sum(map(cut2, follow.values()))
        met = sum(p1[x] for x in follow)
        if met > 1 - 1e-9:
            return follow[b] / total
        size, spare = (total, lost) if lost > 1e-12 else (total + 1, 1)
        return cut2(follow[b]) / size if follow[b] else spare / size / (1 - met) * p1[b]

    for a in list(after)[:30]:
        assert abs(sum(p(b, a) for b in p1) - 1) < 1e-9
    out = []
    for (d, _), ws, h in zip(given, tokens, held):
        score = base = 0.0
        for a, b in zip([None, *ws], ws):
            score += math.log10(p(kind(b), kind(a)))
            if kind(b) == "other":
                score += math.log10(single(b) / p1["other"])
            base += math.log10((c[b] + 0.1) / (n + 0.1 * (v + 1)))
        out.append((str(d), h, len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("share, block", [(1e-6, 3_000_000), (1e-3, 700)])
def test_katz(docs, corpus, none, share, block):
    for df in (docs, corpus):
        found = sorted((str(r[0]), *r[1:]) for r in rows(katz.score(df, block, share)))
        want = brute_katz(rows(df, "doc_id", "text"), share)
        assert [r[:5] for r in found] == [r[:5] for r in want]
        for one, other in zip(found, want):
            assert one[5:] == pytest.approx(other[5:], rel=1e-9, abs=1e-6)
    assert katz.score(none).count() == 0


def test_katz_counts_pairs_of_rare_words(spark, monkeypatch):
    """Words of less than a millionth of all tokens; frequent ones have pairs in several shards."""
    texts = ["a b " * 550_000, "rare pair a", "rare pair b", "pair rare", "rare new", "b a rare pair"]
    ids = [i for i in range(99) if not katz.is_held_out(i, katz.FOLDS)][:5]
    ids.append(next(i for i in range(99) if katz.is_held_out(i, katz.FOLDS)))
    df = frame(spark, texts, ids)
    want = brute_katz(rows(df, "doc_id", "text"), 0)
    for shard_tokens in (katz.SHARD_TOKENS, 200_000):
        monkeypatch.setattr(katz, "SHARD_TOKENS", shard_tokens)
        found = sorted((str(r[0]), *r[1:]) for r in rows(katz.score(df, 500)))
        assert [r[:5] for r in found] == [r[:5] for r in want]
        for one, other in zip(found, want):
            assert one[5:] == pytest.approx(other[5:], rel=1e-9, abs=1e-6)


def test_katz_without_training(spark):
    held = [i for i in range(40) if katz.is_held_out(i, katz.FOLDS)][:2]
    found = rows(katz.score(frame(spark, ["a b", ""], held)))
    assert [(r[1], r[3], r[4], r[6]) for r in found] == [(True, 0, 0, 0.0)] * 2


# -- packing --------------------------------------------------------------------------


def check_packing(given, pieces, window=packing.WINDOW):
    coder = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for d, t in given:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        want[d, np.array(ids, "<u4").tobytes()] += 1
    ends = defaultdict(list)
    for p in pieces:
        ends[p["sequence_id"]].append((p["offset"], p["length"]))
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] > 0
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    found = Counter()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], p["ids"]))
    for (d, n), own in by_doc.items():
        starts = defaultdict(list)
        for s, ids in own:
            starts[s].append(ids)
        while starts.get(0):
            text = b""
            while len(text) < 4 * n:
                text += starts[len(text) // 4].pop()
            found[d, text] += 1
        assert not any(starts.values())
    assert found == want


def test_packing(docs, corpus, none):
    for df in (docs, corpus):
        check_packing(rows(df, "doc_id", "text"), packing.pack(df, with_ids=True).collect())
    assert packing.pack(none).count() == 0


def test_sum_of_squares_choice():
    levels = packing.SumOfSquares(8)

    def piece(n):
        return packing.Piece(0, 0, bytes(4 * n), n)

    for n in (5, 5, 6):
        assert levels.place(piece(n)) is None or n
    # 3 fills one of two windows at 5 rather than opening one
    assert sum(map(len, levels.place(piece(3)))) == 8
    assert levels.count[5] == 1 and levels.count[6] == 1


# -- sharding -------------------------------------------------------------------------


def test_sharding(spark, docs, none):
    names = sharding.shard_names()
    table = sharding.lookup_table(names)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(table) == sharding.SLOTS
    fewer = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(table, fewer))
    assert moved < 4 * sharding.SLOTS / len(names)
    placed = sharding.place(docs.withColumnRenamed("lang", "shard"), names)
    assert placed.columns == ["doc_id", "text", "source", "n_chars", "slot", "shard", "shard_name"]
    for d, slot, shard, name in rows(placed, "doc_id", "slot", "shard", "shard_name"):
        assert slot == sharding._number("" if d is None else str(d)) % sharding.SLOTS
        assert shard == table[slot] and name == names[shard]
    assert placed.count() == len(TEXTS) and sharding.place(none, names).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 6400)


# -- quality classifier ---------------------------------------------------------------


@pytest.mark.parametrize("small", [True, False])
def test_kneser_ney_learns_from_all_trusted_documents(spark, monkeypatch, small):
    """Of more than 100,000, also those that are last by any order."""
    monkeypatch.setattr(kneser_ney, "small_enough", lambda table: small)
    ids = spark.range(150_000).withColumnRenamed("id", "doc_id")
    docs = ids.select("doc_id", F.expr("CASE WHEN xxhash64(doc_id) < 8.5e18 THEN 'a' ELSE 'q' END AS text"))
    model = kneser_ney.train(docs, ids.select("doc_id", F.lit(1).alias("quality")))
    table = kneser_ney._symbol_table()
    assert {int(table[ord(c)]) for c in "aq"} <= set(model.grams[0][0].tolist())


def brute_kneser_ney(texts):
    """Log probability of the n-grams of ``texts`` by the textbook, as a function."""
    table = kneser_ney._symbol_table()
    counts = [Counter() for _ in range(kneser_ney.ORDER + 1)]
    for t in texts:
        s = kneser_ney.symbols(t.encode(), table).tolist()
        for i in range(len(s) - kneser_ney.ORDER + 1):
            counts[-1][tuple(s[i : i + kneser_ney.ORDER])] += 1
    for n in range(kneser_ney.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discount(n, c):
        k = Counter(counts[n].values())
        if not (k[1] and k[2]):
            return 0.5
        y, r = k[1] / (k[1] + 2 * k[2]), min(c, 3)
        d = r - (r + 1) * y * k[r + 1] / k[r] if k[r] else 0.5
        return d if 0 < d < r else r / 2

    def p(gram):
        if not gram:
            return 1 / kneser_ney.SYMBOLS
        n = len(gram)
        own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        back = sum(discount(n, c) for c in own.values()) / total
        c = own.get(gram, 0)
        return (c - discount(n, c) if c else 0) / total + back * p(gram[1:])

    return p


def test_kneser_ney(spark, none):
    texts = ["abra cadabra", "a cat. a hat!", "the The\nthe the"]
    ids = [1, 2, 3]
    labels = spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id bigint, quality int, toxic int")
    model = kneser_ney.train(frame(spark, texts, ids), labels)
    learned = [t for i, t in zip(ids, texts) if not is_held_out(i, kneser_ney.LIMIT_FOLDS)]
    p, logs = brute_kneser_ney(learned), kneser_ney._logs(model.grams, model.weights)
    sums = np.exp(logs.astype(float)).reshape(-1, kneser_ney.SYMBOLS).sum(1)
    assert abs(sums - 1).max() < 1e-4
    for t in [*texts, "cab é%%"]:
        s = kneser_ney.symbols(t.encode(), kneser_ney._symbol_table())
        for i, key in enumerate(kneser_ney._grams(s).tolist()):
            gram = tuple(s[i : i + kneser_ney.ORDER].tolist())
            assert math.exp(logs[key]) == pytest.approx(p(gram), rel=1e-4)


def test_classifier_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(k for (k,) in rows(kneser_ney.classify(docs, labels), "kept"))
    assert kneser_ney.classify(none, labels).count() == 0
    labels = spark.createDataFrame([(i, 1, None) for i in (5, 6, 9, 10, 10, None)], labels.schema)
    renamed = docs.withColumnRenamed("source", "kept")
    kept = kneser_ney.accepted(renamed, labels)
    assert kept.columns == renamed.columns
    assert kneser_ney.classify(docs, labels).count() == len(TEXTS)


def test_repeat_marks():
    assert kneser_ney._marked(b"a b c") == b"a b c"
    assert kneser_ney._marked(b"The The x x\nx y") == b"The\x01 x\x01\n\x01 y"


# -- toxicity -------------------------------------------------------------------------


def test_grammar():
    classes = toxicity.Classes({"idio": 1.0})
    machine = toxicity.grammar()

    def kinds(text):
        sums = toxicity.matched(text, classes, machine)
        return {k: s for k, s in zip(toxicity.KINDS, sums) if s}

    assert kinds("that idiot there") == {toxicity.INSULT: 1.0}
    assert kinds("you idiots.") == {toxicity.AIMED: 1.5}
    assert kinds("idiot, you") == {toxicity.INSULT: 1.0}
    assert kinds("idiot you") == {toxicity.INSULT: 1.0, toxicity.LATER: 0.5}
    assert kinds("not an idiot") == {toxicity.NEGATED: 0.5}
    assert kinds("she said idiot") == {toxicity.REPORTED: 0.7}
    assert kinds("kill it") == {toxicity.THREAT: 1.0}
    assert kinds("nice words") == {}


def test_toxicity(spark, none):
    rng = random.Random(7)
    plain = ["".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(400)]
    bad = ["zork", "grumpf", "blech"]
    texts, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=60)
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "in", "os."])
        texts.append(" ".join(words))
        labels.append((i, 1, int(i % 5 == 0)))
    texts += [None, "", "ZORK!!"]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = rows(toxicity.judge(frame(spark, texts), table), "doc_id", "held_out", "score", "predicted")
    assert len(found) == len(texts) and all(0 <= s <= 1 for _, _, s, _ in found)
    wrong = [d for d, out, _, p in found if d < 400 and p != int(d % 5 == 0)]
    assert len(wrong) <= 2
    assert [p for d, _, _, p in sorted(found) if d >= 400] == [0, 0, 1]
    empty = table.filter("false")
    assert toxicity.judge(none, empty).count() == 0
    assert {p for (p,) in rows(toxicity.judge(frame(spark, texts[:3]), empty), "predicted")} == {0}


# -- edits ----------------------------------------------------------------------------


def test_edits(spark, docs, none):
    counts = token_edits.Counts(public_tokenizers.path(token_edits.TOKENIZER), public_tokenizers.PATTERN)
    rng = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "'", "'re", "9", ".", "é", "日本", "x y z", " we've\n\n  ok"]
    for trial in range(300):
        text = "".join(rng.choices(bits, k=rng.choice([0, 1, 5, 900 if trial % 20 == 0 else 30])))
        document = token_edits.Document(text, counts)
        for _ in range(6):
            at, out = rng.randint(0, len(text) + 2), rng.choice([0, 1, 5, 300])
            put = "".join(rng.choices(bits, k=rng.choice([0, 1, 4, 500 if trial % 50 == 0 else 2])))
            document.edit(at, out, put)
            at = min(at, len(text))
            text = text[:at] + put + text[at + out :]
            assert document.text == text and document.chars == len(text)
            assert document.tokens == len(counts._encode(text))
    edits = spark.createDataFrame(
        [(5, 2, 0, 3, "The"), (5, 1, 4, 3, "dog"), (9, 1, None, None, None), (99, 1, 0, 0, "x")],
        "doc_id bigint, seq int, start int, length int, text string",
    )
    found = {
        r["doc_id"]: r for r in token_edits.count(token_edits.with_edits(docs, edits), with_text=True).collect()
    }
    assert found[5]["text"].startswith("The dog sat") and found[5]["n_edits"] == 2
    assert found[5]["n_reencoded"] < 20 < found[5]["n_pretokens"]
    assert found[None]["n_tokens"] == 0 and found[9]["tokens_after"] == len(counts._encode(LONG))
    assert token_edits.count(token_edits.with_edits(none, edits)).count() == 0


# -- mixing ---------------------------------------------------------------------------


def test_apportion():
    assert mixing.apportion(np.array([53.0, 24, 23]), 10, np.full(3, 99)).tolist() == [6, 2, 2]
    rng = np.random.default_rng(4)
    for _ in range(100):
        targets, seats = rng.random(7) ** 4 * 100, int(rng.integers(0, 60))
        most = rng.integers(1, 30, 7)
        quota = np.zeros(7, int)
        for _ in range(min(seats, int(most.sum()))):
            quota[int(np.argmax(np.where(quota < most, targets / (2 * quota + 1), -1)))] += 1
        assert mixing.apportion(targets, seats, most).tolist() == quota.tolist()


def test_mix(docs, corpus, none):
    for df in (docs, corpus):
        given = rows(df, "doc_id", "source", "text")
        found = mixing.mix(df).collect()
        assert Counter((r["doc_id"], r["size"]) for r in found) == Counter(
            (d, len((t or "").encode().split())) for d, _, t in given
        )
        total = sum(r["size"] for r in found)
        targets = {r["source"]: r["target"] for r in found}
        sizes = {r["source"]: r["source_size"] for r in found}
        assert sum(targets.values()) == pytest.approx(min(total, 3 * sum(sizes.values())))
        order = sorted(targets, key=lambda s: (s is None, s or ""))
        rates = {s: targets[s] / (i % 3 + 1) for i, s in enumerate(order)}
        open_ = [rates[s] for s in order if targets[s] < 3 * sizes[s] * (1 - 1e-12)]
        assert all(r == pytest.approx(open_[0]) for r in open_)
        taken = Counter()
        for r in found:
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        for s in order:
            assert abs(taken[s] - targets[s]) <= 3 * mixing.BLOCK_WORDS
        texts = mixing.mixed_documents(df)
        assert texts.columns == df.columns
        words = Counter()
        for d, s, t in rows(texts, "doc_id", "source", "text"):
            words[s] += len(t.encode().split())
        assert words == Counter({s: n for s, n in taken.items() if n})
        assert sorted(rows(texts), key=str) == sorted(rows(mixing.mixed_documents(df)), key=str)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (200, 100)]
    found = dict(rows(components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100, 200: 100}
