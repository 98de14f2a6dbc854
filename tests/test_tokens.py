import random
import re

import pytest
from conftest import column

from corpuspack.operators import merges, tokens
from corpuspack.sources import vocab as vocab_source
from corpuspack.sources.staging import stage

WORDS = ["the", "ab", "abcd", "ing", "12", "é", "\n", "quick", "qu", "ic", "k"]
PUNCT = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
SPACE = set(b" \t\n\x0b\f\r")


def vocab_df(spark, missing=b"!z"):
    rows = [(bytes([b]), b, False) for b in range(256) if b not in missing]
    rows += [(w.encode(), 300 + i, False) for i, w in enumerate(WORDS) if len(w.encode()) > 1]
    rows += [(b"<|end|>", 900, True), (b"quick", 901, True)]
    return spark.createDataFrame(rows, "token binary, id int, is_special boolean")


def encode(data: bytes, table, special, ranks=None):
    """Ids of a text, token by token."""
    if data in special:
        return [special[data]]
    units, run = [], b""
    for b in data:
        if b in PUNCT or b in SPACE:
            units += [run] if run else []
            units.append(bytes([b]))
            run = b""
        else:
            run += bytes([b])
    units += [run] if run else []
    out = []
    for unit in units:
        if unit in special:
            out.append(special[unit])
            continue
        if ranks is None and unit in table:
            out.append(table[unit])
            continue
        if ranks is not None:
            chunks = merges.merge_with_heap(unit, ranks)
        elif any(b > 127 for b in unit):
            chunks = [bytes([b]) for b in unit]
        elif len(unit) <= 4:
            chunks = [unit]
        elif unit[:1].isdigit():
            chunks = [bytes([b]) for b in unit]
        else:
            k = 4 if len(unit) <= 8 else 3 if len(unit) <= 16 else 2
            chunks = [unit[i : i + k] for i in range(0, len(unit), k)]
        for chunk in chunks:
            if chunk in table:
                out.append(table[chunk])
            else:
                out += [table[bytes([b])] for b in chunk if bytes([b]) in table]
    return out


def tables(df):
    rows = df.collect()
    return (
        {bytes(r.token): r.id for r in rows if not r.is_special},
        {bytes(r.token): r.id for r in rows if r.is_special},
    )


def sample_texts(n=60):
    rnd = random.Random(3)
    parts = [*WORDS, "zebra!", "quickly", "abcdabcd", "1234567", "ünïcode", "x" * 20, " ", ", ", "_"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]
    return [*texts, "<|end|>", "quick", "<|end|> ", "", "\x00z"]


def test_encode_count_and_histogram_against_brute_force(spark):
    df = vocab_df(spark)
    table, special = tables(df)
    texts = sample_texts()
    expected = {i: encode(t.encode(), table, special) for i, t in enumerate(texts)}
    data = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    vocabulary = tokens.Vocabulary(df)

    ids = dict(column(tokens.encode_ids(data, ["k"], "t", vocabulary), "k", "ids"))
    assert {k: v for k, v in ids.items() if v} == {k: v for k, v in expected.items() if v}
    counts = dict(column(tokens.count_tokens_vocab(data, ["k"], "t", vocabulary), "k", "tokens"))
    assert {k: counts.get(k, 0) for k in expected} == {k: len(v) for k, v in expected.items()}

    histogram = {}
    for v in expected.values():
        for i in v:
            histogram[i] = histogram.get(i, 0) + 1
    assert dict(column(tokens.token_histogram(data, "t", vocabulary), "id", "n")) == histogram


def test_tokens_never_exceed_bytes(spark):
    texts = sample_texts()
    data = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    counts = tokens.count_tokens_vocab(data, ["k"], "t", tokens.Vocabulary(vocab_df(spark)))
    for k, n in column(counts, "k", "tokens"):
        assert n <= len(texts[k].encode())


def test_large_vocabulary_is_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tokens, "small_enough", lambda table: False)
    df = vocab_df(spark)
    table, special = tables(df)
    data = spark.createDataFrame([(0, "the quick zebra")], "k int, t string")
    ids = tokens.encode_ids(data, ["k"], "t", tokens.Vocabulary(df))
    assert column(ids, "ids") == [(encode(b"the quick zebra", table, special),)]


def test_merges_against_brute_force(spark):
    rows = [(b"q", b"u", 5), (b"i", b"c", 1), (b"qu", b"ic", 7), (b"a", b"b", 2), (b"ab", b"c", 2)]
    table_df = spark.createDataFrame(rows, "first binary, second binary, rank int")
    ranks = {(a, b): r for a, b, r in rows}
    assert merges.merge_with_heap(b"quick", ranks) == [b"quic", b"k"]
    assert merges.merge_with_heap(b"ababc", ranks) == [b"ab", b"abc"]
    assert merges.merge_with_heap(b"aaa", {(b"a", b"a"): 1}) == [b"aa", b"a"]
    df = vocab_df(spark)
    table, special = tables(df)
    texts = sample_texts(30)
    data = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    look_up = merges.dictionary_ids(table_df, tokens.Vocabulary(df))
    ids = tokens.encode_ids(data, ["k"], "t", tokens.Vocabulary(df), look_up)
    expected = {i: encode(t.encode(), table, special, ranks) for i, t in enumerate(texts)}
    got = {k: v for k, v in column(ids, "k", "ids") if v}
    assert got == {k: v for k, v in expected.items() if v}
    counts = dict(column(tokens.count_tokens_vocab(data, ["k"], "t", tokens.Vocabulary(df), look_up), "k", "tokens"))
    assert {k: n for k, n in counts.items() if n} == {k: len(v) for k, v in got.items()}


def rescanned(token, ranks):
    """Look for the least pair again after every merge of it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while True:
        ranked = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not ranked:
            return parts
        best, out = min(ranked)[2], []
        for part in parts:
            if out and (out[-1], part) == best:
                out[-1] += part
            else:
                out.append(part)
        parts = out


@pytest.mark.parametrize("short", [0, 32])
def test_merging_dictionaries(spark, short):
    """In rounds of joins and with a heap, against looking for each pair again."""
    rng = random.Random(9)
    made, rows = [b"a", b"b", b"c", b"\xe9"], []
    for rank in rng.sample(range(40), 30):
        pair = rng.choice(made), rng.choice(made)
        rows.append((*pair, rank // 2))  # some ranks twice
        made.append(b"".join(pair))
    ranks = {}
    for a, b, r in rows:
        ranks[a, b] = min(r, ranks.get((a, b), r))
    units = {"".join(rng.choices("abc\xe9d", k=rng.randint(1, 31))) for _ in range(400)} | {"a" * k for k in range(1, 30)}
    df = spark.createDataFrame([(u,) for u in sorted(units)], "unit string")
    table = spark.createDataFrame(rows, "first binary, second binary, rank int")
    found = dict(column(merges.merged_units(df, table, short), "unit", "chunks"))
    assert found == {u: [p.decode("latin-1") for p in rescanned(u.encode("latin-1"), ranks)] for u in units}


def test_counting_with_merges_takes_few_rounds(spark, monkeypatch):
    """However long pretokens are; and of each text only sums and rare pretokens are staged."""
    staged = []

    def noted(df, name):
        staged.append((name, df.columns))
        return stage(df, name)

    monkeypatch.setattr(tokens, "stage", noted)
    monkeypatch.setattr(merges, "stage", noted)
    made = [(b"a" * k, b"a", k) for k in range(1, 20)]
    table = spark.createDataFrame(made, "first binary, second binary, rank int")
    df = vocab_df(spark)
    regular, special = tables(df)
    texts = ["aaa a" + "a" * k for k in range(20)]
    data = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    look_up = merges.dictionary_ids(table, tokens.Vocabulary(df))
    counts = dict(column(tokens.count_tokens_vocab(data, ["k"], "t", tokens.Vocabulary(df), look_up), "k", "tokens"))
    ranks = {(a, b): r for a, b, r in made}
    assert counts == {k: len(encode(t.encode(), regular, special, ranks)) for k, t in enumerate(texts)}
    assert [name for name, columns in staged if "k" in columns] == ["sums"]
    assert sum(name == "merging" for name, _ in staged) <= 5


def test_long_pretokens_are_not_scanned_again():
    ranks = {(b"a", b"b"): 1, (b"ab", b"ab"): 2, (b"abab", b"abab"): 3}
    assert merges.merge_with_heap(b"ab" * 100_000, ranks) == [b"abababab"] * 25_000


@pytest.mark.parametrize("small", [True, False])
def test_blocks_of_ids(spark, monkeypatch, small):
    """Texts of many blocks have the ids they have as a whole."""
    monkeypatch.setattr(tokens, "small_enough", lambda table: small)
    monkeypatch.setattr(tokens, "HOT_UNITS", 3)
    df = vocab_df(spark)
    table, special = tables(df)
    texts = sample_texts(20)
    data = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    vocabulary = tokens.Vocabulary(df)
    expected = {i: encode(t.encode(), table, special) for i, t in enumerate(texts)}
    got = {i: [] for i in expected}
    for k, start, ids in sorted(column(tokens.encode_blocks(data, ["k"], "t", vocabulary, block_units=3), "k", "start", "ids")):
        assert start == len(got[k]) and 0 < len(ids) <= 4 * 3 * 64
        got[k] += [int.from_bytes(ids[i : i + 4], "big") for i in range(0, len(ids), 4)]
    assert got == expected
    counts = dict(column(tokens.count_tokens_vocab(data, ["k"], "t", vocabulary), "k", "tokens"))
    assert {k: n for k, n in counts.items() if n} == {k: len(v) for k, v in expected.items() if v}


def test_arrays_of_texts_that_occur_once_are_made_in_place(spark):
    """No generated or sorted row for each token; repeated and null keys are one array by place."""
    df = vocab_df(spark)
    table, special = tables(df)
    texts = sample_texts(20)
    data = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = tokens.encode_ids(data, ["k"], "t", tokens.Vocabulary(df))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(None, "ab zebra"), (None, "ab"), (1, "12345"), (1, "the\n"), (1, None), (2, ""), (3, None), (4, "\x00z")]
    data = spark.createDataFrame(rows, "k int, t string")
    want = {}
    for k, t in rows:
        for pos, unit in enumerate(re.findall(r"\w+|\W", t or "")):
            ids = encode(unit.encode(), table, special)
            chunks = [[i] for i in ids]
            want.setdefault(k, []).extend((pos, c, i) for c, i in enumerate(chunks))
    want = {k: [i for *_, ids in sorted(v) for i in ids] for k, v in want.items()}
    found = tokens.encode_ids(data, ["k"], "t", tokens.Vocabulary(df))
    assert dict(column(found, "k", "ids")) == {**want, 4: encode(b"\x00z", table, special)}


def test_frequent_pretokens_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(tokens, "small_enough", lambda table: False)
    data = spark.createDataFrame([(i, "a a b") for i in range(50)], "k int, t string")
    plan = tokens.count_tokens_vocab(data, ["k"], "t", tokens.Vocabulary(vocab_df(spark)))
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().toString()


def test_load_vocab(spark):
    lines = [
        "IQ== 0",
        "IQ== 4",
        "YWI= +7x",
        "YWI=  7",
        "YWI=",
        "YWI= x",
        "YWI= 99999999999",
        "PHxlbmRvZnRleHR8Pg== 100257",
        "PHxmaW1fcHJlZml4fD4= 5",
        "Yw== 9 ",
        "",
    ]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    loaded, rejects = vocab_source.load_vocab(df)
    assert sorted((bytes(t), i, s) for t, i, s in column(loaded, "token", "id", "is_special")) == [
        (b"!", 4, False),
        (b"<|endoftext|>", 100257, True),
        (b"<|fim_prefix|>", 5, False),
        (b"ab", 7, False),
        (b"c", 9, False),
    ]
    assert sorted(column(rejects, "value", "reason")) == [
        ("", "malformed"),
        ("YWI=", "malformed"),
        ("YWI=  7", "malformed"),
        ("YWI= 99999999999", "id out of range"),
        ("YWI= x", "bad id"),
    ]


def test_read_vocab_lines(spark, tmp_path):
    (tmp_path / "v.txt").write_text('IQ== 0\nIg== 1\n"x" 2\n')
    read = vocab_source.read_vocab_lines
    path = str(tmp_path)
    assert sorted(column(read(spark, path), "value")) == [('"x" 2',), ("IQ== 0",), ("Ig== 1",)]
    assert sorted(column(read(spark, path, True), "value")) == [('"x" 2',), ("Ig== 1",)]


def test_token_mode_vocab_in_a_pack(spark):
    from conftest import files_df

    from corpuspack import PackOptions
    from corpuspack.plans.pack import Pack

    df = vocab_df(spark)
    table, special = tables(df)
    pack = Pack(files_df(spark, {"a.txt": "the quick"}), PackOptions(token_mode="vocab"), df)
    counted = [
        "# Directory Documentation: ",
        "## Structure\n\n",
        "📄 a.txt\n",
        "\n## Contents\n\n",
        "### 📄 a.txt\n\n",
        "the quick",
    ]
    expected = sum(len(encode(t.encode(), table, special)) for t in counted)
    assert pack.stats.first().total_tokens == expected
