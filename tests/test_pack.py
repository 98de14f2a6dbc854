import random

import numpy as np
import pytest
from conftest import column, files_df
from pyspark.sql import functions as F

from corpuspack import PackOptions, fixed
from corpuspack.operators import lint, ordering, split
from corpuspack.plans.pack import Pack
from corpuspack.plans.unpack import unpack_documents, unpack_parts
from corpuspack.sources import sinks
from corpuspack.sources.staging import fresh_path, shared_posix_path, stage

FILES = {
    "src/main.c": "int main(void) {\n}\n",
    "src.c": "a``` b",
    "a-b": "",
    "a/b": "## heading\n\n### 📄 fake heading\n",
    "logo.png": b"\x89PNG" + bytes(1148),
}

DOCUMENT = (
    fixed.SUMMARY_INTRO
    + "Token Size: 157\n\n"
    + """# Directory Documentation: r

## Structure

```
📁 a/
├── 📄 b
📄 a-b
📄 logo.png
📁 src/
├── 📄 main.c
📄 src.c
```

## Contents

### 📄 a/b

```
## heading

### 📄 fake heading
```

### 📄 a-b

```
```

### 📄 logo.png

*Binary file*
- Size: 1.12 KB

### 📄 src/main.c

```c
int main(void) {
}
```

### 📄 src.c

````c
a``` b
````

"""
)


def text_of(documents, repo="r"):
    rows = sorted((r.block, r.text) for r in documents.collect() if r.repo == repo)
    return "".join(t for _, t in rows)


def counted_tokens(mode):
    """Token total of FILES, piece by piece, from the texts that count."""
    from test_functions import approx

    labels = ["📁 a/", "📄 b", "📄 a-b", "📄 logo.png", "📁 src/", "📄 main.c", "📄 src.c"]
    texts = ["# Directory Documentation: ", "## Structure\n\n", "\n## Contents\n\n"]
    texts += [f"{label}\n" for label in labels]
    for path, content in FILES.items():
        texts.append(f"### 📄 {path}\n\n")
        if path == "logo.png":
            texts += ["*Binary file*\n", "- Size: 1.12 KB\n"]
        else:
            texts.append(content)
    if mode == "approx":
        return sum(approx(t.encode()) for t in texts)
    return sum(len(t.encode()) - t.count("!") for t in texts)


def test_document(spark):
    pack = Pack(files_df(spark, FILES))
    want = DOCUMENT.replace("Token Size: 157", f"Token Size: {counted_tokens('approx')}")
    assert text_of(pack.documents()) == want


def test_token_ledger_bytes(spark):
    pack = Pack(files_df(spark, FILES), PackOptions(token_mode="bytes"))
    row = pack.stats.first()
    assert row.total_tokens == counted_tokens("bytes") == row.total_size


def test_blocks_join_to_the_document(spark):
    whole = text_of(Pack(files_df(spark, FILES)).documents())
    small = Pack(files_df(spark, FILES), PackOptions(block_bytes=100)).documents()
    assert small.count() > 4
    assert text_of(small) == whole


def test_titles_and_names_come_from_the_directory(spark):
    repos = spark.createDataFrame([("r", "/home/me/proj")], "repo string, directory string")
    options = PackOptions(split=True)
    pack = Pack(files_df(spark, {"a": "x"}), options, repos=repos)
    part = pack.parts().first()
    assert part.file_name == "proj_documentation_part1.md"
    assert b"# Directory Documentation: proj\n\n" in bytes(part.body)
    assert fixed.SPLIT_NOTE.encode() in bytes(part.body)


def test_structure_only_has_no_contents(spark):
    pack = Pack(files_df(spark, FILES), PackOptions(structure_only=True))
    text = text_of(pack.documents())
    assert text.endswith("📄 src.c\n```\n") and "## Contents" not in text


def test_all_ignored_still_gives_a_document(spark):
    text = text_of(Pack(files_df(spark, {".gitignore": "*\n", "a": "x"})).documents())
    assert text.endswith("## Structure\n\n```\n```\n\n## Contents\n\n")


def test_order(spark):
    names = ["a", "a/b", "a-b", "src", "src/main.c", "src.c", "a/b/c", "a/b/d"]
    random.Random(1).shuffle(names)
    rows = [("r", n) for n in names] + [("s", "x")]
    df = spark.createDataFrame(rows, "repo string, path string")
    got = {(r, p): n for r, p, n in column(ordering.entry_order(df), "repo", "path", "position")}
    in_order = sorted(names, key=lambda n: n.encode().split(b"/"))
    assert got == {("r", n): i for i, n in enumerate(in_order, 1)} | {("s", "x"): 1}


def test_running_totals_over_many_slices(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aaab"), i, rnd.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {
        (r.g, r.k): (r.n, r.before)
        for r in ordering.running_totals(
            df, "g", ["k"], {"n": df.v * 0 + 1, "before": df.v}
        ).collect()
    }
    sums = {}
    for g, k, v in sorted(rows):
        n, total = sums.get(g, (0, 0))
        assert got[(g, k)] == (n, total)
        sums[g] = (n + 1, total + v)


# splitting


def all_candidates(text: bytes):
    """Line starts with their kinds, byte by byte."""
    marker = "\n### 📄".encode()
    pos, kind = [], []
    for i, b in enumerate(text):
        if b != 10:
            continue
        pos.append(i + 1)
        if i + 9 < len(text) and text[i : i + 9] == marker:
            kind.append(split.MARKER)
        elif (i + 2 < len(text) and text[i + 1] == 10) or (
            i + 5 < len(text) and text[i : i + 4] == b"\n## "
        ):
            kind.append(split.BREAK)
        else:
            kind.append(split.NEWLINE)
    return np.array(pos, dtype="int64"), np.array(kind, dtype="int64")


def test_look_alike_marker_does_not_cut():
    text = (
        "A" * 69
        + "\n### 📝 Wrong marker\nSome filler text to extend length\n\n### 📄 Correct marker\nEnd\n"
    ).encode()
    pos, kind = all_candidates(text)
    assert split.walk(pos, kind, len(text), 120, 100) == [120]


@pytest.mark.parametrize("seed", range(20))
def test_lines_of_a_piece_against_a_walk_over_its_lines(seed):
    rng = random.Random(seed)
    marker, section = fixed.FILE_MARKER.encode(), fixed.SECTION_MARKER.encode()
    bits = [marker, marker[:-1], section, section[:-1], b"\n", b"\n\n", b"x", "\u00e9".encode(), b"\xff"]
    data = b"".join(rng.choice(bits) for _ in range(rng.randrange(60)))
    start, total = rng.randrange(50), len(data) + rng.randrange(50, 60)
    expected, at = [], start
    lines = data.split(b"\n")
    for line in lines[:-1] if data.endswith(b"\n") else lines:
        kind = split.NEWLINE
        if line.startswith(marker) and at + len(marker) < total:
            kind = split.MARKER
        elif (not line and at + 1 < total) or (line.startswith(section) and at + 1 + len(section) < total):
            kind = split.BREAK
        expected.append((at, kind))
        at += len(line) + 1
    pos, kind = split.lines_of(np.frombuffer(data, np.uint8), start, total)
    assert list(zip(pos.tolist(), kind.tolist())) == expected


def test_many_lines_come_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(split, "LINES_HELD", 7)
    rows = [("r", 0, 200, "a\n" * 40), ("r", 80, 200, "\n" * 20), ("s", 0, 9, "")]
    placed = spark.createDataFrame(rows, "repo string, start bigint, doc_bytes bigint, text string")
    got = column(split._line_starts(placed, F.lit(True)), "repo", "pos")
    assert sorted(got) == sorted([("r", 2 * i) for i in range(40)] + [("r", 80 + i) for i in range(20)] + [("s", 0)])


def test_walk_prefers_markers_then_breaks_then_newlines():
    def cuts(text, limit):
        data = text.encode()
        return split.walk(*all_candidates(data), len(data), limit, 100)

    first = "x" * 300 + "\n### 📄 a\n" + "y" * 50 + "\n### 📄 b\n"
    assert cuts(first + "z" * 400, 500)[0] == 301
    assert cuts("x" * 300 + "\n\n" + "y" * 50 + "\n\n" + "z" * 400, 500)[0] == 353
    assert cuts("x" * 400 + "\n" + "y" * 400, 500)[0] == 401
    assert cuts("x" * 200 + "\n" + "y" * 800, 500)[0] == 500
    assert cuts("x" * 5000, 100) == [100 * n for n in range(1, 50)]


def random_files(seed, big):
    rnd = random.Random(seed)
    lines = ["", "text", "## h", "### 📄 fake", "```", "long " * 30, "ünï", "````"]
    files = {}
    for i in range(rnd.randint(5, 30)):
        n = rnd.randint(0, 200 if big and rnd.random() < 0.3 else 12)
        body = "\n".join(rnd.choice(lines) for _ in range(n))
        folder = rnd.choice(["", "a/", "a/b/", "c/"])
        files[f"{folder}f{i}.{rnd.choice(['md', 'c', 'txt', 'png'])}"] = body
    return files


@pytest.mark.parametrize("seed,limit", [(1, 450), (2, 1000), (4, 150), (5, 801)])
def test_cuts_and_parts_against_brute_force(spark, seed, limit):
    """Pruned candidates must give the very cuts of a walk over all line starts."""
    files = random_files(seed, big=True)
    options = PackOptions(split=True, limit_mb=limit / fixed.MEGABYTE + 1e-9, max_splits=25)
    assert options.limit_bytes == limit
    pack = Pack(files_df(spark, files), options)
    data = text_of(pack.documents()).encode()
    pos, kind = all_candidates(data)
    cuts = split.walk(pos, kind, len(data), limit, 25)
    assert pack.split_plan.first().cuts == cuts

    got = {r.pos: r.kind for r in pack.split_candidates().collect()}
    assert got == {p: split.KIND_NAMES[k] for p, k in zip(pos.tolist(), kind.tolist())}

    edges = [0, *cuts, len(data)]
    parts = pack.parts().orderBy("part").collect()
    assert len(parts) == len(cuts) + 1
    for i, part in enumerate(parts):
        body = data[edges[i] : edges[i + 1]]
        if i > 0:
            body = f"---\n**Continued from part {i}**\n\n".encode() + body
        if i < len(cuts) - 1:
            body += f"\n\n---\n**Continued in part {i + 2}**\n".encode()
        assert (part.start, part.end, bytes(part.body)) == (edges[i], edges[i + 1], body)
        assert part.file_name == f"r_documentation_part{i + 1}.md"


@pytest.mark.parametrize("slice_cuts", [1, 3, 1000])
def test_cuts_without_a_bound(spark, slice_cuts):
    """Slices are entered where the ones before end, also where no line start is in reach."""
    files = random_files(3, big=True) | {"a/long.txt": "y" * 9000 + "\nend"}
    pack = Pack(files_df(spark, files), PackOptions(split=True, limit_mb=700 / fixed.MEGABYTE))
    data = text_of(pack.documents()).encode()
    pos, kind = all_candidates(data)
    cuts = split.walk(pos, kind, len(data), pack.options.limit_bytes, len(data))
    assert len(cuts) > 12
    plan = split.split_plan(
        pack._texts, pack.offsets, pack._split_docs, pack.options.limit_bytes, None, slice_cuts
    )
    assert plan.first().cuts == cuts


def test_rounds_do_not_grow_with_the_document(spark, monkeypatch):
    """All slices are worked out at once, also if walks from elsewhere never meet."""
    files = {f"f{i:04d}.py": f"x = {i}\n" * 40 + "\n" for i in range(600)}
    rounds = {}
    ways = split._ways
    for n in (60, 600):
        some = {k: v for k, v in files.items() if int(k[1:5]) < n}
        pack = Pack(files_df(spark, some), PackOptions(split=True, limit_mb=900 / fixed.MEGABYTE))
        data = text_of(pack.documents()).encode()
        pos, kind = all_candidates(data)
        made = []
        monkeypatch.setattr(split, "_ways", lambda *a: made.append(1) or ways(*a))
        plan = split.split_plan(
            pack._texts, pack.offsets, pack._split_docs, pack.options.limit_bytes, None, 5
        )
        assert plan.first().cuts == split.walk(pos, kind, len(data), pack.options.limit_bytes, None)
        rounds[n] = len(made), len(plan.first().cuts)
    assert rounds[600][1] > 8 * rounds[60][1] and rounds[600][0] == rounds[60][0] == 1


def latin_files():
    prose = "Où est le café où l'été dernier nous étions? Là-bas.\n".encode("latin-1")
    return {
        f"d/f{n}.txt": b"### \xf0\x9f\x93\x84 x\n" * (n % 2) + prose * (9 * n) + b"\xe9 end\n"
        for n in range(1, 7)
    }


def test_bytes_that_are_not_utf8_are_cut_and_kept(spark):
    files = latin_files()
    df = files_df(spark, files)
    pack = Pack(df, PackOptions(split=True, limit_mb=900 / fixed.MEGABYTE))
    assert {k for (k,) in column(_kinds(df), "kind")} == {"text"}
    (row,) = pack.documents().withColumn("text", F.col("text").cast("binary")).collect()
    data = bytes(row.text)
    assert all(text in data for text in files.values())
    pos, kind = all_candidates(data)
    cuts = split.walk(pos, kind, len(data), pack.options.limit_bytes, len(data))
    assert pack.split_plan.first().cuts == cuts
    assert sum(data[c - 1 : c] == b"\n" for c in cuts) == len(cuts) > 5

    path = fresh_path(spark, "test-latin")
    sinks.write_pack(pack.placed, path, 700)
    import glob

    chunks = sorted(glob.glob(f"{shared_posix_path(path)}/repo=r/block=*/part-*"))
    assert b"".join(open(c, "rb").read() for c in chunks) == data
    for back in (unpack_documents(pack.documents()), unpack_parts(pack.parts())):
        raw = back.withColumn("content", F.col("content").cast("binary"))
        assert dict(column(raw, "path", "content")) == files


def test_repeated_paths_are_refused(spark):
    df = files_df(spark, {"a.txt": "1"})
    with pytest.raises(ValueError, match="a.txt"):
        Pack(df.unionByName(df)).documents()


@pytest.mark.parametrize("seed", [6, 7])
def test_round_trip(spark, seed):
    files = random_files(seed, big=True)
    expected = {
        p: "" if p.endswith(".png") or not t else t + ("" if t.endswith("\n") else "\n")
        for p, t in files.items()
    }
    df = files_df(spark, files)
    sniffed = dict(column(_kinds(df), "path", "kind"))
    expected = {p: "" if sniffed[p] == "binary" else t for p, t in expected.items()}
    whole = unpack_documents(Pack(df, PackOptions(block_bytes=300)).documents())
    assert dict(column(whole, "path", "content")) == expected
    # hard cuts inside lines, several blocks per part
    options = PackOptions(split=True, limit_mb=190 / fixed.MEGABYTE, block_bytes=60)
    parts = stage(Pack(df, options).parts(), "test-parts")
    assert dict(column(unpack_parts(parts), "path", "content")) == expected


def _kinds(df):
    from corpuspack.operators.pieces import routed_files

    return routed_files(df)


def test_small_file_stays_in_one_part(spark):
    files = {"a.txt": "tiny file\n", "big.txt": "".join(f"line {i}\n" for i in range(10_000))}
    pack = Pack(files_df(spark, files), PackOptions(split=True, limit_mb=0.01))
    bodies = [bytes(b).decode() for (b,) in column(pack.parts(), "body")]
    assert 5 < len(bodies) <= 60
    assert sum("tiny file\n```" in b for b in bodies) == 1


def test_oversize_policies(spark):
    files = files_df(spark, {"a.txt": "x\n" * 2000}, "big").unionByName(
        files_df(spark, {"a.txt": "x"}, "small")
    )

    def repos(action):
        options = PackOptions(limit_mb=0.002, on_oversize=action)
        pack = Pack(files, options)
        rows = pack.documents().collect()
        return {r.repo: r.text for r in rows}, pack

    kept, _ = repos("keep")
    assert set(kept) == {"big", "small"}
    dropped, _ = repos("drop")
    assert set(dropped) == {"small"} and dropped["small"] == kept["small"]
    tree, pack = repos("structure_only")
    assert kept["big"].startswith(tree["big"]) and tree["big"].endswith("a.txt\n```\n")
    assert dict(column(pack.policy, "repo", "action")) == {
        "big": "structure_only",
        "small": "whole",
    }
    _, pack = repos("split")
    assert {r for (r,) in column(pack.parts(), "repo")} == {"big"}
    assert "Note:" not in kept["big"]


def test_limits():
    assert PackOptions(limit_mb=0).limit_bytes == 18 * 1024 * 1024
    assert PackOptions(limit_mb=0.02).limit_bytes == 20971
    with pytest.raises(ValueError):
        PackOptions(on_oversize="ask")


# sinks


def test_write_pack_replaces_and_keeps_order(spark):
    path = fresh_path(spark, "test-pack")
    for files in ({"old.txt": "old\n" * 400}, FILES):
        pack = Pack(files_df(spark, files))
        sinks.write_pack(pack.placed, path, 700)
    text = text_of(pack.documents())
    import glob

    chunks = sorted(glob.glob(f"{shared_posix_path(path)}/repo=r/block=*/part-*"))
    assert len(chunks) > 1
    assert "".join(open(c, encoding="utf-8").read() for c in chunks) == text


def test_export_refuses_unsafe_paths(spark):
    root = shared_posix_path(fresh_path(spark, "test-tree"))
    files = files_df(spark, {"ok/a.txt": "1", "../b": "2", "/c": "3", "x/../../d": "4"})
    written = sinks.export_files(files, root).collect()
    assert [(r.path, r.n_bytes) for r in written] == [("ok/a.txt", 1)]
    assert open(f"{root}/r/ok/a.txt").read() == "1"


def test_lint(spark):
    code = """/** doc */
// more
int f(int a) {
}

int g(void) {
struct x f(y) {
/** doc */

int h(void) {
#include <x>
char *k(a, b)  {
 int indented(void) {
int proto(void);
/** d
 * more
 */
 # skipped
int m() {
int n() {
"""
    got = column(lint.lint_missing_docs(files_df(spark, {"a.c": code})), "line_no")
    assert sorted(got) == [(6,), (10,), (12,), (20,)]
