"""Files in chunks give the documents that whole files give."""

import io
import random

import pytest
from conftest import column, files_df

from corpuspack import PackOptions
from corpuspack.operators import chunks
from corpuspack.plans import unpack
from corpuspack.plans.pack import Pack
from corpuspack.sources import files as tree
from corpuspack.sources import sinks

SIZE = chunks.LEAST_BYTES


def some_files(seed=1):
    rng = random.Random(seed)
    parts = ["word", "`", "````", " ", "\n", "\n\n", "## h", "### 📄 x", "é", "1!", "long" * 30, "`" * 50, "a_b", "\r\n"]
    files = {f"d/f{i}.py": "".join(rng.choices(parts, k=rng.randint(0, 60))) for i in range(25)}
    files |= {
        "empty.c": "",
        "line.txt": "x" * 200,
        "ticks.md": "a" * 20 + "`" * 100 + "\n",
        "end.md": "b\n" * 30 + "`" * 40,
        "bin.dat": bytes(range(256)) * 4,
        "late.dat": b"text " * 300 + bytes(2000),
        "pic.png": "text " * 20,
        ".gitignore": "# " + "long comment " * 5 + "\n*.log\n",
        "x.log": "ignored\n" * 20,
    }
    return files


def both(spark, files, **options):
    whole = files_df(spark, files)
    vocab = options.pop("vocab", None)
    return [
        Pack(f, PackOptions(**options), vocab)
        for f in (whole, chunks.cut_contents(whole, SIZE))
    ]


def test_cut_stream():
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choices(b"ab\n", [8, 8, rng.random()], k=rng.randint(0, 300)))
        parts = list(chunks.cut_stream(io.BytesIO(data), SIZE))
        assert b"".join(p[4] for p in parts) == data
        assert [p[0] for p in parts] == list(range(len(parts))) and [p[2] for p in parts[:-1]] == [False] * (len(parts) - 1)
        for chunk, start, _, line, content in parts:
            assert data[start : start + len(content)] == content and len(content) <= SIZE
            begin = data.rfind(b"\n", 0, start) + 1
            first = next(p for p in reversed(parts[: chunk + 1]) if p[1] <= begin)
            assert line == first[0]
            assert begin == start or start - begin >= SIZE  # enough of a line in one chunk
    with pytest.raises(ValueError):
        next(chunks.cut_stream(io.BytesIO(b""), SIZE - 1))


def test_documents_are_equal(spark):
    packs = both(spark, some_files())
    a, b = (dict(column(p.documents(), "repo", "text")) for p in packs)
    assert a == b
    a, b = (p.stats.collect() for p in packs)
    assert a == b


def test_totals_by_vocabulary_and_bytes(spark):
    words = ["word", "long", "wo", "rd", "long" * 30, "a", "b", "x" * 200, "`"]
    rows = [(bytes([b]), b, False) for b in range(33, 127)]
    rows += [(w.encode(), 1000 + i, False) for i, w in enumerate(words) if len(w) > 1]
    rows.append((b"<|x|>", 5000, True))
    vocab = spark.createDataFrame(rows, "token binary, id int, is_special boolean")
    files = some_files(3) | {"s.txt": "<|x|>" + "y" * 11 + "<|x|>"}
    a, b = (p.stats.collect() for p in both(spark, files, vocab=vocab))
    assert a == b
    a, b = (p.stats.collect() for p in both(spark, files, token_mode="bytes"))
    assert a == b


def test_parts_and_unpacking(spark, tmp_path):
    files = some_files(4)
    packs = both(spark, files, split=True, limit_mb=0.0004, block_bytes=150)
    # an offset in one is an offset in the other
    assert sorted(packs[0].split_candidates().collect()) == sorted(packs[1].split_candidates().collect())
    assert sorted(packs[0].split_points().collect()) == sorted(packs[1].split_points().collect())
    blocks = packs[1].documents().collect()
    assert all(r["text"].endswith("\n") for r in blocks)
    rebuilt = [
        sorted(column(unpack.unpack_documents(p.documents()), "path", "content")) for p in packs
    ]
    rebuilt.append(sorted(column(unpack.unpack_parts(packs[1].parts()), "path", "content")))
    assert rebuilt[0] == rebuilt[1] == rebuilt[2] and len(rebuilt[0]) == len(files) - 1
    for i, pack in enumerate(packs):
        sinks.write_pack(pack.placed, f"{tmp_path}/{i}", 150)
    schema = "value string, repo string, block string"
    written = [spark.read.schema(schema).text(f"{tmp_path}/{i}").select("value") for i in (0, 1)]
    assert sorted(written[0].collect()) == sorted(written[1].collect())


def test_file_of_many_chunks_from_a_tree(spark, tmp_path):
    """Byte for byte what a whole file gives; what cannot be read to its end is an error."""
    data = ("hello big wörld " * 50 + "\n") * 40
    (tmp_path / "a.md").write_text(data + "`" * 7)
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo string, root string")
    entries = tree.scan_tree(roots)
    files = tree.read_contents(entries, 64)
    assert files.count() > 100
    document = "".join(r["text"] for r in Pack(files, entries=entries.select("repo", "path", "is_dir", "depth")).documents().collect())
    assert f"````````markdown\n{data}```````\n````````\n" in document


def test_kinds(spark):
    cut = chunks.cut_contents(files_df(spark, some_files()), SIZE)
    failed = spark.createDataFrame(
        [("r", "half.txt", 0, 0, False, 0, b"x" * 16, 99), ("r", "half.txt", 1, 16, True, 0, None, 99)], chunks.CHUNKS
    )
    facts = chunks.file_facts(cut.unionByName(failed), "approx")
    kinds = dict(column(facts, "path", "f_kind"))
    assert kinds["half.txt"] == "error" and kinds["bin.dat"] == "binary" and kinds["pic.png"] == "binary"
    assert kinds["late.dat"] == "text"  # only its start is looked at
    fences = dict(column(facts, "path", "f_fence"))
    assert fences["ticks.md"] == 101 and fences["end.md"] == 41 and fences["line.txt"] == 3
