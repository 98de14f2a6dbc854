import random

import pytest
from conftest import column

from corpuspack.operators import reconstruct as rc


def by_lines(text):
    """Files of a document, line by line."""
    files, path, in_code, fence, done = {}, None, False, 0, False
    for line in text.splitlines(keepends=True) if "\r" not in text else text.split("\n"):
        bare = line.rstrip("\n")
        ticks = len(bare) - len(bare.lstrip("`"))
        if not in_code and bare.startswith("### 📄"):
            path, done = bare[len("### 📄 ") :] or None, False
            if path:
                files[path] = ""
        elif not in_code and ticks >= 3:
            in_code, fence = True, ticks
        elif in_code and ticks == fence and bare == "`" * fence:
            in_code, path = False, None
        elif in_code and path and not done:
            if bare.startswith("*Binary file*") or bare.startswith("*Error"):
                done = True
            else:
                files[path] += line
    return files


def rebuilt(spark, blocks, **sizes):
    rows = [("d", n, t) for n, t in enumerate(blocks)]
    df = spark.createDataFrame(rows, "doc string, block bigint, text string")
    return dict(column(rc.reconstruct(df, **sizes), "path", "content"))


def test_binary_placeholder_gives_empty_file(spark):
    text = "### 📄 bin/file.bin\n\n```\n*Binary file*\nx\n```\n### 📄 none\n\n### 📄 b\n```c\nx\n```\n"
    assert rebuilt(spark, [text]) == {"bin/file.bin": "", "none": "", "b": "x\n"}


def test_nested_fences_and_fake_headings(spark):
    text = "### 📄 a\n````\n```\n### 📄 fake\n```\n````\n```\nignored\n```\n### 📄 a/b\n```\nend"
    assert rebuilt(spark, [text]) == {"a": "```\n### 📄 fake\n```\n", "a/b": "end"}


def test_other_line_ends_do_not_close_a_fence(spark):
    text = "### 📄 a\n```\nx\r``` ```\u0085```\ny\n```\n"
    assert rebuilt(spark, [text]) == {"a": "x\r``` ```\u0085```\ny\n"}


def test_later_heading_replaces_earlier(spark):
    text = "### 📄 a\n```\n1\n```\n### 📄 a\n```\n2\n```\n"
    assert rebuilt(spark, [text]) == {"a": "2\n"}


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_into_blocks_against_line_by_line(spark, seed):
    rnd = random.Random(seed)
    choices = ["### 📄 a", "### 📄 b/c", "```", "````", "```c", "x", "", "*Error y", "`````"]
    lines = [rnd.choice(choices) + "\n" for _ in range(60)]
    expected = by_lines("".join(lines))
    cuts = sorted(rnd.sample(range(1, 60), rnd.randint(1, 12)))
    blocks = ["".join(lines[a:b]) for a, b in zip([0, *cuts], [*cuts, 60])]
    assert rebuilt(spark, ["".join(lines)]) == expected
    assert rebuilt(spark, blocks) == expected
    assert rebuilt(spark, blocks, slice_blocks=seed % 3 + 1) == expected


def test_roundtrip_diff(spark):
    def df(**files):
        return spark.createDataFrame(
            [("r", p, t) for p, t in files.items()], "repo string, path string, content string"
        )

    diff = rc.roundtrip_diff(df(a="1", b="2", c="3"), df(a="1", b="x", d="4"))
    assert dict(column(diff, "path", "status")) == {
        "a": "same",
        "b": "changed",
        "c": "missing",
        "d": "extra",
    }


def raw_rebuilt(spark, blocks):
    rows = [("d", n, t) for n, t in enumerate(blocks)]
    df = spark.createDataFrame(rows, "doc string, block bigint, text binary")
    files = rc.reconstruct(df.withColumn("text", df["text"].cast("string")))
    return dict(column(files.withColumn("content", files["content"].cast("binary")), "path", "content"))


def test_bytes_that_are_not_utf8_come_back(spark):
    body = bytes(b for b in range(256) if b not in b"`") + b"\n\xe9t\xe9 \xff\xfe\x85 \x85\n"
    text = "### 📄 ä/b\n```\n".encode() + body + b"```\n"
    assert raw_rebuilt(spark, [text]) == {"ä/b": body}
    assert raw_rebuilt(spark, text.splitlines(keepends=True)[:2] + [body, b"```\n"]) == {"ä/b": body}
