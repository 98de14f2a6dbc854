import pytest
from pyspark.sql import functions as F

from corpuspack.functions import paths, text


def evaluate(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def check(spark, cases, expr, kind="string"):
    rows = spark.createDataFrame([(v,) for v, _ in cases], f"v {kind}")
    got = [r[1] for r in rows.select("v", expr(F.col("v")).alias("x")).collect()]
    assert got == [want for _, want in cases]


def test_language(spark):
    cases = [
        ("Makefile", "make"),
        ("sub/GNUmakefile", "make"),
        ("test.c", "c"),
        ("header.h", "c"),
        ("HEADER.H", "c"),
        ("script.py", "python"),
        ("unknown.xyz", ""),
        ("noext", ""),
        (".md", ""),
        ("dir.py/file", ""),
        ("dir/.x.py", "python"),
    ]
    check(spark, cases, paths.language_of)


def test_text_by_extension(spark):
    cases = [("a.png", False), ("a.JPG", False), ("png", True), ("a.png/b", True), ("a.txt", True)]
    check(spark, cases, paths.text_by_extension)


def test_names(spark):
    check(
        spark,
        [
            ("/some/path", "path_documentation.md"),
            ("/some/path/", "path_documentation.md"),
            ("x", "x_documentation.md"),
            ("", "directory_documentation.md"),
        ],
        paths.default_output_name,
    )
    check(spark, [("/a/b", "b"), ("/a/b/", ""), ("b", "b")], paths.title_of)
    check(
        spark,
        [("doc.md", "doc_part3.md"), ("a.b/doc", "a.b/doc_part3"), ("a.b.md", "a.b_part3.md")],
        lambda c: paths.part_file_name(c, F.lit(3)),
    )


def test_human_size(spark):
    cases = [
        (0, "0.00 B"),
        (1023, "1023.00 B"),
        (1024, "1.00 KB"),
        (1152, "1.12 KB"),  # a tie goes to the even digit
        (1157, "1.13 KB"),
        (1024**2, "1.00 MB"),
        (5 * 1024**5, "5120.00 TB"),
    ]
    check(spark, cases, text.human_size, "bigint")


def test_human_size_like_printf(spark):
    values = [n for k in range(5) for n in range(1024**k, 1024**k * 3, max(1, 1024**k // 40))]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    for row in rows.select("v", text.human_size(F.col("v")).alias("s")).collect():
        size, unit = float(row.v), 0
        while size >= 1024 and unit < 4:
            size, unit = size / 1024, unit + 1
        assert row.s == f"{size:.2f} {['B', 'KB', 'MB', 'GB', 'TB'][unit]}"


def test_backticks(spark):
    check(
        spark,
        [("Here are ```` backticks", 4), ("none", 0), ("` `` `", 2), ("", 0)],
        text.max_backtick_run,
    )
    check(spark, [("``", 3), ("```", 4), ("x", 3)], text.fence_len)


def test_sniff_binary(spark):
    cases = [
        (bytes(100), True),
        (b"This is a simple text file.", False),
        (b"", False),
        (None, True),
        (b"a" * 85 + bytes(15), False),
        (b"a" * 84 + bytes(16), True),
        (b"a" * 1024 + bytes(5000), False),
        ("ä".encode() * 600, True),
    ]
    check(spark, cases, text.sniff_binary, "binary")


def approx(data: bytes) -> int:
    units, in_word = 0, False
    for b in data:
        word = chr(b).isascii() and (chr(b).isalnum() or b == 95)
        units += (word and not in_word) or (not word and b not in b" \t\n\x0b\f\r")
        in_word = word
    return int(units * 1.3)


def test_tokens_approx_by_brute_force(spark):
    cases = [b"", b"one two", b"a_b+c(d)", "naïve café\n\n".encode(), bytes(range(256)), b"x" * 99]
    rows = spark.createDataFrame([(c,) for c in cases], "v binary")
    got = [r[0] for r in rows.select(text.count_tokens_approx(F.col("v"))).collect()]
    assert got == [approx(c) for c in cases]


def test_tokens_bytes(spark):
    check(spark, [("abc!", 3), ("é!", 2), ("", 0)], text.count_tokens_bytes)


@pytest.mark.parametrize("sample", ["int main() { return 0; }", "Hello, world! " * 20, "x"])
def test_token_bounds(spark, sample):
    """No count exceeds the bytes, and the rough estimate is of the right order."""
    tokens = evaluate(spark, sample, text.count_tokens_approx)
    assert 0 < tokens <= len(sample)


def test_pretokens(spark):
    got = evaluate(spark, "ab, é9\n_c\x0b", text.pretokens)
    assert got == ["ab", ",", " ", "é9", "\n", "_", "c", "\x0b"]


def test_fallback_chunks(spark):
    cases = [
        ("abcd", ["abcd"]),
        ("12", ["12"]),
        ("12345", ["1", "2", "3", "4", "5"]),
        ("abcdefg", ["abcd", "efg"]),
        ("abcdefghij", ["abc", "def", "ghi", "j"]),
        ("a" * 17, ["aa"] * 8 + ["a"]),
        ("Ã©t", ["Ã", "©", "t"]),
    ]
    check(spark, cases, text.fallback_chunks)


def test_base64_has_no_line_breaks(spark):
    long = "x" * 500
    assert "\n" not in evaluate(spark, long, text.to_base64)
    back = evaluate(spark, long, lambda c: text.from_base64(text.to_base64(c)))
    assert bytes(back) == long.encode()
