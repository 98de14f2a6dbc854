import re

import pytest
from conftest import column, files_df

from corpuspack import PackOptions
from corpuspack.operators import entries as entries_op
from corpuspack.operators import ignore
from corpuspack.plans.pack import Pack

RULES = ["*.log", "!important.log", "build/", "temp*", "!temp_keep.txt", "/config/"]


def rules_df(spark, patterns, repo="r"):
    rows = [(repo, i, p) for i, p in enumerate(patterns, 1)]
    return ignore.compile_rules(
        spark.createDataFrame(rows, "repo string, rule_ord int, pattern string")
    )


def paths_df(spark, paths, repo="r"):
    return spark.createDataFrame([(repo, p) for p in paths], "repo string, path string")


def test_literal_rules(spark):
    expected = {
        "error.log": True,
        "important.log": False,
        "build": True,
        "build/main.o": True,
        "tempfile.txt": True,
        "temp_keep.txt": False,
        "config": True,
        "src/config": False,
        "my/xtemp1": True,
    }
    got = ignore.match_rules(paths_df(spark, expected), rules_df(spark, RULES))
    assert dict(column(got, "path", "ignored")) == expected


def test_no_rules_ignore_nothing(spark):
    none = rules_df(spark, ["x"], repo="other")
    got = ignore.match_rules(paths_df(spark, ["x"]), none)
    assert column(got, "path", "ignored") == [("x", False)]


def test_odd_patterns(spark):
    got = {
        r.rule_ord: (r.pattern, r.negation, r.anchored, r.dir_only, r.regex)
        for r in rules_df(spark, ["/", "!", "a**/b?c", "[x].c", "***y", "//"]).collect()
    }
    assert got == {
        1: ("", False, True, True, r"(?s)^.*(/.*)?\z"),
        2: ("", True, False, False, r"(?s)^.*\z"),
        3: ("a**/b?c", False, False, False, r"(?s)^.*a.*b.c\z"),
        4: ("[x].c", False, False, False, r"(?s)^.*\[x\]\.c\z"),
        5: ("***y", False, False, False, r"(?s)^.*.*[^/]*y\z"),
        6: ("/", False, True, True, r"(?s)^(/.*)?\z"),
    }


@pytest.mark.parametrize("seed", range(4))
def test_one_regex_equals_rule_by_rule(spark, seed):
    """The folded matcher against trying all rules, on many paths and rule orders."""
    import random

    rnd = random.Random(seed)
    pool = ["*.c", "a", "b/", "/a", "!a/b*", "!*.c", "c**d", "!/", "?", "!b/", "/a/**/d.c", "*"]
    patterns = [rnd.choice(pool) for _ in range(rnd.randint(1, 9))]
    names = ["a", "b", "c", "d", "d.c", "ab", "x\n"]
    paths = {"/".join(rnd.choice(names) for _ in range(rnd.randint(1, 4))) for _ in range(150)}
    rules = rules_df(spark, patterns)
    compiled = [
        (r.negation, re.compile(r.regex.replace(r"\z", r"\Z")))
        for r in rules.orderBy("rule_ord").collect()
    ]

    def verdict(path):
        out = False
        for negation, regex in compiled:
            if regex.search(path):
                out = not negation
        return out

    got = dict(column(ignore.match_rules(paths_df(spark, paths), rules), "path", "ignored"))
    assert got == {p: verdict(p) for p in paths}

    def shown(path):
        parts = path.split("/")
        return not any(verdict("/".join(parts[:n])) for n in range(1, len(parts) + 1))

    kept = ignore.prune_ignored(paths_df(spark, paths), rules)
    assert {p for (p,) in column(kept, "path")} == {p for p in paths if shown(p)}


def test_ignore_file_lines(spark):
    content = "# c\n\n  build/ \n\t*.log\x0b\r\n!x\rrest\n#no\n  # also a comment\nlast"
    files = files_df(spark, {".gitignore": content, "sub/.gitignore": "nested"})
    rules = ignore.load_ignore_rules(files).orderBy("rule_ord")
    assert column(rules, "rule_ord", "pattern") == [
        (3, "build/"),
        (4, "*.log"),
        (5, "!x"),
        (8, "last"),
    ]


def test_matchers_from_files_equal_those_from_rules(spark):
    files = files_df(spark, {".gitignore": "\n".join(["#x", *RULES, ""])})
    direct = ignore.file_matchers(files)
    by_rules = ignore.ignore_matchers(ignore.compile_rules(ignore.load_ignore_rules(files)))
    assert column(direct, "matcher") == column(by_rules, "matcher")


def shown_paths(spark, files, **options):
    return {p for (p,) in column(Pack(files_df(spark, files), PackOptions(**options)).entries, "path")}


def test_pruned_directory_cannot_be_rescued(spark):
    files = {".gitignore": "build/\n!build/keep.txt\n", "build/keep.txt": "x", "a.txt": "y"}
    assert shown_paths(spark, files) == {".gitignore", "a.txt"}


def test_extra_patterns_come_last(spark):
    files = {".gitignore": "file2.txt\n", "file1.txt": "1", "file2.txt": "2"}
    assert shown_paths(spark, files, extra_patterns=("!file2.txt",)) == set(files)
    only = shown_paths(spark, files, extra_patterns=("file1.txt",), use_ignore_files=False)
    assert only == {".gitignore", "file2.txt"}
    # given patterns are neither trimmed nor comments
    assert shown_paths(spark, files, extra_patterns=("#x", " file1.txt")) == {
        ".gitignore",
        "file1.txt",
    }


def test_extra_directory_pattern(spark):
    files = {"ignore_me/a.txt": "1", "keep/b.txt": "2"}
    assert shown_paths(spark, files, extra_patterns=("ignore_me/",)) == {"keep", "keep/b.txt"}


def test_vcs_folder(spark):
    files = {".git/config": "x", "a/.git/b": "y", "a/.gitx": "z"}
    assert shown_paths(spark, files) == {"a", "a/.gitx"}
    assert ".git/config" in shown_paths(spark, files, include_vcs=True)


def test_status(spark):
    files = files_df(spark, {".gitignore": "*", "a.txt": "1"}, "hidden").unionByName(
        files_df(spark, {"a.txt": "1"}, "open")
    )
    repos = spark.createDataFrame([("hidden",), ("open",), ("none",)], "repo string")
    pack = Pack(files, repos=repos)
    assert dict(column(pack.status, "repo", "status")) == {
        "hidden": "all_ignored",
        "open": "ok",
        "none": "empty",
    }
    assert {r for (r,) in column(pack.stats, "repo")} == {"hidden", "open"}


def test_entries_and_depth(spark):
    files = files_df(spark, {"a/b/c.txt": "", "a/d.txt": "", "e": ""})
    got = {r[:3] for r in column(entries_op.entries(files), "path", "is_dir", "depth")}
    assert got == {
        ("a", True, 0),
        ("a/b", True, 1),
        ("a/b/c.txt", False, 2),
        ("a/d.txt", False, 1),
        ("e", False, 0),
    }
    counts = entries_op.entry_counts(entries_op.entries(files))
    assert column(counts, "n_entries", "n_dirs") == [(5, 2)]




def test_any_number_of_rules(spark):
    patterns = [f"!/{n}x" if n % 2 else f"/{n - n % 4}*" for n in range(20_000)]
    verdicts = dict(
        column(
            ignore.match_rules(
                paths_df(spark, ["8x", "9x", "19999x", "1996y", "none"]), rules_df(spark, patterns)
            ),
            "path",
            "ignored",
        )
    )
    assert verdicts == {"8x": True, "9x": False, "19999x": False, "1996y": True, "none": False}


def test_many_matchers_leave_contents_where_they_are(spark, monkeypatch):
    """Contents are not dealt by repository, and a repository with most files stays where it is."""
    from corpuspack.operators import joins
    from corpuspack.plans.pack import Pack

    rows = [("big", f"d/f{i}.{'log' if i % 3 else 'c'}", b"x") for i in range(300)]
    rows += [(f"r{i}", p, b"x") for i in range(30) for p in ("a.log", "b.c", "tmp/c.c")]
    rows += [(r, ".gitignore", b"*.log\ntmp/\n") for r in {r for r, _, _ in rows} if r != "r7"]
    df = spark.createDataFrame(rows, "repo string, path string, content binary")
    few = sorted(Pack(df).visible_files.select("repo", "path").collect())
    monkeypatch.setattr(joins, "KEYED_BYTES", 10)
    monkeypatch.setattr(joins, "HOT_KEYS", 1)
    pack = Pack(df)
    assert sorted(pack.visible_files.select("repo", "path").collect()) == few
    assert sum(r == "r7" for r, _ in few) == 3 and sum(r == "big" for r, _ in few) == 101
    plan = pack.visible_files._jdf.queryExecution().toString()
    for line in plan.splitlines():
        if "Exchange hashpartitioning(repo" in line:
            assert "path" in line
    plan = joins.join_by_key(df.select("repo", "path"), pack.matchers, "repo", 10)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().toString()
