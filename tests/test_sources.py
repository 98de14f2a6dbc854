import os

import pytest
from conftest import column, files_df

from corpuspack.operators import ignore, pieces
from corpuspack.plans.pack import Pack
from corpuspack.sources import files as tree
from corpuspack.sources import staging
from corpuspack.sources.tables import files_table


@pytest.fixture
def root(tmp_path):
    (tmp_path / "src" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config").write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\nskip/\n")
    (tmp_path / ".hidden").write_text("h")
    (tmp_path / "_under").write_text("u")
    (tmp_path / "src" / "a.c").write_text("int a;\n")
    (tmp_path / "src" / "x.log").write_text("log")
    (tmp_path / "src" / "deep" / "er" / "b.bin").write_bytes(bytes(50))
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "c.txt").write_text("c")
    os.symlink(tmp_path / "src" / "a.c", tmp_path / "link.c")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken")
    return tmp_path


def roots_df(spark, root):
    return spark.createDataFrame([("r", str(root))], "repo string, root string")


def test_scan_lists_hidden_and_empty_and_follows_links(spark, root):
    found = {r[:2] for r in column(tree.scan_tree(roots_df(spark, root)), "path", "is_dir")}
    assert {(".hidden", False), ("_under", False), ("empty", True), ("link.c", False)} <= found
    assert (".git/config", False) in found and ("src/deep/er/b.bin", False) in found
    assert not any(path == "broken" for path, _ in found)


def test_scan_prunes_while_listing(spark, root):
    roots = roots_df(spark, root)
    rules = ignore.compile_rules(ignore.load_ignore_rules(tree.read_ignore_files(roots)))
    found = tree.scan_tree(roots, ignore.ignore_matchers(rules), include_vcs=False)
    assert {p for (p,) in column(found, "path")} == {
        ".gitignore",
        ".hidden",
        "_under",
        "empty",
        "link.c",
        "src",
        "src/a.c",
        "src/deep",
        "src/deep/er",
        "src/deep/er/b.bin",
    }


def test_scanned_tree_to_document(spark, root):
    found = tree.scan_tree(roots_df(spark, root), include_vcs=False)
    files = tree.read_contents(found)
    entries = found.select("repo", "path", "is_dir", "depth")
    text = Pack(files, entries=entries).documents().first().text
    assert "📁 empty/\n" in text and "x.log" not in text and "skip" not in text.split("```")[1]
    assert "### 📄 src/deep/er/b.bin\n\n*Binary file*\n- Size: 50.00 B\n" in text
    assert "### 📄 src/a.c\n\n```c\nint a;\n```\n" in text


def test_missing_content(spark):
    schema = "repo string, path string, content binary, head binary, size bigint"
    rows = [("r", "big.txt", None, None, 5000), ("r", "bad.txt", None, b"text", 4)]
    routed = pieces.rendered_files(spark.createDataFrame(rows, schema))
    assert dict(column(routed, "path", "body")) == {
        "big.txt": "*Binary file*\n- Size: 4.88 KB\n",
        "bad.txt": "*Error reading file*\n",
    }


def test_any_table_as_files(spark):
    table = spark.createDataFrame([(1, "x/y", "text")], "id int, name string, body string")
    assert [tuple(r) for r in files_table(table, "id", "name", "body").collect()] == [
        ("1", "x/y", bytearray(b"text"))
    ]


def test_shared_folder_is_the_one_of_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert staging.fresh_path(spark, "t").startswith(folder)
    staged = staging.stage(files_df(spark, {"a": "x"}), "t")
    assert staged.count() == 1 and staged.inputFiles()[0].removeprefix("file://").startswith(folder)


def test_the_folder_must_be_named():
    """Local sessions have no folder of their own either; the entry gives them one."""

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        def __init__(self, master, folder):
            members = {"master": master, "getCheckpointDir": lambda: folder}
            self.sparkContext = type("Context", (), members)

    assert staging.shared_folder(Session("yarn", "/shared/")) == "/shared"
    for master in ("local[2]", "yarn"):
        with pytest.raises(RuntimeError):
            staging.shared_folder(Session(master, None))


def test_posix_paths():
    assert staging.shared_posix_path("file:///a/b") == "/a/b"
    assert staging.shared_posix_path("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        staging.shared_posix_path("store://bucket/a")


def test_scan_tree_ends_at_links_back(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "f.txt").write_text("x")
    (tmp_path / "a" / "up").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "a" / "b" / "side").symlink_to(tmp_path / "c", target_is_directory=True)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "back").symlink_to(tmp_path / "a" / "b", target_is_directory=True)
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo string, root string")
    found = {r["path"] for r in tree.scan_tree(roots).collect()}
    assert found == {
        "a", "a/b", "a/b/f.txt", "a/b/side", "c", "c/back", "c/back/f.txt",
    }


def test_parts_keep_repository_names(spark, tmp_path):
    from corpuspack.sources import sinks

    names = ["007", "1e3", "a b"]
    parts = spark.createDataFrame([(n, 1, n.encode()) for n in names], "repo string, part int, body binary")
    sinks.write_parts(parts, f"{tmp_path}/parts")
    written = spark.read.parquet(f"{tmp_path}/parts")
    assert sorted((r["repo"], r["part"]) for r in written.collect()) == [(n, 1) for n in names]


def test_block_numbers_stay_whole(spark, tmp_path):
    from corpuspack.sources import sinks

    placed = spark.createDataFrame(
        [("r", 1_234_567_890, "one\n"), ("r", 1_234_567_891, "two\n")], "repo string, start bigint, text string"
    )
    sinks.write_pack(placed, f"{tmp_path}/pack", 1)
    assert len(list((tmp_path / "pack" / "repo=r").glob("block=*"))) == 2
