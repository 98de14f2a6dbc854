"""What the plans read and shuffle."""

import pytest
from conftest import files_df
from pyspark.sql import functions as F

from corpuspack import PackOptions
from corpuspack.operators import entries as entries_op
from corpuspack.operators import ignore, lint, pieces, split, tokens
from corpuspack.plans.pack import Pack
from corpuspack.sources.staging import stage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    """Files in a Parquet table."""
    files = {".gitignore": "*.log\n", "a/b.c": "int f() {\n}\n", "c.txt": "text"}
    return stage(files_df(spark, files), "plan-files")


def read_schemas(text):
    return [part.split(">")[0] for part in text.split("ReadSchema: struct<")[1:]]


def test_listing_reads_paths_only(table):
    assert all("content" not in s for s in read_schemas(plan(entries_op.entries(table))))


def test_ignore_files_are_found_by_a_pushed_filter(table):
    for df in (ignore.load_ignore_rules(table), ignore.file_matchers(table)):
        text = plan(df)
        assert "EqualTo(path,.gitignore)" in text and "Exchange" not in text


def test_structure_only_reads_no_content(table):
    body = Pack(table, PackOptions(structure_only=True)).body
    assert all("content" not in s for s in read_schemas(plan(body)))


def test_row_local_work_does_not_shuffle(table):
    pack = Pack(table)
    for df in (lint.lint_missing_docs(table), pieces.file_pieces(pack.visible_files)):
        assert "Exchange hashpartitioning" not in plan(df)
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_counting_shuffles_sums_and_not_text(spark, table):
    rows = [(bytes([b]), b, False) for b in range(256)]
    vocab = stage(
        spark.createDataFrame(rows, "token binary, id int, is_special boolean"), "plan-vocab"
    )
    texts = table.selectExpr("path", "cast(content AS string) AS t")
    counts = tokens.count_tokens_vocab(texts, ["path"], "t", tokens.Vocabulary(vocab))
    lines = plan(counts).split("\n")
    # the only exchange on the text's side is the one between partial and final sums
    main = [line for line in lines if "Exchange hashpartitioning(path" in line]
    assert len(main) == 1
    assert not any("SortMergeJoin" in line for line in lines)


def text_exchanges(df):
    """How rows that hold texts are dealt by the shuffles of a plan."""
    found = []

    def visit(node):
        output = node.output().mkString(",")
        if node.nodeName() == "Exchange" and any(name in output for name in ("content#", "text#", "body#")):
            found.append(node.outputPartitioning().toString())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(df._jdf.queryExecution().executedPlan().initialPlan())
    return found


def test_parts_deal_texts_by_piece_and_by_block(spark, table):
    """Not by repository, also if nothing is small enough for a broadcast."""
    pack = Pack(table, PackOptions(split=True, limit_mb=100 / 2**20))
    assert pack.parts().count() > 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = text_exchanges(pack.parts())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dealt and all("key#" in way or "block#" in way for way in dealt)


def test_lines_are_placed_without_a_shuffle(spark):
    rows = [("r", 5, 40, "a\n\nb\n"), ("s", 0, 4, "no end")]
    placed = stage(spark.createDataFrame(rows, "repo string, start bigint, doc_bytes bigint, text string"), "plan-placed")
    lines = split._line_starts(placed, F.lit(True))
    assert "Exchange" not in plan(lines)
    assert sorted((r.repo, r.pos) for r in lines.collect()) == [("r", 5), ("r", 7), ("r", 8), ("s", 0)]
