"""Packed documents back to files.

A document is one or more blocks ``(doc, block, text)`` of whole lines, in order.
A heading outside a fence opens a file, the next fence is its body, and a fence
is closed by a line of exactly its backticks. Only headings and fence lines, a
few narrow marks per block, decide what is what. Lines have one character per byte,
so bytes that are not UTF-8 come back as they were. Each block is summarised by how
it would end for every state it may start in, so are slices of blocks, slices are
chained per document, blocks per slice, and then all blocks are cut in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspack import fixed
from corpuspack.functions.text import as_bytes, as_bytes_text, bytes_text_of
from corpuspack.operators.ordering import running_totals
from corpuspack.sources.staging import stage

_MARKER = bytes_text_of(fixed.FILE_MARKER)
SLICE_BLOCKS = 1000  # of a document are chained by one task
INHERIT, CLOSED = -1, -2  # the open file is the one before the block; there is none


def _marks(lines: Column) -> Column:
    """Heading lines and lines that start with a fence, with their line number."""
    numbered = F.transform(lines, lambda text, i: F.struct(i.alias("i"), text.alias("text")))
    kept = F.filter(
        numbered,
        lambda x: F.startswith(x["text"], F.lit("```"))
        | F.startswith(x["text"], F.lit(_MARKER)),
    )
    return F.transform(
        kept,
        lambda x: F.struct(
            x["i"].cast("int").alias("line"),
            F.length(F.regexp_extract(x["text"], "^`*", 0)).alias("ticks"),
            x["text"].rlike(r"^`+(\r|\x00|\z)").alias("closes"),
            # the name follows one separating character and ends at a carriage return
            F.regexp_extract(x["text"], f"(?s)^{_MARKER}.([^\r]*)", 1).alias("path"),
        ),
    )


def _exits(marks: Sequence[dict]) -> list[dict]:
    """How a block ends (fence, open file) for every fence length it may start in.

    Worked out from the last mark to the first. A fence that never closes in the
    block stays as it is and needs no entry.
    """
    outside = (0, INHERIT)
    after_close: dict[int, tuple[int, int]] = {}
    for n in range(len(marks) - 1, -1, -1):
        mark = marks[n]
        ticks = mark["ticks"]
        later = outside
        if ticks == 0:
            outside = (later[0], n if later[1] == INHERIT else later[1])
        else:
            outside = after_close.get(ticks, (ticks, INHERIT))
            if mark["closes"]:
                fence, opened = later
                after_close[ticks] = (fence, CLOSED if opened == INHERIT else opened)
    ends = {0: outside, **after_close}
    return [{"enter": k, "fence": v[0], "opened": v[1]} for k, v in ends.items()]


_EXITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("enter", T.IntegerType()),
            T.StructField("fence", T.IntegerType()),
            T.StructField("opened", T.IntegerType()),
        ]
    )
)
_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("file_block", T.LongType()),
            T.StructField("file_line", T.IntegerType()),
            T.StructField("path", T.StringType()),
            T.StructField("first", T.IntegerType()),
            T.StructField("last", T.IntegerType()),
        ]
    )
)


@F.pandas_udf(_EXITS)
def _exits_of(marks: pd.Series) -> pd.Series:
    return marks.map(_exits)


def _spans(
    marks: Sequence[dict], fence: int, block: int, opened: tuple[int, int, str] | None
) -> list[dict]:
    """Line ranges ``[first, last)`` that belong to files; ``last`` -1 is the block's end.

    A heading yields an empty range, so that a file without a body exists too.
    """
    spans: list[dict] = []

    def add(first: int, last: int) -> None:
        if opened is not None:
            spans.append(
                {
                    "file_block": opened[0],
                    "file_line": opened[1],
                    "path": opened[2],
                    "first": first,
                    "last": last,
                }
            )

    body_from = 0
    for mark in marks:
        line, ticks = mark["line"], mark["ticks"]
        if fence:
            if mark["closes"] and ticks == fence:
                add(body_from, line)
                fence, opened = 0, None
        elif ticks == 0:
            opened = (block, line, mark["path"]) if mark["path"] else None
            add(line, line)
        else:
            fence, body_from = ticks, line + 1
    if fence:
        add(body_from, -1)
    return spans


@F.pandas_udf(_SPANS)
def _spans_of(
    marks: pd.Series,
    block: pd.Series,
    fence: pd.Series,
    file_block: pd.Series,
    file_line: pd.Series,
    path: pd.Series,
) -> pd.Series:
    out = []
    for m, b, f, fb, fl, p in zip(marks, block, fence, file_block, file_line, path):
        opened = None if p is None or pd.isna(p) else (int(fb), int(fl), p)
        out.append(_spans(m, int(f), int(b), opened))
    return pd.Series(out)


def _after(row: dict, fence: int, opened: tuple | int | None) -> tuple[int, tuple | int | None]:
    """The state behind a block that is entered in this one."""
    for end in row["exits"]:
        if end["enter"] == fence:
            if end["heading"] is not None:
                h = end["heading"]
                return end["fence"], (row["block"], h["line"], h["path"]) if h["path"] else None
            return end["fence"], None if end["opened"] == CLOSED else opened
    return fence, opened  # a fence that does not close


def _compose(table: pa.Table) -> pa.Table:
    """How a slice of blocks ends for every fence it may start in, as a block's own exits say.

    Such functions compose in any grouping, so slices are summarised at once.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    out = []
    for enter in sorted({0} | {end["enter"] for row in rows for end in row["exits"]}):
        fence, opened = enter, INHERIT
        for row in rows:
            fence, opened = _after(row, fence, opened)
        held = opened if isinstance(opened, tuple) else (None, None, None)
        out.append(
            {
                "doc": rows[0]["doc"],
                "slice": rows[0]["slice"],
                "enter": enter,
                "fence": fence,
                "opened": CLOSED if opened is None else INHERIT if opened == INHERIT else 0,
                "file_block": held[0],
                "file_line": held[1],
                "path": held[2],
            }
        )
    return pa.Table.from_pylist(out, schema=_WAYS)


def _chain_slices(table: pa.Table) -> pa.Table:
    """Start state of every slice of one document but the first."""
    by_slice: dict[int, list[dict]] = {}
    for row in table.to_pylist():
        by_slice.setdefault(row["slice"], []).append(row)
    fence, opened, out = 0, None, []
    for number in sorted(by_slice):
        block, line, path = opened or (None, None, None)
        doc = by_slice[number][0]["doc"]
        out.append(
            {"doc": doc, "slice": number, "fence": fence, "file_block": block, "file_line": line, "path": path}
        )
        for way in by_slice[number]:
            if way["enter"] == fence:
                fence = way["fence"]
                if way["opened"] != INHERIT:
                    opened = None if way["opened"] == CLOSED else (way["file_block"], way["file_line"], way["path"])
                break
    return pa.Table.from_pylist(out, schema=_STARTS)


def _chain(table: pa.Table) -> pa.Table:
    """Start state of every block of one slice, except plain ones."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    first = rows[0]
    fence = first["start_fence"] or 0
    opened = None if first["start_path"] is None else (first["start_block"], first["start_line"], first["start_path"])
    out = []
    for row in rows:
        if fence or opened is not None:
            block, line, path = opened or (None, None, None)
            out.append(
                {
                    "doc": row["doc"],
                    "block": row["block"],
                    "fence": fence,
                    "file_block": block,
                    "file_line": line,
                    "path": path,
                }
            )
        fence, opened = _after(row, fence, opened)
    return pa.Table.from_pylist(out, schema=_CARRY)


_OPEN = [("file_block", pa.int64()), ("file_line", pa.int32()), ("path", pa.string())]
_OPEN_DDL = "file_block bigint, file_line int, path string"
_STARTS = pa.schema([("doc", pa.string()), ("slice", pa.int64()), ("fence", pa.int32()), *_OPEN])
_STARTS_DDL = f"doc string, slice bigint, fence int, {_OPEN_DDL}"
_WAYS = pa.schema(
    [
        ("doc", pa.string()),
        ("slice", pa.int64()),
        ("enter", pa.int32()),
        ("fence", pa.int32()),
        ("opened", pa.int32()),
        *_OPEN,
    ]
)
_WAYS_DDL = f"doc string, slice bigint, enter int, fence int, opened int, {_OPEN_DDL}"
_CARRY = pa.schema(
    [
        ("doc", pa.string()),
        ("block", pa.int64()),
        ("fence", pa.int32()),
        ("file_block", pa.int64()),
        ("file_line", pa.int32()),
        ("path", pa.string()),
    ]
)
_CARRY_DDL = "doc string, block bigint, fence int, file_block bigint, file_line int, path string"


def _carried(blocks: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """States that blocks start in, where that is not simply "outside, no file".

    Only documents of several blocks are looked at, one row without text for each block.
    Blocks are dealt in slices; a document of several is chained from the slices' summaries,
    then all slices are chained at once. The result is staged: it is small or empty,
    and knowing that, Spark need not shuffle the texts to join it.
    """
    several = blocks.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc")
    marked = blocks.join(several, "doc", "left_semi").select(
        "doc", "block", _marks(F.split(as_bytes_text(F.col("text")), "\n")).alias("marks")
    )
    ends = marked.withColumn("exits", _exits_of("marks")).select(
        "doc",
        "block",
        F.transform(
            "exits",
            lambda e: F.struct(
                e["enter"].alias("enter"),
                e["fence"].alias("fence"),
                e["opened"].alias("opened"),
                F.when(e["opened"] >= 0, F.get("marks", e["opened"])).alias("heading"),
            ),
        ).alias("exits"),
    )
    begin = ["start_fence", "start_block", "start_line", "start_path"]
    ends = stage(ends, "ends")
    most = ends.groupBy("doc").count().agg(F.max("count")).first()[0] or 0
    if most <= slice_blocks:  # a slice each, entered outside of a file
        plain = dict(zip(begin, (F.lit(None).cast(t) for t in ("int", "bigint", "int", "string"))))
        begun = ends.withColumns({"slice": F.lit(0).cast("bigint"), **plain})
        return stage(begun.groupBy("doc", "slice").applyInArrow(_chain, _CARRY_DDL), "carried")
    numbered = running_totals(ends, "doc", ["block"], {"nth": F.lit(1)})
    sliced = stage(
        numbered.withColumn("slice", F.floor(F.col("nth") / slice_blocks)).drop("nth"), "end-slices"
    )
    ways = stage(sliced.groupBy("doc", "slice").applyInArrow(_compose, _WAYS_DDL), "ways")
    starts = stage(ways.groupBy("doc").applyInArrow(_chain_slices, _STARTS_DDL), "starts")
    renamed = [F.col(c).alias(b) for c, b in zip(("fence", "file_block", "file_line", "path"), begin)]
    begun = sliced.join(starts.select("doc", "slice", *renamed), ["doc", "slice"], "left")
    return stage(begun.groupBy("doc", "slice").applyInArrow(_chain, _CARRY_DDL), "carried")


def placeholder_cut(body: Column) -> Column:
    """Drop a binary or error note in a body, and all after it."""
    return F.regexp_replace(body, r"(?msd)^(\*Binary file\*|\*Error).*\z", "")


def reconstruct(blocks: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """Files ``(doc, path, content)`` of packed documents.

    ``blocks`` is ``(doc, text)`` or ``(doc, block, text)``. If a document has the
    same heading twice, the later file replaces the earlier.
    """
    if "block" not in blocks.columns:
        blocks = blocks.withColumn("block", F.lit(0))
    blocks = blocks.select("doc", F.col("block").cast("bigint").alias("block"), "text")
    state = ["fence", "file_block", "file_line", "path"]
    spans = (
        blocks.withColumn("_lines", F.split(as_bytes_text(F.col("text")), "\n"))
        .withColumn("_marks", _marks(F.col("_lines")))
        .join(_carried(blocks, slice_blocks), ["doc", "block"], "left")
        .withColumn("fence", F.coalesce("fence", F.lit(0)))
        .withColumn("_spans", _spans_of("_marks", "block", *state))
        .select("doc", "block", "_lines", F.explode("_spans").alias("span"))
    )
    first, last = F.col("span.first"), F.col("span.last")
    n_lines = F.when(last < 0, F.size("_lines")).otherwise(last) - first
    body = F.concat(
        F.array_join(F.slice("_lines", first + 1, n_lines), "\n"),
        F.when((last > first), "\n").otherwise(""),
    )
    fragments = spans.select(
        "doc",
        F.col("span.path").alias("path"),
        F.struct("span.file_block", "span.file_line").alias("file"),
        "block",
        first.alias("first"),
        body.alias("body"),
    )
    # one exchange serves both aggregations
    whole = (
        fragments.repartition("doc", "path")
        .groupBy("doc", "path", "file")
        .agg(
            F.expr("listagg(body, '') WITHIN GROUP (ORDER BY block, first)").alias("body")
        )
    )
    return whole.groupBy("doc", "path").agg(
        as_bytes(placeholder_cut(F.max_by("body", "file"))).cast("string").alias("content")
    ).withColumn("path", as_bytes(F.col("path")).cast("string"))


def roundtrip_diff(packed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Status per file of two corpora: same, changed, missing or extra.

    Only digests go through the join.
    """

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select("repo", "path", F.sha2(F.col("content").cast("binary"), 256).alias(name))

    return (
        digest(packed, "a")
        .join(digest(rebuilt, "b"), ["repo", "path"], "full_outer")
        .select(
            "repo",
            "path",
            F.when(F.col("b").isNull(), "missing")
            .when(F.col("a").isNull(), "extra")
            .when(F.col("a") == F.col("b"), "same")
            .otherwise("changed")
            .alias("status"),
        )
    )
