"""Files of any size as rows of bounded chunks, and what is known of a file from its chunks.

A chunk ends after a line, or within one that is longer than a chunk. What a whole file
must be asked (its kind, its longest run of backticks, its tokens) is summarised per
chunk such that summaries of neighbours can be joined: a run of backticks or a word
may go over any number of chunk edges.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspack import fixed
from corpuspack.functions.paths import text_by_extension
from corpuspack.functions.text import PUNCT, SPACE, as_bytes_text, max_backtick_run, word_units
from corpuspack.operators.tokens import Vocabulary, count_tokens_vocab

CHUNK_BYTES = 8 * fixed.MEGABYTE
LEAST_BYTES = 16  # the start of a line, which tells what it is, lies in one chunk
CHUNKS = (
    "repo string, path string, chunk int, start bigint, last boolean, line int, "
    "content binary, size bigint"
)
_RUN = rf"[^{SPACE}{PUNCT}]"


def cut_stream(stream: BinaryIO, chunk_bytes: int) -> Iterator[tuple]:
    """``(chunk, start, last, line, content)`` of a stream.

    ``line`` is the chunk in which the line begins that the chunk begins with. If the
    stream cannot be read on, a last chunk has no content.
    """
    if chunk_bytes < LEAST_BYTES:
        raise ValueError(f"a chunk must have {LEAST_BYTES} bytes at least")
    held, start, chunk, line = b"", 0, 0, 0
    while True:
        try:
            held += stream.read(chunk_bytes + 1 - len(held))
        except OSError:
            yield chunk, start, True, line, None
            return
        if len(held) <= chunk_bytes:
            yield chunk, start, True, line, held
            return
        cut = held.rfind(b"\n", 0, chunk_bytes) + 1 or chunk_bytes
        yield chunk, start, False, line, held[:cut]
        if held[cut - 1 : cut] == b"\n":
            line = chunk + 1
        elif b"\n" in held[:cut]:
            line = chunk
        held, start, chunk = held[cut:], start + cut, chunk + 1


def cut_contents(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A table of whole files ``(repo, path, content)`` as chunks; a null content is one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, path, content in zip(*[batch.column(i) for i in range(3)]):
                data = content.as_py()
                pieces = [(0, 0, True, 0, None)] if data is None else cut_stream(io.BytesIO(data), chunk_bytes)
                size = None if data is None else len(data)
                for chunk, start, last, line, part in pieces:
                    row = {
                        "repo": repo.as_py(), "path": path.as_py(), "chunk": chunk, "start": start,
                        "last": last, "line": line, "content": part, "size": size,
                    }
                    yield pa.RecordBatch.from_pylist([row], schema=CHUNK_SCHEMA)

    whole = files.select("repo", "path", F.col("content").cast("binary").alias("content"))
    return whole.mapInArrow(run, CHUNKS)


CHUNK_SCHEMA = pa.schema(
    [
        ("repo", pa.string()),
        ("path", pa.string()),
        ("chunk", pa.int32()),
        ("start", pa.int64()),
        ("last", pa.bool_()),
        ("line", pa.int32()),
        ("content", pa.binary()),
        ("size", pa.int64()),
    ]
)


def is_whole() -> Column:
    """Whether a chunk is all of its file."""
    return (F.col("chunk") == 0) & F.col("last")


def join_contents(chunks: DataFrame) -> DataFrame:
    """Whole files again, a row each."""
    parts = chunks.groupBy("repo", "path")
    return parts.agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY chunk)").alias("content"))


def _summary() -> Column:
    """What is kept of a chunk."""
    text = as_bytes_text(F.coalesce("content", F.lit(b"")))
    size = F.length(text)
    head = F.substring(text, F.lit(1), F.greatest(F.lit(0), (F.lit(fixed.SNIFF_BYTES) - F.col("start")).cast("int")))
    printable = F.regexp_replace(head, f"[^{fixed.PRINTABLE_CLASS}]", "")
    tick = F.lit("`")
    return F.struct(
        F.col("chunk"),
        F.col("content").isNull().alias("failed"),
        size.cast("bigint").alias("n"),
        word_units(text).cast("bigint").alias("units"),
        F.rlike(F.substring(text, 1, 1), F.lit(r"\w")).alias("word_first"),
        F.rlike(F.substring(text, -1, 1), F.lit(r"\w")).alias("word_last"),
        max_backtick_run(text).cast("bigint").alias("ticks"),
        (size - F.length(F.ltrim(text, tick))).cast("bigint").alias("ticks_first"),
        (size - F.length(F.rtrim(text, tick))).cast("bigint").alias("ticks_last"),
        F.length(head).cast("bigint").alias("seen"),
        F.length(printable).cast("bigint").alias("printable"),
        F.length(F.replace(text, F.lit(fixed.UNCOUNTED_BYTE), F.lit(""))).cast("bigint").alias("counted"),
    )


def _join(a: Column, b: Column) -> Column:
    """The summary of some chunks and the next one."""
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return F.struct(
        (a["failed"] | b["failed"]).alias("failed"),
        (a["n"] + b["n"]).alias("n"),
        (a["units"] + b["units"] - F.when(a["word_last"] & b["word_first"], one).otherwise(zero)).alias("units"),
        b["word_last"].alias("word_last"),
        F.greatest(a["ticks"], b["ticks"], a["ticks_last"] + b["ticks_first"]).alias("ticks"),
        F.when(b["ticks_first"] == b["n"], a["ticks_last"] + b["n"]).otherwise(b["ticks_last"]).alias("ticks_last"),
        (a["seen"] + b["seen"]).alias("seen"),
        (a["printable"] + b["printable"]).alias("printable"),
        (a["counted"] + b["counted"]).alias("counted"),
    )


def file_facts(chunks: DataFrame, token_mode: str, vocab: DataFrame | None = None) -> DataFrame:
    """``repo, path, f_kind, f_fence, f_tokens`` of every file of several chunks.

    Narrow rows, one for each chunk, are grouped by file; files of a single chunk, which
    most are, take no part.
    """
    several = chunks.filter(~is_whole())
    zero = F.lit(0).cast("bigint")
    none = F.struct(
        F.lit(False).alias("failed"),
        zero.alias("n"),
        zero.alias("units"),
        F.lit(False).alias("word_last"),
        zero.alias("ticks"),
        zero.alias("ticks_last"),
        zero.alias("seen"),
        zero.alias("printable"),
        zero.alias("counted"),
    )
    files = several.select("repo", "path", _summary().alias("s")).groupBy("repo", "path")
    facts = files.agg(F.aggregate(F.array_sort(F.collect_list("s")), none, _join).alias("s"))
    ratio = F.col("s.printable").cast("double") / F.col("s.seen")
    kind = (
        F.when(~text_by_extension(F.col("path")) | (ratio < fixed.PRINTABLE_RATIO), "binary")
        .when(F.col("s.failed"), "error")
        .otherwise("text")
    )
    ticks = F.col("s.ticks")
    tokens = {
        "approx": F.floor(F.col("s.units") * F.lit(fixed.TOKENS_PER_WORD)).cast("bigint"),
        "bytes": F.col("s.counted"),
    }.get(token_mode)
    found = facts.select(
        "repo",
        "path",
        kind.alias("f_kind"),
        F.when(ticks < 3, 3).otherwise(ticks + 1).cast("int").alias("f_fence"),
        *([tokens.alias("f_tokens")] if tokens is not None else []),
    )
    if tokens is not None:
        return found
    if vocab is None:
        raise ValueError("token_mode 'vocab' needs a vocabulary table")
    texts = several.join(found.filter("f_kind = 'text'").select("repo", "path"), ["repo", "path"], "left_semi")
    counts = _vocab_tokens(texts, Vocabulary(vocab)).withColumnRenamed("tokens", "f_tokens")
    return found.join(counts, ["repo", "path"], "left").withColumn("f_tokens", F.coalesce("f_tokens", zero))


def _vocab_tokens(chunks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Tokens of each file of several chunks.

    Pretokens that go over an edge are cut off at both sides and put together: the end
    of one chunk, all chunks that are nothing else, and the start of the next.
    """
    text = as_bytes_text(F.col("content"))
    first = F.when(F.col("chunk") > 0, F.regexp_extract(text, f"^{_RUN}+", 0)).otherwise("")
    parts = chunks.select("repo", "path", "chunk", "last", text.alias("text"), first.alias("first")).withColumn(
        "rest", F.substr("text", F.length("first") + 1)
    )
    end = F.regexp_extract("rest", rf"(?<!{_RUN}){_RUN}++\z", 0)
    through = (F.col("chunk") > 0) & (F.col("rest") == "")
    parts = parts.withColumns({"end": F.when(F.col("last"), "").otherwise(end), "through": through})
    body = F.expr("left(rest, length(rest) - length(end))")
    earlier = Window.partitionBy("repo", "path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = parts.select("repo", "path", "chunk", "first", "end", "through").withColumn(
        "opened", F.last(F.when(~F.col("through"), F.col("chunk")), True).over(earlier)
    )
    fragments = edges.select("repo", "path", F.col("chunk").alias("run"), "chunk", F.col("end").alias("t")).unionByName(
        edges.filter("opened IS NOT NULL").select("repo", "path", F.col("opened").alias("run"), "chunk", F.col("first").alias("t"))
    )
    runs = (
        fragments.filter("t != ''")
        .groupBy("repo", "path", "run")
        .agg(F.expr("listagg(t, '') WITHIN GROUP (ORDER BY chunk)").alias("t"))
    )
    texts = parts.select("repo", "path", body.alias("t")).unionByName(runs.select("repo", "path", "t"))
    raw = texts.select("repo", "path", F.encode("t", "ISO-8859-1").cast("string").alias("t"))
    return count_tokens_vocab(raw, ["repo", "path"], "t", vocabulary, whole_texts=False)
