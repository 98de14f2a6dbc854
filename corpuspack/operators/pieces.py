"""A document as ordered pieces.

A piece is a row ``(repo, section, key, nth, kind, text, counted)``. Ordering by
``(section, key, nth)`` within a repository gives the document; ``counted`` holds the
texts whose size and tokens count, each counted on its own. A file section is one
piece, or one for each chunk of a file that is larger than a chunk. Every piece ends with
a newline, but for chunks that end within a line longer than a chunk.

What counts of a file of several chunks is in ``more_bytes`` and, as words go over
edges, in ``more_tokens`` of its first piece. ``line`` is the chunk in which the line
begins that a piece begins with, null for all other pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack import fixed
from corpuspack.functions import render
from corpuspack.functions.paths import sort_key, title_of
from corpuspack.functions.text import (
    content_kind,
    count_tokens_approx,
    count_tokens_bytes,
)
from corpuspack.operators.chunks import is_whole
from corpuspack.operators.ordering import running_totals
from corpuspack.operators.tokens import Vocabulary, count_tokens_vocab

SUMMARY, TITLE, STRUCTURE, TREE, TREE_END, CONTENTS, FILE = range(7)
KEY = ["repo", "section", "key", "nth"]


def _plain() -> list[Column]:
    """Columns of a piece that is not a chunk."""
    return [
        F.lit(0).cast("bigint").alias("more_bytes"),
        F.lit(0).cast("bigint").alias("more_tokens"),
        F.lit(None).cast("int").alias("line"),
    ]


def _pieces(
    rows: DataFrame, section: int, kind: Column | str, text: Column, counted: Column, key: Column
) -> DataFrame:
    return rows.select(
        "repo",
        F.lit(section).alias("section"),
        key.alias("key"),
        F.lit(0).alias("nth"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        text.alias("text"),
        counted.cast("array<string>").alias("counted"),
        *_plain(),
    )


def frame_pieces(repos: DataFrame, structure_only: bool = False) -> DataFrame:
    """Title and headings, the same few for every repository.

    ``repos`` has ``repo`` and may have ``directory``, whose last segment is the title.
    """
    directory = F.col("directory" if "directory" in repos.columns else "repo")
    frames = [
        (
            TITLE,
            F.concat(F.lit(fixed.TITLE), title_of(directory), F.lit("\n\n")),
            [fixed.TITLE],
        ),
        (
            STRUCTURE,
            F.lit(fixed.STRUCTURE_HEADING + fixed.TREE_FENCE),
            [fixed.STRUCTURE_HEADING],
        ),
        (TREE_END, F.lit(fixed.TREE_FENCE), []),
    ]
    if not structure_only:
        frames.append((CONTENTS, F.lit(fixed.CONTENTS_HEADING), [fixed.CONTENTS_HEADING]))
    rows = F.array(
        *[
            F.struct(
                F.lit(section).alias("section"),
                text.alias("text"),
                F.array(*[F.lit(c) for c in counted]).cast("array<string>").alias("counted"),
            )
            for section, text, counted in frames
        ]
    )
    return repos.select("repo", F.explode(rows).alias("f")).select(
        "repo",
        "f.section",
        F.lit("").alias("key"),
        F.lit(0).alias("nth"),
        F.lit("frame").alias("kind"),
        "f.text",
        "f.counted",
        *_plain(),
    )


def tree_pieces(entries: DataFrame) -> DataFrame:
    """One tree line per entry, of kind dir or entry; its indentation does not count."""
    path, is_dir = F.col("path"), F.col("is_dir")
    return _pieces(
        entries,
        TREE,
        F.when(is_dir, "dir").otherwise("entry"),
        render.tree_line(path, is_dir),
        F.array(render.tree_label(path, is_dir)),
        sort_key(path),
    )


def routed_files(files: DataFrame) -> DataFrame:
    """Files with ``kind`` (text, binary, error) and their size in bytes.

    ``size`` may be given for files whose content is too large to hold in a row,
    ``head`` for files whose start was read separately.
    """
    path, content = F.col("path"), F.col("content")
    size = F.col("size") if "size" in files.columns else F.octet_length(content)
    start = F.col("head") if "head" in files.columns else None
    return files.select(
        "repo",
        "path",
        "content",
        size.cast("bigint").alias("n_bytes"),
        content_kind(path, content, start).alias("kind"),
    )


def routed_chunks(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """A row for each file that is given in chunks: ``repo, path, n_bytes, kind``."""
    own = F.when(is_whole(), content_kind(F.col("path"), F.col("content")))
    return (
        chunks.filter("chunk = 0")
        .join(facts, ["repo", "path"], "left")
        .select("repo", "path", F.col("size").alias("n_bytes"), F.coalesce("f_kind", own).alias("kind"))
    )


def rendered_files(files: DataFrame) -> DataFrame:
    """Routed files with heading, rendered body and counted texts."""
    kind, path, text = F.col("kind"), F.col("path"), F.col("_text")
    prepared = routed_files(files).select(
        "repo",
        "path",
        "kind",
        F.col("content").cast("string").alias("_text"),
        render.heading(path).alias("heading"),
        F.when(kind == "text", render.fence_of(F.col("content").cast("string"))).alias("_fence"),
        F.when(kind == "binary", render.size_line(F.col("n_bytes"))).alias("_size"),
    )
    return prepared.select(
        "repo",
        "path",
        "kind",
        "heading",
        render.file_body(kind, path, text, F.col("_fence"), F.col("_size")).alias("body"),
        render.counted_texts(kind, F.col("heading"), text, F.col("_size")).alias("counted"),
    )


def file_pieces(files: DataFrame) -> DataFrame:
    """One section per file: heading, fenced content or binary note, blank line."""
    return _pieces(
        rendered_files(files),
        FILE,
        F.col("kind"),
        F.concat("heading", "body", F.lit("\n")),
        F.col("counted"),
        sort_key(F.col("path")),
    )


def chunk_pieces(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """The sections of files that are given in chunks; ``facts`` of those of several.

    A chunk is rendered where it is read: of other chunks it needs only the narrow facts.
    Of a file that is not text, the first chunk gives the note and the others nothing.
    """
    path, content, text = F.col("path"), F.col("content"), F.col("content").cast("string")
    own = F.when(is_whole(), content_kind(path, content))
    rows = chunks.join(facts, ["repo", "path"], "left").withColumn("kind", F.coalesce("f_kind", own))
    rows = rows.filter((F.col("kind") == "text") | (F.col("chunk") == 0))
    kind, first, whole = F.col("kind"), F.col("chunk") == 0, is_whole()
    heading = render.heading(path)
    fence = F.when(whole, render.fence_of(text)).otherwise(F.repeat(F.lit("`"), F.col("f_fence")))
    opening = F.when(first, F.concat(heading, render.section_opening(path, fence))).otherwise("")
    closing = F.when(F.col("last"), F.concat(render.section_closing(text, fence), F.lit("\n"))).otherwise("")
    size = render.size_line(F.col("size"))
    note = F.when(kind == "error", fixed.ERROR_NOTE).otherwise(render.binary_section(size))
    is_text = kind == "text"
    counted = (
        F.when(~is_text | whole, render.counted_texts(kind, heading, text, size))
        .when(first, F.array(heading))
        .otherwise(F.array().cast("array<string>"))
    )
    split = is_text & ~whole
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "repo",
        F.lit(FILE).alias("section"),
        sort_key(path).alias("key"),
        F.col("chunk").alias("nth"),
        "kind",
        F.when(is_text, F.concat(opening, text, closing)).otherwise(F.concat(heading, note, F.lit("\n"))).alias("text"),
        counted.alias("counted"),
        F.when(split, F.octet_length(content).cast("bigint")).otherwise(zero).alias("more_bytes"),
        F.when(split & first, F.col("f_tokens")).otherwise(zero).alias("more_tokens"),
        F.when(split, F.col("line")).alias("line"),
    )


def body_pieces(
    repos: DataFrame,
    entries: DataFrame,
    files: DataFrame,
    structure_only: bool = False,
    facts: DataFrame | None = None,
) -> DataFrame:
    """All pieces but the summary. Without contents, file contents are not read.

    ``files`` are whole, or in chunks if ``facts`` of those are given.
    """
    pieces = frame_pieces(repos, structure_only).unionByName(tree_pieces(entries))
    if structure_only:
        return pieces
    return pieces.unionByName(file_pieces(files) if facts is None else chunk_pieces(files, facts))


def summary_pieces(stats: DataFrame, split: bool) -> DataFrame:
    """The summary that opens each document, with its token total."""
    return _pieces(
        stats,
        SUMMARY,
        "summary",
        render.summary_header(F.col("total_tokens"), split),
        F.array(),
        F.lit(""),
    )


def ledger(pieces: DataFrame, token_mode: str, vocab: DataFrame | None = None) -> DataFrame:
    """Narrow measures of every piece, from one pass over the text.

    ``n_bytes``, ``counted_bytes``, ``tokens``, and ``inner``: the look of its
    lines matters when the document is split, even if the piece is short.
    """
    tokens = {"approx": count_tokens_approx, "bytes": count_tokens_bytes}.get(token_mode)

    def total(measure) -> Column:
        return F.aggregate(
            F.transform("counted", lambda t: measure(t).cast("bigint")),
            F.lit(0).cast("bigint"),
            lambda a, b: a + b,
        )

    inner = (
        F.when(F.col("line").isNotNull(), True)
        .when(F.col("section") == FILE, F.col("text").contains("\n" + fixed.FILE_MARKER))
        .when(F.col("section") == TREE, ~F.rlike("text", F.lit(r"^[^\n]*\n\z")))
        .otherwise(True)
    )
    sizes = [
        "kind",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        (total(F.octet_length) + F.col("more_bytes")).alias("counted_bytes"),
        inner.alias("inner"),
        "line",
    ]
    more = F.col("more_tokens")
    if tokens is not None:
        return pieces.select(*KEY, *sizes, (total(tokens) + more).alias("tokens"))
    if vocab is None:
        raise ValueError("token_mode 'vocab' needs a vocabulary table")
    counts = count_tokens_vocab(
        pieces.select(*KEY, F.explode("counted").alias("counted_text")),
        KEY,
        "counted_text",
        Vocabulary(vocab),
    )
    return (
        pieces.select(*KEY, *sizes, "more_tokens")
        .join(counts, KEY, "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)) + more)
        .drop("more_tokens")
    )


def doc_stats(ledger_rows: DataFrame) -> DataFrame:
    """Counted bytes and tokens per repository."""
    return ledger_rows.groupBy("repo").agg(
        F.sum("counted_bytes").alias("total_size"), F.sum("tokens").alias("total_tokens")
    )


def piece_offsets(sizes: DataFrame) -> DataFrame:
    """Add ``ord`` (from 0) and the byte offset ``start`` of each piece in its document."""
    return running_totals(
        sizes,
        "repo",
        ["section", "key", "nth"],
        {"ord": F.lit(1), "start": F.col("n_bytes")},
    )


def whole_lines(offsets: DataFrame) -> DataFrame:
    """Add ``line_start``: where the piece starts that has the start of a piece's first line.

    Only pieces that start within a line are joined, with pieces of the same file.
    """
    within = (F.col("line") < F.col("nth")) & F.col("line").isNotNull()
    begins = offsets.select(
        *KEY[:3], F.col("nth").alias("line"), F.col("start").alias("line_start")
    )
    joined = offsets.filter(within).join(begins, [*KEY[:3], "line"])
    rest = offsets.filter(~within).withColumn("line_start", F.col("start"))
    return rest.unionByName(joined.select(*rest.columns))


def line_start_of(placed: DataFrame) -> str:
    """The column with the start of a piece's first line."""
    return "line_start" if "line_start" in placed.columns else "start"


def place(pieces: DataFrame, offsets: DataFrame) -> DataFrame:
    """Texts with their offsets."""
    return pieces.select(*KEY, "text").join(offsets, KEY)


def assemble_document(placed: DataFrame, block_bytes: int) -> DataFrame:
    """Document text in blocks ``(repo, block, start, text)``.

    A block holds the whole pieces that start within the same ``block_bytes``, so
    a row stays bounded however long a document gets; a document that fits is one
    row. Blocks in order, joined, are the document. A block begins with a line, so a line
    is within one row, however many chunks it has.
    """
    return (
        placed.withColumn("block", F.floor(F.col(line_start_of(placed)) / block_bytes))
        .groupBy("repo", "block")
        .agg(
            F.min("start").alias("start"),
            F.expr("listagg(text, '') WITHIN GROUP (ORDER BY start)").alias("text"),
        )
    )
