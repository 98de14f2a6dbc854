"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack import fixed
from corpuspack.functions import paths, render, text
from corpuspack.operators import entries as entries_op
from corpuspack.operators import (
    chunks,
    ignore,
    lint,
    merges,
    ordering,
    pieces,
    reconstruct,
    tokens,
)
from corpuspack.options import PackOptions
from corpuspack.plans import corpora, unpack
from corpuspack.plans.pack import Pack
from corpuspack.plans.settings import (
    BLOCK_BYTES,
    EXTRA_PATTERNS,
    LIMIT_MB,
    MAX_SPLITS,
    OVERSIZE_MB,
    SMALL_BLOCK,
    SMALL_CHUNK,
    SMALL_MAX_SPLITS,
    SPECIAL_ID,
)
from corpuspack.sources import sinks, vocab
from corpuspack.sources import files as tree
from corpuspack.sources.staging import fresh_path, shared_posix_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPLIT = PackOptions(split=True, limit_mb=LIMIT_MB, max_splits=MAX_SPLITS)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _doc_pack(spark: SparkSession, sf_dir: str, options: PackOptions | None = None) -> Pack:
    return Pack(corpora.document_files(spark, sf_dir), options)


def _big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# flagship


@query
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: files, directories, binaries, bytes, tokens and parts."""
    pack = _doc_pack(spark, sf_dir, SPLIT)
    is_file = F.col("section") == pieces.FILE
    counts = pack.ledger.groupBy("repo").agg(
        F.count_if(is_file).alias("n_files"),
        F.count_if(F.col("kind") == "dir").alias("n_dirs"),
        F.count_if(is_file & (F.col("kind") == "binary")).alias("n_binary"),
        F.sum("counted_bytes").alias("total_bytes"),
        F.sum("tokens").alias("total_tokens"),
    )
    n_parts = pack.split_plan.select("repo", (F.size("cuts") + 1).cast("bigint").alias("n_parts"))
    return counts.join(n_parts, "repo")


# sources and sinks


@query
def corpus_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _big(entries_op.entries(corpora.document_files(spark, sf_dir)), "depth")


@query
def corpus_entries_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _big(entries_op.entries(corpora.page_files(spark, sf_dir)), "depth")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document files as a real directory tree; returns its roots."""
    root = shared_posix_path(fresh_path(spark, "tree"))
    files = corpora.document_files(spark, sf_dir)
    written = sinks.export_files(files, root).groupBy("repo").agg(F.count("*").alias("n"))
    return stage(written.select("repo", F.concat(F.lit(f"{root}/"), "repo").alias("root")), "roots")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = _exported(spark, sf_dir)
    rules = ignore.compile_rules(ignore.load_ignore_rules(tree.read_ignore_files(roots)))
    return tree.scan_tree(roots, stage(ignore.ignore_matchers(rules), "matchers"), include_vcs=False)


@query
def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _big(_scanned(spark, sf_dir).select("repo", "path", "is_dir", "depth"), "depth")


@query
def read_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and kind of every file of a directory tree, read in small chunks."""
    files = tree.read_contents(stage(_scanned(spark, sf_dir), "scanned"), SMALL_CHUNK)
    facts = stage(chunks.file_facts(files, "approx"), "facts")
    return pieces.routed_chunks(files, facts)


def _chunked(spark: SparkSession, sf_dir: str, **options) -> Pack:
    """The document files in small chunks, most of them several."""
    files = chunks.cut_contents(corpora.document_files(spark, sf_dir), SMALL_CHUNK)
    return Pack(stage(files, "chunks"), PackOptions(**options))


@query
def chunked_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of documents whose files come in chunks."""
    return _chunked(spark, sf_dir).stats


@query
def chunked_split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of documents whose files come in chunks."""
    pack = _chunked(spark, sf_dir, split=True, limit_mb=LIMIT_MB, max_splits=MAX_SPLITS)
    return _big(pack.split_points(), "split_no")


@query
def chunked_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files out of documents whose files came in chunks."""
    documents = _chunked(spark, sf_dir, block_bytes=BLOCK_BYTES).documents()
    return unpack.unpack_documents(stage(documents, "documents"))


@query
def load_ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _big(ignore.load_ignore_rules(corpora.document_files(spark, sf_dir)), "rule_ord")


def _vocab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary lines from the documents' vocabulary, some of them faulty."""
    b64 = text.to_base64(F.col("token"))
    sp, n, kind = F.lit(" "), F.col("id").cast("string"), F.col("id") % 50
    value = (
        F.when(kind == 7, b64)
        .when(kind == 8, F.concat(b64, F.lit(" x"), n))
        .when(kind == 9, F.concat(b64, F.lit(" 99999999999"), n))
        .when(kind == 10, F.concat(b64, F.lit(" +"), n, F.lit("z")))
        .when(kind == 11, F.concat(b64, F.lit("  "), n))
        .otherwise(F.concat(b64, sp, n))
    )
    own = corpora.document_vocab(spark, sf_dir).select(value.alias("value"))
    special = spark.createDataFrame(list(fixed.SPECIAL_TOKENS.items()), "token string, id int")
    return own.unionByName(
        special.select(F.concat(text.to_base64(F.col("token")), sp, n).alias("value"))
    )


@query
def load_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded, _ = vocab.load_vocab(_vocab_lines(spark, sf_dir))
    return _big(loaded.withColumn("token", F.hex("token")), "id")


@query
def load_vocab_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.load_vocab(_vocab_lines(spark, sf_dir))[1]


def _number_of(line: Column) -> Column:
    """A number that tells contents apart and may be added up."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _read_back(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """``names (repo, file_name)`` with the hash of each one's file below ``root`` as it is now."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}")
    where = F.substring_index("path", f"/{os.path.basename(root)}/", -1)
    found = files.select(
        F.substring_index(where, "/", 1).alias("repo"),
        F.substring_index(where, "/", -1).alias("file_name"),
        F.md5("content").alias("content_md5"),
    )
    return names.join(found, ["repo", "file_name"], "left")


@query
def export_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files under their names, read back."""
    root = shared_posix_path(fresh_path(spark, "part-files"))
    made = _doc_pack(spark, sf_dir, SPLIT).parts()
    manifest = stage(sinks.export_parts(made, root), "manifest")
    differing = sinks.differing_parts(manifest, root).select("repo", "part", F.lit(True).alias("differs"))
    checked = manifest.join(differing, ["repo", "part"], "left")
    named = checked.select("repo", "part", "file_name", "n_bytes", F.coalesce("differs", F.lit(False)).alias("differs"))
    return _read_back(spark, root, named)


@query
def write_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "pack")
    sinks.write_pack(_doc_pack(spark, sf_dir).placed, path, BLOCK_BYTES)
    written = spark.read.schema("value string, repo string, block string").text(path)
    return written.groupBy("repo").agg(
        F.sum(F.octet_length("value") + 1).alias("n_bytes"),
        F.count("*").alias("n_lines"),
        F.sum(_number_of(F.col("value"))).alias("digests"),
    )


@query
def write_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "parts")
    sinks.write_parts(_doc_pack(spark, sf_dir, SPLIT).parts(), path)
    written = spark.read.parquet(path)
    return written.groupBy("repo", F.col("part").cast("bigint").alias("part")).agg(
        F.sum(F.octet_length("body")).alias("n_bytes")
    )


@query
def write_reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "files")
    documents = stage(_doc_pack(spark, sf_dir).documents(), "documents")
    rebuilt = unpack.unpack_documents(documents)
    sinks.write_reconstructed(rebuilt, path)
    root = shared_posix_path(fresh_path(spark, "tree"))
    written = stage(sinks.export_files(spark.read.parquet(path), root), "written")
    listed = written.select(
        "repo", F.concat(F.lit(f"{root}/"), "repo").alias("root"), "path", F.col("n_bytes").alias("size"), F.lit(False).alias("is_dir")
    )
    found = chunks.join_contents(tree.read_contents(listed))
    return written.join(found, ["repo", "path"]).select("repo", "path", "n_bytes", F.md5("content").alias("content_md5"))


# ignore rules


@query
def compile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = _doc_pack(spark, sf_dir, PackOptions(extra_patterns=EXTRA_PATTERNS))
    return _big(pack.rules, "rule_ord")


@query
def match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = _doc_pack(spark, sf_dir)
    found = entries_op.entries(pack.files).select("repo", "path")
    return ignore.match_rules(found, pack.rules)


def _page_rules(files: DataFrame) -> DataFrame:
    none = ignore.load_ignore_rules(files)
    return ignore.compile_rules(
        ignore.extra_ignores(none, files.select("repo"), corpora.PAGE_PATTERNS)
    )


@query
def match_rules_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.page_files(spark, sf_dir)
    return ignore.match_rules(entries_op.entries(files).select("repo", "path"), _page_rules(files))


@query
def prune_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_pack(spark, sf_dir).entries.select("repo", "path", "is_dir")


@query
def prune_ignored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.page_files(spark, sf_dir)
    found = entries_op.filter_vcs(entries_op.entries(files))
    return ignore.prune_ignored(found, _page_rules(files)).select("repo", "path", "is_dir")


@query
def filter_vcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entries_op.entries(corpora.document_files(spark, sf_dir))
    return entries_op.filter_vcs(found).select("repo", "path", "is_dir")


@query
def extra_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = PackOptions(extra_patterns=EXTRA_PATTERNS)
    return _doc_pack(spark, sf_dir, options).entries.select("repo", "path", "is_dir")


@query
def no_gitignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = PackOptions(extra_patterns=EXTRA_PATTERNS, use_ignore_files=False)
    return _doc_pack(spark, sf_dir, options).entries.select("repo", "path", "is_dir")


# classification


def _per_file(name: str, value: Callable[[Column, Column], Column]) -> None:
    """Register a column function of path and content."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = corpora.document_files(spark, sf_dir)
        column = value(F.col("path"), F.col("content"))
        return files.select("repo", "path", column)

    QUERIES[name] = run


_per_file("text_by_extension", lambda p, c: paths.text_by_extension(p).alias("is_text"))
_per_file("sniff_binary", lambda p, c: text.sniff_binary(c).alias("is_binary"))
_per_file("head_of_content", lambda p, c: F.hex(text.head(c)).alias("head"))
_per_file("language_of", lambda p, c: paths.language_of(p).alias("language"))
_per_file("fence_len", lambda p, c: text.fence_len(c.cast("string")).cast("bigint").alias("fence"))
_per_file("render_heading", lambda p, c: render.heading(p).alias("heading"))
_per_file("count_tokens_approx", lambda p, c: text.count_tokens_approx(c).alias("tokens"))
_per_file(
    "count_tokens_bytes", lambda p, c: text.count_tokens_bytes(c.cast("string")).alias("tokens")
)


@query
def route_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = pieces.routed_files(_doc_pack(spark, sf_dir).visible_files)
    return routed.select("repo", "path", "n_bytes", "kind")


@query
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = corpora.document_texts(spark, sf_dir).select(
        "doc_id",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("k"),
        F.octet_length("text").cast("bigint").alias("octets"),
    )
    n = F.expr("shiftleft(octets, cast(10 * k AS int)) div 8 + doc_id")
    return sizes.select("doc_id", "k", n.alias("n")).select(
        "doc_id", "k", text.human_size(F.col("n")).alias("size")
    )


@query
def default_output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpora.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", paths.default_output_name(F.col("url")).alias("name"))


@query
def part_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpora.table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", paths.part_file_name(F.col("url"), F.col("page_id") + 1).alias("name")
    )


@query
def title_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpora.table(spark, sf_dir, "pages")
    return pages.select("page_id", paths.title_of(F.col("url")).alias("title"))


@query
def base64_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = corpora.document_texts(spark, sf_dir).select(
        "doc_id", text.to_base64(F.col("text")).alias("b64")
    )
    return coded.select("doc_id", "b64", F.md5(text.from_base64(F.col("b64"))).alias("back"))


# statistics


@query
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_pack(spark, sf_dir).stats


@query
def doc_stats_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_pack(spark, sf_dir, PackOptions(token_mode="bytes")).stats


@query
def doc_stats_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by the vocabulary, the default where one is given."""
    files = corpora.document_files(spark, sf_dir)
    return Pack(files, vocab=corpora.document_vocab(spark, sf_dir)).stats


@query
def entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_op.entry_counts(_doc_pack(spark, sf_dir).entries)


@query
def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources and, as repositories without files, one per language."""
    files = corpora.document_files(spark, sf_dir)
    sources = files.select("repo").distinct()
    langs = corpora.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("no-"), "lang").alias("repo")
    )
    everything = (
        sources.filter(F.col("repo").endswith("1"))
        .withColumn("rule_ord", F.lit(1))
        .withColumn("pattern", F.lit("/"))
    )
    found = entries_op.entries(files)
    rules = ignore.ignore_matchers(ignore.compile_rules(everything))
    listing = ignore.mark_kept(found, rules).withColumn(
        "kept", F.col("kept") & ~paths.in_vcs_dir(F.col("path"))
    )
    return entries_op.corpus_status(sources.unionByName(langs), listing)


# order and rendering


@query
def entry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = ordering.entry_order(_doc_pack(spark, sf_dir).entries)
    return ordered.select("repo", "path", "is_dir", "position")


@query
def hier_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted entries, each with its rank in the total order."""
    found = entries_op.entries(corpora.page_files(spark, sf_dir))
    ranked = ordering.ranks(found, [F.col("repo"), paths.sort_key(F.col("path"))])
    return ordering.hier_sort(ranked).select("repo", "path", "rank")


def _key_path() -> Column:
    return F.replace("key", F.char(F.lit(0)), F.lit("/"))


@query
def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pieces.tree_pieces(_doc_pack(spark, sf_dir).entries)
    return lines.select(
        "repo",
        _key_path().alias("path"),
        F.col("text").alias("line"),
        F.get("counted", F.lit(0)).alias("counted"),
    )


def _rendered(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    files = _doc_pack(spark, sf_dir).visible_files
    return pieces.rendered_files(files).filter(F.col("kind") == kind).select("repo", "path", "body")


@query
def render_text_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "text")


@query
def render_binary_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "binary")


@query
def summary_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_pack(spark, sf_dir).summary.select("repo", "text")


@query
def structure_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without contents, summary included, in blocks."""
    options = PackOptions(structure_only=True, block_bytes=SMALL_BLOCK)
    return _doc_pack(spark, sf_dir, options).documents()


@query
def assemble_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_pack(spark, sf_dir, PackOptions(block_bytes=BLOCK_BYTES)).documents()


@query
def piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = _doc_pack(spark, sf_dir).offsets
    return offsets.select(
        "repo",
        F.col("section").cast("bigint").alias("section"),
        _key_path().alias("path"),
        "ord",
        "start",
        "n_bytes",
    )


@query
def lint_missing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _big(lint.lint_missing_docs(corpora.document_files(spark, sf_dir)), "line_no")


# splitting


@query
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_pack(spark, sf_dir, SPLIT).split_candidates()


@query
def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _big(_doc_pack(spark, sf_dir, SPLIT).split_points(), "split_no")


@query
def split_points_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = PackOptions(split=True, limit_mb=LIMIT_MB, max_splits=SMALL_MAX_SPLITS)
    return _big(_doc_pack(spark, sf_dir, options).split_points(), "split_no")


@query
def continuation_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _big(_doc_pack(spark, sf_dir, SPLIT).continuation_notices(), "part", "n_parts")


@query
def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _doc_pack(spark, sf_dir, SPLIT).parts()
    return made.select(
        "repo",
        F.col("part").cast("bigint").alias("part"),
        "file_name",
        "start",
        "end",
        F.sha2("body", 256).alias("body_sha"),
    )


@query
def oversize_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = PackOptions(limit_mb=OVERSIZE_MB, on_oversize="structure_only")
    return _doc_pack(spark, sf_dir, options).policy


@query
def oversize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = PackOptions(limit_mb=OVERSIZE_MB, on_oversize="structure_only")
    return (
        _doc_pack(spark, sf_dir, options)
        .offsets.groupBy("repo")
        .agg(F.count("*").alias("n_pieces"), F.sum("n_bytes").alias("n_bytes"))
    )


# reconstruction


@query
def reconstruct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _doc_pack(spark, sf_dir, PackOptions(block_bytes=BLOCK_BYTES)).documents()
    return unpack.unpack_documents(stage(documents, "documents"))


QUERIES["reconstruct"] = QUERIES.pop("reconstruct_documents")


@query
def reconstruct_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack.unpack_parts(stage(_doc_pack(spark, sf_dir, SPLIT).parts(), "parts"))


@query
def binary_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with a binary note at the start, an error note in a line, or none."""
    kind, nl, whole = F.col("doc_id") % 3, F.lit("\n"), F.col("text")
    body = (
        F.when(kind == 0, F.concat(whole, nl, F.lit("*Error reading file*\n"), whole))
        .when(kind == 1, F.concat(F.lit("*Binary file*\n"), whole))
        .otherwise(F.concat(whole, F.lit(" *Error\n"), whole))
    )
    texts = corpora.document_texts(spark, sf_dir)
    return texts.select("doc_id", reconstruct.placeholder_cut(body).alias("content"))


@query
def roundtrip_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = _doc_pack(spark, sf_dir)
    rebuilt = unpack.unpack_documents(stage(pack.documents(), "documents"))
    return reconstruct.roundtrip_diff(pack.visible_files, rebuilt)


# tokens


def _vocabulary(spark: SparkSession, sf_dir: str) -> tokens.Vocabulary:
    return tokens.Vocabulary(corpora.document_vocab(spark, sf_dir))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pretoken_counts(corpora.document_texts(spark, sf_dir), "text")


@query
def pretokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir)


@query
def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of conversations that are, as a whole, a special token.

    Special are the texts of each conversation's last turn, the ids of which go by the
    order of these; all texts of all turns are looked up.
    """
    turns = corpora.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    texts = stage(last.select("text").distinct(), "special")
    special = ordering.ranks(texts, [F.col("text")]).select(
        F.col("text").cast("binary").alias("token"),
        (F.col("rank") + SPECIAL_ID + 1).cast("int").alias("id"),
        F.lit(True).alias("is_special"),
    )
    both = corpora.document_vocab(spark, sf_dir).unionByName(special)
    hits = tokens.special_token_ids(turns, ["conv_id", "turn"], "text", tokens.Vocabulary(both))
    return _big(hits, "id")


@query
def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.vocab_lookup(_dictionary(spark, sf_dir), _vocabulary(spark, sf_dir))
    return _big(found, "id").select("pretoken", "id")


@query
def fallback_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = tokens.chunks_of_unknown(_dictionary(spark, sf_dir), _vocabulary(spark, sf_dir))
    return _big(chunks.withColumn("chunk", F.hex("chunk")), "chunk_pos")


@query
def byte_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = tokens.price_pretokens(_dictionary(spark, sf_dir), _vocabulary(spark, sf_dir))
    return priced.select("pretoken", "price")


@query
def count_tokens_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpora.document_texts(spark, sf_dir)
    return tokens.count_tokens_vocab(texts, ["doc_id"], "text", _vocabulary(spark, sf_dir))


@query
def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpora.document_texts(spark, sf_dir)
    ids = tokens.encode_ids(texts, ["doc_id"], "text", _vocabulary(spark, sf_dir))
    return ids.select("doc_id", F.array_join("ids", ",").alias("ids"))


@query
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpora.document_texts(spark, sf_dir)
    return _big(tokens.token_histogram(texts, "text", _vocabulary(spark, sf_dir)), "id")


@query
def apply_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts with a merge table: vocabulary pretokens of two bytes as merges.

    And those of three bytes whose first two are one, as merges of these with the third.
    """
    words = corpora.document_vocab(spark, sf_dir)
    two = words.filter(F.octet_length("token") == 2)
    three = words.filter(F.octet_length("token") == 3).withColumn("first", F.substring("token", 1, 2))
    three = three.join(two.select(F.col("token").alias("first")), "first", "left_semi")
    table = two.select(
        F.substring("token", 1, 1).alias("first"),
        F.substring("token", 2, 1).alias("second"),
        F.col("id").alias("rank"),
    ).unionByName(three.select("first", F.substring("token", 3, 1).alias("second"), F.col("id").alias("rank")))
    texts = corpora.document_texts(spark, sf_dir)
    vocabulary = tokens.Vocabulary(words)
    look_up = merges.dictionary_ids(stage(table, "merge-table"), vocabulary)
    return tokens.count_tokens_vocab(texts, ["doc_id"], "text", vocabulary, look_up)
