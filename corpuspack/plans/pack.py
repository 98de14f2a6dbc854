"""The whole way from files to documents and parts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack import fixed, schemas
from corpuspack.functions.paths import in_vcs_dir
from corpuspack.operators import entries as entries_op
from corpuspack.operators import chunks, ignore, joins, pieces, split
from corpuspack.options import PackOptions
from corpuspack.sources.staging import stage


class Pack:
    """Documents of many repositories.

    Steps are built when asked for. What several steps read, and what must not
    change between them, is staged: a few tables with a row per repository, and
    narrow ones with a row per entry or piece. Texts are not staged but read from
    the files again.
    """

    def __init__(
        self,
        files: DataFrame,
        options: PackOptions | None = None,
        vocab: DataFrame | None = None,
        repos: DataFrame | None = None,
        entries: DataFrame | None = None,
    ) -> None:
        """``files`` is ``(repo, path, content)``; ``repos`` may add a ``directory``.

        Files of any size are given in chunks, as ``read_contents`` and ``cut_contents``
        make them. ``entries`` gives the listing where it holds more than ``files`` tells,
        such as empty directories.
        """
        self.files = files
        self._chunked = "chunk" in files.columns
        self.options = options or PackOptions()
        self.vocab = vocab
        self._given_repos = repos
        self._given_entries = entries

    @cached_property
    def _names(self) -> DataFrame:
        """A row for each file."""
        return self.files.filter("chunk = 0") if self._chunked else self.files

    @cached_property
    def _ignore_files(self) -> DataFrame:
        """The files that may hold rules, whole."""
        if not self._chunked:
            return self.files
        return chunks.join_contents(self.files.filter(F.col("path") == fixed.IGNORE_FILE))

    @cached_property
    def repos(self) -> DataFrame:
        """The repositories to document."""
        if self._given_repos is not None:
            return self._given_repos
        return self.listing.select("repo").distinct()

    @cached_property
    def rules(self) -> DataFrame:
        """Compiled rules: those of the ignore files, then the caller's."""
        if self.options.use_ignore_files:
            patterns = ignore.load_ignore_rules(self._ignore_files)
        else:
            patterns = self.files.sparkSession.createDataFrame([], schemas.PATTERNS)
        repos = self._names if self._given_repos is None else self._given_repos
        return ignore.compile_rules(
            ignore.extra_ignores(patterns, repos, self.options.extra_patterns)
        )

    @cached_property
    def matchers(self) -> DataFrame:
        """One regex per repository that has rules."""
        if self.options.use_ignore_files and not self.options.extra_patterns:
            return stage(ignore.file_matchers(self._ignore_files), "matchers")
        return stage(ignore.ignore_matchers(self.rules), "matchers")

    @cached_property
    def listing(self) -> DataFrame:
        """All entries, with ``kept``: whether they are shown.

        A path that occurs twice in a repository is an error: it names one file, and
        which of them is meant cannot be told.
        """
        found = self._given_entries
        if found is None:
            found = entries_op.entries(self._names)
        marked = ignore.mark_kept(found, self.matchers, joins.join_by_key)
        if not self.options.include_vcs:
            marked = marked.withColumn("kept", F.col("kept") & ~in_vcs_dir(F.col("path")))
        listing = stage(marked, "listing")
        again = listing.groupBy("repo", "path").agg(F.count("*").alias("n")).filter("n > 1")
        for row in again.limit(1).collect():
            raise ValueError(f"{row.n} entries of {row.repo!r} have the path {row.path!r}")
        return listing

    @cached_property
    def entries(self) -> DataFrame:
        """Entries that are shown."""
        return self.listing.filter("kept").drop("kept")

    @cached_property
    def visible_files(self) -> DataFrame:
        """Files that are shown, with content.

        Few matchers come to the contents. Many do not: paths are judged as narrow rows, and
        contents meet the verdicts by path, which deals them evenly.
        """
        files = entries_op.filter_vcs(self.files, self.options.include_vcs)
        if joins.small_enough(self.matchers, joins.KEYED_BYTES):
            return ignore.prune(files, F.broadcast(self.matchers))
        shown = self.entries.filter("NOT is_dir").select("repo", "path")
        return files.join(shown, ["repo", "path"], "left_semi")

    @cached_property
    def status(self) -> DataFrame:
        return entries_op.corpus_status(self.repos, self.listing)

    @cached_property
    def body(self) -> DataFrame:
        """All pieces but the summary. An empty repository gets no document."""
        repos = self.repos
        if self._given_repos is not None:
            repos = repos.join(self.listing.select("repo").distinct(), "repo", "left_semi")
        only = self.options.structure_only
        facts = self._facts if self._chunked and not only else None
        return pieces.body_pieces(repos, self.entries, self.visible_files, only, facts)

    @property
    def _token_mode(self) -> str:
        return self.options.token_mode or ("approx" if self.vocab is None else "vocab")

    @cached_property
    def _facts(self) -> DataFrame:
        """What is known of files of several chunks."""
        return stage(chunks.file_facts(self.visible_files, self._token_mode, self.vocab), "facts")

    @cached_property
    def ledger(self) -> DataFrame:
        return stage(pieces.ledger(self.body, self._token_mode, self.vocab), "ledger")

    @cached_property
    def stats(self) -> DataFrame:
        """Counted bytes and tokens per document."""
        return pieces.doc_stats(self.ledger)

    @cached_property
    def summary(self) -> DataFrame:
        return pieces.summary_pieces(self.stats, self.options.split)

    @cached_property
    def _sizes(self) -> DataFrame:
        """Bytes of every piece, the summary included."""
        summary = self.summary.select(
            *pieces.KEY,
            F.octet_length("text").cast("bigint").alias("n_bytes"),
            F.lit(True).alias("inner"),
            "line",
        )
        return self.ledger.select(*pieces.KEY, "n_bytes", "inner", "line").unionByName(summary)

    @cached_property
    def policy(self) -> DataFrame:
        """Size of every document and what is done with it."""
        options = self.options
        policy = split.oversize_policy(
            split.document_bytes(self._sizes),
            options.limit_bytes,
            options.split,
            options.on_oversize,
        )
        return stage(policy, "policy")

    def _governed(self, rows: DataFrame) -> DataFrame:
        if self.options.split or self.options.on_oversize in ("keep", "split"):
            return rows
        return split.apply_policy(rows, self.policy)

    @cached_property
    def offsets(self) -> DataFrame:
        """Position and offset of every piece that is written."""
        offsets = pieces.piece_offsets(self._governed(self._sizes))
        if self._chunked:
            offsets = pieces.whole_lines(stage(offsets, "piece-offsets"))
        return stage(offsets, "offsets")

    @cached_property
    def _texts(self) -> DataFrame:
        return self.body.unionByName(self.summary)

    @cached_property
    def placed(self) -> DataFrame:
        """Every piece that is written, with text and offset."""
        return pieces.place(self._texts, self.offsets)

    def documents(self) -> DataFrame:
        """Document text ``(repo, block, start, text)``, one row where it fits."""
        return pieces.assemble_document(self.placed, self.options.block_bytes)

    @cached_property
    def _split_docs(self) -> DataFrame:
        return self.policy.filter(F.col("action") == "split")

    def split_candidates(self) -> DataFrame:
        return split.split_candidates(self._texts, self.offsets, self._split_docs)

    @cached_property
    def split_plan(self) -> DataFrame:
        """The cuts of every document that is split."""
        plan = split.split_plan(
            self._texts,
            self.offsets,
            self._split_docs,
            self.options.limit_bytes,
            self.options.max_splits,
        )
        return stage(plan, "split-plan")

    def split_points(self) -> DataFrame:
        return split.split_points(self.split_plan)

    def continuation_notices(self) -> DataFrame:
        return split.continuation_notices(self.split_plan)

    def parts(self) -> DataFrame:
        """Parts of the documents that are split, with file names."""
        options = self.options
        bounds = split.name_parts(split.part_bounds(self.split_plan), self.repos)
        return split.parts(
            self._texts, self.offsets, bounds, options.limit_bytes, options.block_bytes
        )
