"""Cutting documents into parts of limited size.

Cuts depend on each other, but only through one number, the last cut. So a document's
narrow candidate rows are dealt in slices. For each slice, all at once, it is worked out
where it is left for every line start it may be entered at: all step on together, and
as walks that share one cut share all later ones, few are left soon. The slices of a
document are then chained by these maps, a few numbers each, and walked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspack import fixed
from corpuspack.functions import render
from corpuspack.functions.paths import default_output_name, part_file_name
from corpuspack.operators.pieces import CONTENTS, FILE, KEY, TREE, place
from corpuspack.sources.staging import stage

NEWLINE, BREAK, MARKER = 1, 2, 3
LINES_HELD = 1 << 18  # rows of a batch of line starts, about
_LINES = pa.schema([("repo", pa.string()), ("pos", pa.int64()), ("kind", pa.int32())])
SLICE_CUTS = 100  # of a document are decided in a task, which bounds the candidates it holds
KIND_NAMES = {NEWLINE: "newline", BREAK: "break", MARKER: "marker"}


def document_bytes(offsets: DataFrame) -> DataFrame:
    """Total bytes per document."""
    return offsets.groupBy("repo").agg(F.sum("n_bytes").alias("doc_bytes"))


def oversize_policy(totals: DataFrame, limit: int, split: bool, on_oversize: str) -> DataFrame:
    """What to do with each document: whole, split, structure_only or drop.

    A document that is not split anyway is oversize when its text and one more
    byte exceed the limit.
    """
    oversize = F.col("doc_bytes") + 1 > limit
    special = "whole" if on_oversize == "keep" else on_oversize
    action = F.lit("split") if split else F.when(oversize, special).otherwise("whole")
    return totals.select("repo", "doc_bytes", oversize.alias("oversize"), action.alias("action"))


def apply_policy(pieces: DataFrame, policy: DataFrame) -> DataFrame:
    """Drop documents, or their contents, as the policy says; token totals stay."""
    return (
        pieces.join(policy.select("repo", "action"), "repo")
        .filter(
            (F.col("action") != "drop")
            & ((F.col("action") != "structure_only") | (F.col("section") < CONTENTS))
        )
        .drop("action")
    )


def _begin_with(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: bytes) -> np.ndarray:
    """Which of the lines from ``starts`` to ``ends`` begin so."""
    found = ends - starts >= len(prefix)
    for i, byte in enumerate(prefix):
        at = np.flatnonzero(found)
        found[at] = data[starts[at] + i] == byte
    return found


def lines_of(data: np.ndarray, start: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each line of a piece begins in its document of ``total`` bytes, and its best use.

    The piece's bytes ``data`` begin at ``start``. A prefix may not reach the end of the
    document. What follows a last newline is no line.
    """
    newlines = np.flatnonzero(data == ord("\n"))
    starts = np.append(0, newlines + 1)
    ends = np.append(newlines, len(data))
    if len(newlines) and newlines[-1] == len(data) - 1:
        starts, ends = starts[:-1], ends[:-1]
    pos = start + starts
    kind = np.full(len(pos), NEWLINE, np.int32)
    section = fixed.SECTION_MARKER.encode()
    kind[_begin_with(data, starts, ends, section) & (pos + 1 + len(section) < total)] = BREAK
    kind[(starts == ends) & (pos + 1 < total)] = BREAK
    marker = fixed.FILE_MARKER.encode()
    kind[_begin_with(data, starts, ends, marker) & (pos + len(marker) < total)] = MARKER
    return pos, kind


def _line_starts(placed: DataFrame, every_line: Column) -> DataFrame:
    """``(repo, pos, kind)`` of the line starts in the given pieces, or of the marker lines only.

    A piece knows where it begins, so its lines are placed where its text is: nothing is
    shuffled, and of chunks each counts on from its own ``start``.
    """
    within = F.lit(False)
    if "line" in placed.columns:  # of chunks: the one their first line begins in
        within = F.coalesce(F.col("line") < F.col("nth"), within)

    def rows(repos: list[str], pos: list[np.ndarray], kind: list[np.ndarray]) -> pa.RecordBatch:
        lengths = [len(p) for p in pos]
        names = pa.array(repos, pa.string()).take(pa.array(np.repeat(np.arange(len(repos)), lengths)))
        columns = {"repo": names, "pos": np.concatenate(pos), "kind": np.concatenate(kind)}
        return pa.RecordBatch.from_pydict(columns, _LINES)

    def place_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[list, list, list] = ([], [], [])
            n = 0
            facts = batch.drop_columns(["text"]).to_pylist()
            for row, text in zip(facts, batch["text"]):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                pos, kind = lines_of(data, row["start"], row["doc_bytes"])
                use = np.full(len(pos), row["every_line"]) | (kind == MARKER)
                use[:1] &= not row["within"]
                pos, kind = pos[use], kind[use]
                for i in range(0, len(pos), LINES_HELD):
                    some = slice(i, i + LINES_HELD)
                    for values, value in zip(held, (row["repo"], pos[some], kind[some])):
                        values.append(value)
                    n += len(pos[some])
                    if n >= LINES_HELD:
                        yield rows(*held)
                        held, n = ([], [], []), 0
            if n:
                yield rows(*held)

    narrow = placed.select(
        "repo",
        "start",
        "doc_bytes",
        every_line.alias("every_line"),
        within.alias("within"),
        F.col("text").cast("binary").alias("text"),
    )
    return narrow.mapInArrow(place_lines, "repo string, pos bigint, kind int")


def split_candidates(pieces: DataFrame, offsets: DataFrame, totals: DataFrame) -> DataFrame:
    """All places where a part may start: ``(repo, pos, kind)``.

    Every piece ends with a newline, so each candidate is the start of a line, or
    the end of the document, and its kind depends on that line only.
    """
    sized = offsets.join(totals.select("repo", "doc_bytes"), "repo")
    starts = _line_starts(place(pieces, sized), F.lit(True))
    ends = totals.select("repo", F.col("doc_bytes").alias("pos"), F.lit(NEWLINE).alias("kind"))
    names = F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv])
    return (
        starts.filter(F.col("pos") > 0)
        .unionByName(ends)
        .select("repo", "pos", names[F.col("kind")].alias("kind"))
    )


def _useful_candidates(
    pieces: DataFrame, offsets: DataFrame, totals: DataFrame, limit: int, max_splits: int | None
) -> DataFrame:
    """The candidates that can become a cut, ``(repo, pos, kind)``.

    * Documents within the limit have no cuts, and if their number is limited, none
      lies beyond ``max_splits * (limit + 1)``.
    * A file section of at most half a limit is never cut inside, unless at a
      marker line in its content: any window that reaches such a place also
      reaches the marker at the section's start or at the next one. (A newline
      may lie 200 bytes further back, hence the lower bound on the limit.)
    * A tree line is one line, and no marker or break.

    So most pieces give one row from their offset alone. Which texts are looked
    at is decided on narrow rows before the texts are joined.
    """
    reach = F.lit(None if max_splits is None else max_splits * (limit + 1)).cast("bigint")

    def within(pos: Column) -> Column:
        return reach.isNull() | (pos <= reach)

    long_docs = totals.filter(F.col("doc_bytes") > limit).select("repo", "doc_bytes")
    near = offsets.filter(within(F.col("start"))).join(long_docs, "repo")
    short_file = (
        (F.col("section") == FILE)
        & F.lit(limit >= 2 * fixed.NEWLINE_WINDOW)
        & (F.col("n_bytes") <= (limit + 1) // 2)
        & F.col("line").isNull()
    )
    by_offset = (short_file | (F.col("section") == TREE)) & ~F.col("inner")
    starts = near.filter(by_offset).select(
        "repo",
        F.col("start").alias("pos"),
        F.when(F.col("section") == FILE, MARKER).otherwise(NEWLINE).alias("kind"),
    )
    looked_at = near.filter(~by_offset).withColumn("every_line", ~short_file)
    lines = _line_starts(place(pieces, looked_at), F.col("every_line"))
    ends = long_docs.select(
        "repo", F.col("doc_bytes").alias("pos"), F.lit(NEWLINE).alias("kind")
    )
    return (
        starts.unionByName(lines)
        .unionByName(ends)
        .filter((F.col("pos") > 0) & within(F.col("pos")))
    )


def walk(
    pos: np.ndarray,
    kind: np.ndarray,
    total: int,
    limit: int,
    max_splits: int | None,
    last: int = 0,
    stop: int | None = None,
) -> list[int]:
    """Cuts of one document after ``last`` up to the first one not before ``stop``.

    ``pos`` and ``kind`` are its sorted candidate line starts.

    From the last cut, the next window ends ``limit`` bytes on. In its second half
    the first marker wins, else the last break, else the last newline within 200
    bytes of the end, else the end itself.
    """
    before = pos - 1  # the newline in front of each candidate
    markers, breaks = before[kind == MARKER], before[kind == BREAK]
    cuts: list[int] = []
    while (
        last + limit < total
        and (max_splits is None or len(cuts) < max_splits)
        and (stop is None or last < stop)
    ):
        half, end = last + limit // 2, last + limit
        near_end = max(last, end - fixed.NEWLINE_WINDOW)
        m = int(np.searchsorted(markers, half, "left"))
        b = int(np.searchsorted(breaks, end, "right")) - 1
        n = int(np.searchsorted(before, end, "right")) - 1
        if m < len(markers) and markers[m] < end:
            last = int(markers[m]) + 1
        elif b >= 0 and breaks[b] > half:
            last = int(breaks[b]) + 1
        elif end >= fixed.NEWLINE_WINDOW and n >= 0 and before[n] > near_end:
            last = int(before[n]) + 1
        else:
            last = end
        cuts.append(last)
    return cuts


def _in_slices(candidates: DataFrame, limit: int, span: int) -> DataFrame:
    """Candidates with every ``slice`` that may look at them: ``span`` bytes, and a limit beyond."""
    at = F.floor(F.col("pos") / span)
    before = F.floor((F.col("pos") - limit - 1) / span)
    return candidates.withColumn("slice", F.explode(F.sequence(F.greatest(before, F.lit(0)), at)))


class _Starts:
    """The candidates of a slice, and where a cut leads."""

    def __init__(self, pos: np.ndarray, kind: np.ndarray, total: int, limit: int, stop: int):
        order = np.argsort(pos, kind="stable")
        self.pos = pos[order]
        self._before = self.pos - 1
        self._markers = self._before[kind[order] == MARKER]
        self._breaks = self._before[kind[order] == BREAK]
        self._total, self._limit, self._stop = total, limit, stop

    def _next(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cut after each of these, as ``walk`` has it, and whether no line starts there."""
        half, end = last + self._limit // 2, last + self._limit
        near = np.maximum(last, end - fixed.NEWLINE_WINDOW)

        def at(values: np.ndarray, place: np.ndarray) -> np.ndarray:
            return np.append(values, -1)[np.where((place >= 0) & (place < len(values)), place, -1)]

        marker = at(self._markers, np.searchsorted(self._markers, half, "left"))
        chosen = np.where((marker >= half) & (marker < end), marker, -1)
        rest = at(self._breaks, np.searchsorted(self._breaks, end, "right") - 1)
        chosen = np.where((chosen < 0) & (rest > half), rest, chosen)
        line = at(self._before, np.searchsorted(self._before, end, "right") - 1)
        chosen = np.where((chosen < 0) & (end >= fixed.NEWLINE_WINDOW) & (line > near), line, chosen)
        return np.where(chosen < 0, end, chosen + 1), chosen < 0

    def exits(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the slice is left from each entry, and whether no line starts there."""
        now, group = np.unique(entries, return_inverse=True)
        hard = np.zeros(len(now), bool)
        while True:
            open_ = np.flatnonzero((now + self._limit < self._total) & (now < self._stop))
            if not len(open_):
                return now[group], hard[group]
            now[open_], hard[open_] = self._next(now[open_])
            now, first, merged = np.unique(now, return_index=True, return_inverse=True)
            hard, group = hard[first], merged[group]


_WAY = "repo string, slice bigint, first bigint, last bigint, exit bigint, hard boolean"


def _ways(sliced: DataFrame, todo: DataFrame, limit: int, span: int) -> DataFrame:
    """Where slices are left: rows of entries ``first`` to ``last`` that all lead to ``exit``.

    ``todo`` is ``(repo, slice, doc_bytes, entry)``; a null entry stands for all line
    starts that the slice may be entered at.
    """

    def work(table: pa.Table) -> pa.Table:
        given = table.filter(pa.compute.equal(table["kind"], 0))
        rows = table.filter(pa.compute.not_equal(table["kind"], 0))
        start = given["slice"][0].as_py() * span
        pos = rows["pos"].to_numpy()
        starts = _Starts(pos, rows["kind"].to_numpy(), given["doc_bytes"][0].as_py(), limit, start + span)
        asked = np.array([e for e in given["pos"].to_pylist() if e is not None], np.int64)
        entries = [asked]
        if given["pos"].null_count:
            inside = (starts.pos >= start) & (starts.pos <= start + limit)
            entries += [starts.pos[inside], np.zeros(int(start == 0), np.int64)]
        entries = np.unique(np.concatenate(entries))
        exits, hard = starts.exits(entries)
        new = np.flatnonzero(np.append(True, exits[1:] != exits[:-1])) if len(exits) else exits
        if len(asked):  # each on its own, as others between them may lead elsewhere
            new = np.arange(len(entries))
        ends = np.append(new, len(entries))[1:] - 1
        return pa.table(
            {
                "repo": pa.array([given["repo"][0].as_py()] * len(new), pa.string()),
                "slice": pa.array([given["slice"][0].as_py()] * len(new), pa.int64()),
                "first": pa.array(entries[new], pa.int64()),
                "last": pa.array(entries[ends], pa.int64()),
                "exit": pa.array(exits[new], pa.int64()),
                "hard": pa.array(hard[new], pa.bool_()),
            }
        )

    here = todo.select("repo", "slice", "doc_bytes", F.col("entry").alias("pos"), F.lit(0).alias("kind"))
    which = todo.select("repo", "slice", "doc_bytes").distinct()
    near = sliced.join(which, ["repo", "slice"]).select(*here.columns)
    return near.unionByName(here).groupBy("repo", "slice").applyInArrow(work, _WAY)


def _chained(slices: DataFrame, ways: DataFrame, limit: int, span: int) -> DataFrame:
    """``(repo, slice, entry, known)``: where each slice of a document is entered.

    A document is one group of its slices' few ways. An entry where no line starts may have
    no way yet: it is not ``known``, and the chain goes on from the nearest one, as a guess.
    """

    def work(table: pa.Table) -> pa.Table:
        by_slice: dict[int, list[dict]] = {}
        following, total = {}, table["doc_bytes"][0].as_py()
        for row in table.to_pylist():
            own = by_slice.setdefault(row["slice"], [])
            following[row["slice"]] = row["following"]
            if row["exit"] is not None:
                own.append(row)
        out = []
        at, entry, hard = 0, 0, False
        while at is not None:
            own = by_slice[at]
            way = next((w for w in own if w["first"] == w["last"] == entry), None)
            if way is None and not hard:
                way = next((w for w in own if w["first"] <= entry <= w["last"]), None)
            beyond = entry + limit >= total or entry >= (at + 1) * span
            out.append((at, entry, way is not None or beyond))
            if beyond:
                pass
            elif way is not None:
                entry, hard = way["exit"], way["hard"]
            elif own:
                way = min(own, key=lambda w: min(abs(w["first"] - entry), abs(w["last"] - entry)))
                entry, hard = way["exit"], way["hard"]
            at = following[at]
            if at is not None:
                room = min(at * span, total - limit) - entry
                if room > 0:
                    entry, hard = entry + -(-room // limit) * limit, True
        columns = [list(c) for c in zip(*out)]
        repo = pa.array([table["repo"][0].as_py()] * len(out), pa.string())
        return pa.table(
            {"repo": repo, "slice": pa.array(columns[0], pa.int64()), "entry": pa.array(columns[1], pa.int64()), "known": columns[2]}
        )

    rows = slices.join(ways, ["repo", "slice"], "left")
    return rows.groupBy("repo").applyInArrow(work, "repo string, slice bigint, entry bigint, known boolean")


def _walked(sliced: DataFrame, entered: DataFrame, limit: int, span: int) -> DataFrame:
    """``(repo, slice, entry, cuts)``: the cuts of each slice from its ``entry`` on."""

    def cut(table: pa.Table) -> pa.Table:
        pos = table["pos"].to_numpy()
        order = np.argsort(pos, kind="stable")
        kind = table["kind"].to_numpy()[order]
        first = {c: table[c][0].as_py() for c in ("repo", "slice", "doc_bytes", "entry")}
        stop = (first["slice"] + 1) * span
        cuts = walk(pos[order], kind, first["doc_bytes"], limit, None, first["entry"], stop)
        return pa.table(
            {
                "repo": pa.array([first["repo"]], pa.string()),
                "slice": pa.array([first["slice"]], pa.int64()),
                "entry": pa.array([first["entry"]], pa.int64()),
                "cuts": pa.array([cuts], pa.list_(pa.int64())),
            }
        )

    # of no kind, so that a slice without a line start in reach has a row too
    here = entered.select("repo", "slice", "doc_bytes", "entry", F.col("entry").alias("pos"), F.lit(0).alias("kind"))
    near = sliced.join(entered.select("repo", "slice", "doc_bytes", "entry"), ["repo", "slice"]).filter(
        F.col("pos") > F.col("entry")
    )
    rows = near.select(*here.columns).unionByName(here)
    return rows.groupBy("repo", "slice").applyInArrow(
        cut, "repo string, slice bigint, entry bigint, cuts array<bigint>"
    )


def _hard_cuts(last: Column, limit: int, span: int) -> Column:
    """Cuts between the ``last`` one of a slice and the start of the ``following``, where no line starts.

    Nothing can be chosen there, so they are a limit apart.
    """
    room = F.least(F.col("following") * span, F.col("doc_bytes") - limit) - last
    n = F.when(room > 0, F.ceil(room / limit)).otherwise(0)
    steps = F.filter(F.sequence(F.lit(0).cast("bigint"), n), lambda k: k > 0)
    return F.transform(steps, lambda k: last + k * limit)


def _entered(sliced: DataFrame, slices: DataFrame, limit: int, span: int) -> DataFrame:
    """``slices`` with the ``entry`` of each; of documents with a single slice it is 0."""
    several = slices.filter("slice > 0").select("repo").distinct()
    chained = stage(slices.join(several, "repo", "left_semi"), "chained")
    alone = slices.filter("slice = 0 AND following IS NULL").withColumn("entry", F.lit(0).cast("bigint"))
    if chained.isEmpty():
        return alone
    todo = chained.withColumn("entry", F.lit(None).cast("bigint"))
    ways = stage(_ways(sliced, todo, limit, span), "ways")
    while True:
        entered = stage(_chained(chained, ways, limit, span), "entered")
        unknown = entered.filter("NOT known").drop("known")
        if unknown.isEmpty():
            break
        todo = chained.select("repo", "slice", "doc_bytes").join(unknown, ["repo", "slice"])
        ways = ways.unionByName(stage(_ways(sliced, todo, limit, span), "ways"))
    return alone.unionByName(chained.join(entered.drop("known"), ["repo", "slice"]).select(*alone.columns))


def split_plan(
    pieces: DataFrame,
    offsets: DataFrame,
    totals: DataFrame,
    limit: int,
    max_splits: int | None = None,
    slice_cuts: int = SLICE_CUTS,
) -> DataFrame:
    """``(repo, doc_bytes, cuts)`` for every document in ``totals``.

    A slice is what ``slice_cuts`` limits reach; no task holds more candidates. Slices without
    a line start in reach need no walk. Where cuts lie within lines, a slice may be entered
    where no way is known; these are worked out, for all slices at once, in further rounds.
    """
    if limit < 1:
        raise ValueError("the limit must be at least one byte")
    span = slice_cuts * limit
    candidates = _useful_candidates(pieces, offsets, totals, limit, max_splits)
    sliced = stage(_in_slices(candidates, limit, span), "candidates")
    docs = totals.filter(F.col("doc_bytes") > limit).select("repo", "doc_bytes")
    order = Window.partitionBy("repo").orderBy("slice")
    slices = (
        sliced.select("repo", "slice")
        .unionByName(docs.select("repo", F.lit(0).cast("bigint").alias("slice")))
        .distinct()
        .join(docs, "repo")
        .withColumn("following", F.lead("slice").over(order))
    )
    entered = stage(_entered(sliced, stage(slices, "slices"), limit, span), "entered")
    walked = entered.join(_walked(sliced, entered, limit, span).drop("entry"), ["repo", "slice"])
    last = F.when(F.size("cuts") > 0, F.element_at("cuts", -1)).otherwise(F.col("entry"))
    none = F.array().cast("array<bigint>")
    between = F.when(F.col("following").isNull(), none).otherwise(_hard_cuts(F.col("last"), limit, span))
    found = walked.withColumn("last", last).withColumn("cuts", F.concat("cuts", between))
    found = found.groupBy("repo").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("slice", "cuts"))), lambda r: r["cuts"])
        ).alias("cuts")
    )
    cuts = F.coalesce("cuts", none)
    if max_splits is not None:
        cuts = F.slice(cuts, F.lit(1), F.lit(max_splits))
    return totals.select("repo", "doc_bytes").join(found, "repo", "left").withColumn("cuts", cuts)


def split_points(plan: DataFrame) -> DataFrame:
    """``(repo, split_no, cut)``, one row per cut."""
    return plan.select("repo", F.posexplode("cuts").alias("n", "cut")).select(
        "repo", (F.col("n") + 1).alias("split_no"), "cut"
    )


def part_bounds(plan: DataFrame) -> DataFrame:
    """``(repo, part, n_parts, part_start, part_end)``, one row per part."""
    starts = F.concat(F.array(F.lit(0).cast("bigint")), "cuts").alias("part_start")
    ends = F.concat("cuts", F.array("doc_bytes")).alias("part_end")
    bounds = plan.select(
        "repo",
        (F.size("cuts") + 1).alias("n_parts"),
        # the arrays do not go on with each of their elements
        F.posexplode(F.arrays_zip(starts, ends)).alias("n", "at"),
    )
    return bounds.select("repo", (F.col("n") + 1).alias("part"), "n_parts", "at.part_start", "at.part_end")


def continuation_notices(plan: DataFrame) -> DataFrame:
    """Texts to put before and after each part."""
    part, n_parts = F.col("part"), F.col("n_parts")
    return part_bounds(plan).withColumns(
        {
            "prefix": render.continued_from(part),
            "suffix": render.continued_in(part, n_parts),
        }
    )


def _ranges(offsets: DataFrame, bounds: DataFrame, span: int) -> DataFrame:
    """Pieces by key, each with the ``ranges`` of it that go to different parts.

    A part and a piece meet where both reach into the same ``span`` bytes of a document, so
    no key has more rows than these bytes have pieces, however long a document is. They
    are taken from the first such span only.
    """

    def spans(start: str, end: str) -> Column:
        return F.sequence(F.floor(F.col(start) / span), F.floor((F.col(end) - 1) / span))

    whole = offsets.filter("n_bytes > 0").withColumn("piece_end", F.col("start") + F.col("n_bytes"))
    here = whole.select(*KEY, "start", "piece_end", F.explode(spans("start", "piece_end")).alias("span"))
    there = bounds.filter("part_end > part_start").withColumn(
        "span", F.explode(spans("part_start", "part_end"))
    )
    lo, hi = F.greatest("start", "part_start"), F.least("piece_end", "part_end")
    met = here.join(there, ["repo", "span"]).filter((lo < hi) & (F.col("span") == F.floor(lo / span)))
    share = F.struct(*[c for c in bounds.columns if c != "repo"], lo.alias("lo"), hi.alias("hi"))
    return met.groupBy(*KEY, "start").agg(F.collect_list(share).alias("ranges"))


def parts(
    texts: DataFrame, offsets: DataFrame, bounds: DataFrame, limit: int, block_bytes: int
) -> DataFrame:
    """``(repo, part, block, start, end, opening_bytes, body)``: parts with notices.

    ``bounds`` are those of :func:`part_bounds`; a ``file_name`` there is kept. ``start`` and ``end`` are offsets in the document, without notices. A part
    larger than ``block_bytes`` (the last one has no limit) is several rows, in
    order; the first has the opening notice, of ``opening_bytes``, and the last
    the closing one.

    Parts and blocks are decided on narrow rows. Texts go by piece, to meet them, and by
    block; never by repository.
    """
    lo, hi = F.col("s.lo"), F.col("s.hi")
    body = F.substr(
        F.col("text").cast("binary"), (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")
    )
    blocks = (
        texts.select(*KEY, "text")
        .join(_ranges(offsets, bounds, limit), KEY)
        .select("repo", "start", "text", F.explode("ranges").alias("s"))
        .select(
            "repo",
            "s.*",
            F.floor((lo - F.col("s.part_start")) / block_bytes).alias("block"),
            body.alias("body"),
        )
        .groupBy(*bounds.columns, "block")
        .agg(
            F.min("lo").alias("start"),
            F.max("hi").alias("end"),
            F.expr("listagg(body) WITHIN GROUP (ORDER BY lo)").alias("body"),
        )
    )
    # a cut at the very end leaves an empty last part
    empty = bounds.filter(F.col("part_start") == F.col("part_end")).select(
        *bounds.columns,
        F.lit(0).cast("bigint").alias("block"),
        F.col("part_start").alias("start"),
        F.col("part_end").alias("end"),
        F.lit(b"").alias("body"),
    )
    part, n_parts = F.col("part"), F.col("n_parts")
    opening = F.when(
        F.col("start") == F.col("part_start"), render.continued_from(part)
    ).otherwise("")
    closing = F.when(
        F.col("end") == F.col("part_end"), render.continued_in(part, n_parts)
    ).otherwise("")
    return blocks.unionByName(empty).select(
        "repo",
        "part",
        *[c for c in bounds.columns if c == "file_name"],
        "block",
        "start",
        "end",
        F.octet_length(opening).alias("opening_bytes"),
        F.concat(opening.cast("binary"), F.col("body"), closing.cast("binary")).alias("body"),
    )


def name_parts(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Add the ``file_name`` of each part, from the repository's directory name.

    ``rows`` are best the narrow ones of :func:`part_bounds`.
    """
    directory = F.col("directory" if "directory" in repos.columns else "repo")
    names = repos.select("repo", default_output_name(directory).alias("_name"))
    return (
        rows.join(names, "repo")
        .withColumn("file_name", part_file_name(F.col("_name"), F.col("part")))
        .drop("_name")
    )


def join_parts(rows: DataFrame) -> DataFrame:
    """Undo :func:`parts`: ``(doc, block, text)`` without notices, whole lines only.

    A block that ends inside a line is merged with what follows up to the next
    block that does not. Which blocks those are is decided on narrow rows.
    """
    size = F.col("end") - F.col("start")
    bare = rows.filter(size > 0).select(
        F.col("repo").alias("doc"),
        "start",
        F.substr("body", F.col("opening_bytes") + 1, size.cast("int")).alias("body"),
    )
    order = Window.partitionBy("doc").orderBy("start")
    islands = (
        bare.select("doc", "start", F.endswith("body", F.lit(b"\n")).alias("whole"))
        .withColumn("opens", F.coalesce(F.lag("whole").over(order), F.lit(True)))
        .select(
            "doc",
            "start",
            F.sum(F.col("opens").cast("bigint")).over(order).alias("block"),
        )
    )
    return (
        bare.join(islands, ["doc", "start"])
        .groupBy("doc", "block")
        .agg(F.expr("listagg(body) WITHIN GROUP (ORDER BY start)").cast("string").alias("text"))
    )
