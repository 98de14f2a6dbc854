"""Quality rules on repetition: how much of a text lies in repeated word runs and lines.

The rules are row-local: every task measures its own texts, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import SPACE_BYTES, map_texts

SYMBOLS = b"#*$%&|<>"
LENGTHS = (5, 6, 7, 8, 9, 10)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Most characters of repeated runs, in percent of all characters in words: by words of a
# run, for repeated lines, and most symbols for each hundred words.
MAX_RUN_PERCENT = {5: 30, 6: 29, 7: 28, 8: 27, 9: 26, 10: 25}
MAX_LINE_PERCENT = 30
MAX_SYMBOLS_PERCENT = 10

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "dup_line_chars",
    *(f"dup_chars_{n}" for n in LENGTHS),
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def code_points(data: bytes) -> int:
    """Code points in UTF-8 bytes."""
    if data.isascii():
        return len(data)
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Word numbers spread over 64 bits."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``width`` words that begins at a flagged word."""
    edge = np.zeros(n + 1, np.int64)
    edge[: len(starts)] += starts
    edge[width : width + len(starts)] -= starts
    return np.cumsum(edge[:-1]) > 0


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it is there again, and whether it was there before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[:-1]] |= same
    before[order[1:]] = same
    return again | before, before


def _triples(ids: np.ndarray, distinct: int) -> np.ndarray:
    """One number for each window of three words, equal if and only if the words are."""
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 21:
        found, pairs = np.unique(pairs, return_inverse=True)
    return pairs[:-1] * distinct + ids[2:]


def measure(text: bytes | None) -> tuple[int, ...]:
    """The ``MEASURES`` of one text; all zero for null.

    Windows of three words are compared exactly, longer ones by 64-bit rolling hashes
    over exact word numbers.
    """
    text = text or b""
    words = text.split()
    n = len(words)
    packed = text.translate(None, SPACE_BYTES)
    chars = code_points(packed)
    symbols = len(packed) - len(packed.translate(None, SYMBOLS))
    dup_lines = dup_line_chars = 0
    if b"\n" in text:
        seen = set()
        for line in text.split(b"\n"):
            if line in seen:
                dup_lines += 1
                dup_line_chars += code_points(line.translate(None, SPACE_BYTES))
            elif line.strip():
                seen.add(line)
    repeated, runs = 0, [0] * len(LENGTHS)
    if n >= 3:
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        again, _ = _groups(_triples(ids, len(numbers)))
        if again.any():
            repeated = int(np.count_nonzero(_covered(again, 3, n)))
            lengths = None
            mixed = _mixed(ids)
            rolled, width = mixed, 1
            for k, target in enumerate(LENGTHS):
                if n < target:
                    break
                while width < target:
                    rolled = rolled[:-1] * _BASE + mixed[width:]
                    width += 1
                _, before = _groups(rolled)
                if not before.any():  # then no longer run is repeated either
                    break
                if lengths is None:
                    lengths = np.array([code_points(w) for w in words], np.int64)
                runs[k] = int(lengths[_covered(before, target, n)].sum())
    return n, chars, symbols, dup_lines, repeated, dup_line_chars, *runs


def _measuring():
    def columns(texts: list[bytes | None]) -> list[tuple]:
        with np.errstate(over="ignore"):
            return list(zip(*[measure(t) for t in texts]))

    return columns


def repetition(documents: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep``, and the ``MEASURES`` of each whole text.

    One row out for each row in, repeats included. A null text counts as empty.
    """
    fields = ", ".join(f"{m} bigint" for m in MEASURES)
    return map_texts(documents, text, keep, fields, _measuring)


def base_failed() -> Column:
    """Too few words, or more than half of them in windows of three found again."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def passes() -> Column:
    """Whether the measures of a text keep within all limits on repetition and symbols."""
    chars = F.col("word_chars")
    ok = 100 * F.col("dup_line_chars") <= MAX_LINE_PERCENT * chars
    for n in LENGTHS:
        ok = ok & (100 * F.col(f"dup_chars_{n}") <= MAX_RUN_PERCENT[n] * chars)
    return ok & (100 * F.col("n_symbols") <= MAX_SYMBOLS_PERCENT * F.col("n_words"))


def judge(
    documents: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Measures and the verdicts ``base_failed`` and ``kept`` of each document.

    Null and empty texts have no words, so they fail. Long texts are read whole. Equal
    rows get equal verdicts; an empty table gives none.
    """
    measured = repetition(documents, text, keep)
    return measured.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & passes()
    )


def accepted(documents: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "text"
    )
    return judge(rows, keep=("row",)).filter("kept").select("row.*")


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
),
lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
dup_lines AS (
  SELECT doc_id, count(*) AS n_dup_lines,
         sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_line_chars
  FROM lines WHERE nth > 1 GROUP BY doc_id
),
w AS (
  SELECT doc_id, ws, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t
),
runs AS (
  SELECT doc_id, i, length(word) AS chars,
         len(ws) - i >= 2 AND count(*) OVER (
           PARTITION BY doc_id, array_to_string(ws[i:i+2], ' '), len(ws) - i >= 2) > 1 AS again{flags}
  FROM w
),
covered AS (
  SELECT doc_id, chars,
         max(again::int) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) AS again{windows}
  FROM runs
),
dup_words AS (
  SELECT doc_id, sum(again) AS n_repeat_words{sums}
  FROM covered GROUP BY doc_id
),
m AS (
  SELECT t.doc_id, len(ws)::bigint AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
         coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
         coalesce(dup_line_chars, 0)::bigint AS dup_line_chars{measures}
  FROM t LEFT JOIN dup_lines USING (doc_id) LEFT JOIN dup_words USING (doc_id)
)
SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words AS base_failed,
       NOT base_failed AND 100 * dup_line_chars <= {max_line} * word_chars
       AND 100 * n_symbols <= {max_symbols} * n_words{limits} AS kept
FROM m
""".format(
    flags="".join(
        f""",
         len(ws) - i >= {n - 1} AND row_number() OVER (
           PARTITION BY doc_id, array_to_string(ws[i:i+{n - 1}], ' '), len(ws) - i >= {n - 1}
           ORDER BY i) > 1 AS run{n}"""
        for n in LENGTHS
    ),
    windows="".join(
        f""",
         max(run{n}::int) OVER (PARTITION BY doc_id ORDER BY i ROWS {n - 1} PRECEDING) AS run{n}"""
        for n in LENGTHS
    ),
    sums="".join(f", sum(run{n} * chars) AS dup_chars_{n}" for n in LENGTHS),
    measures="".join(
        f",\n         coalesce(dup_chars_{n}, 0)::bigint AS dup_chars_{n}" for n in LENGTHS
    ),
    limits="".join(
        f"\n       AND 100 * dup_chars_{n} <= {MAX_RUN_PERCENT[n]} * word_chars" for n in LENGTHS
    ),
    min_words=MIN_WORDS,
    max_repeat=MAX_REPEAT_PERCENT,
    max_line=MAX_LINE_PERCENT,
    max_symbols=MAX_SYMBOLS_PERCENT,
)
