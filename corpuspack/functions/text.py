"""Column expressions over file contents and rendered text.

Byte-exact measures look at the text as ISO-8859-1, where every byte is one
character, so they also hold for bytes that are not valid UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuspack import fixed
from corpuspack.functions.paths import text_by_extension

# ASCII white space and punctuation. Spelled out one by one: Java looks single
# characters up in a table, but tries ranges in turn.
SPACE = r" \t\n\x0B\f\r"
PUNCT = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
PRETOKEN = rf"[^{SPACE}{PUNCT}]+|(?s)."


def as_bytes_text(text: Column) -> Column:
    """One character per byte."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def as_bytes(bytes_text: Column) -> Column:
    """Back from one character per byte."""
    return F.encode(bytes_text, "ISO-8859-1")


def bytes_text_of(text: str) -> str:
    """What :func:`as_bytes_text` makes of a constant."""
    return text.encode().decode("latin-1")


def head(content: Column, n: int = fixed.SNIFF_BYTES) -> Column:
    return F.substring(content, 1, n)


def sniff_binary(content: Column) -> Column:
    """Too few printable bytes at the start. Empty is text, unreadable (NULL) is binary."""
    start = as_bytes_text(head(content))
    printable = F.length(F.regexp_replace(start, f"[^{fixed.PRINTABLE_CLASS}]", ""))
    ratio = printable.cast("double") / F.length(start)
    return (
        F.when(content.isNull(), True)
        .when(F.octet_length(content) == 0, False)
        .otherwise(ratio < fixed.PRINTABLE_RATIO)
    )


def content_kind(path: Column, content: Column, start: Column | None = None) -> Column:
    """``binary``, ``text``, or ``error`` for a file whose start could be read but
    whose whole content could not. ``start`` defaults to the head of ``content``."""
    start = head(content) if start is None else start
    return (
        F.when(~text_by_extension(path), "binary")
        .when(sniff_binary(start), "binary")
        .when(content.isNull(), "error")
        .otherwise("text")
    )


def max_backtick_run(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1))
    longest = F.array_max(F.transform(runs, F.length))
    return F.when(text.contains("`"), longest).otherwise(0)


def fence_len(text: Column) -> Column:
    """Backticks needed to fence ``text``: three, or one more than its longest run."""
    run = max_backtick_run(text)
    return F.when(run < 3, 3).otherwise(run + 1)


def ends_with_newline(text: Column) -> Column:
    return F.endswith(text, F.lit("\n"))


def human_size(n_bytes: Column) -> Column:
    """``12.34 KB``, rounded to two decimals with exact ties to even.

    Works on whole hundredths: units are powers of two, so dividing is a shift,
    and no floating point rounding gets in.
    """
    n = n_bytes.cast("bigint")
    unit = F.least(F.lit(len(fixed.SIZE_UNITS) - 1), F.floor((F.length(F.bin(n)) - 1) / 10))
    shift = (unit * 10).cast("int")
    hundredths = n * 100
    quotient = F.call_function("shiftright", hundredths, shift)
    twice_rest = (hundredths - F.call_function("shiftleft", quotient, shift)) * 2
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
    up = (twice_rest > one) | ((twice_rest == one) & (quotient % 2 == 1))
    rounded = (quotient + up.cast("bigint")).cast("decimal(20,0)")
    units = F.array(*[F.lit(u) for u in fixed.SIZE_UNITS])
    return F.concat(
        (rounded / 100).cast("decimal(20,2)").cast("string"),
        F.lit(" "),
        F.get(units, unit.cast("int")),
    )


def word_units(bytes_text: Column) -> Column:
    """How many word runs and other non-space bytes there are.

    What is left after dropping white space and all but the last character of
    every word run has one byte per counted unit. Java's ``\\w`` and ``\\s`` are ASCII.
    """
    return F.length(F.regexp_replace(bytes_text, r"\w+(?=\w)|\s+", ""))


def count_tokens_approx(text: Column) -> Column:
    """1.3 tokens per word run or other non-space byte, cut to a whole number."""
    units = word_units(as_bytes_text(text))
    return F.floor(units * F.lit(fixed.TOKENS_PER_WORD)).cast("bigint")


def count_tokens_bytes(text: Column) -> Column:
    """One token per byte, but none for the one byte the shipped vocabulary lacks."""
    return F.octet_length(F.replace(text, F.lit(fixed.UNCOUNTED_BYTE), F.lit(""))).cast("bigint")


def pretokens(text: Column) -> Column:
    """Every white space or punctuation byte alone, other runs whole."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def fallback_chunks(unit: Column) -> Column:
    """Chunks to look up for a pretoken that is not in the vocabulary.

    Takes and gives one character per byte (:func:`as_bytes_text`). Up to four
    ASCII bytes stay whole, numbers fall into bytes, longer words into chunks of
    4, 3 or 2. Anything with other bytes falls into bytes.
    """

    def cut(k: int) -> Column:
        return F.regexp_extract_all(unit, F.lit("(?s).{1,%d}" % k), F.lit(0))

    n = F.length(unit)
    other = F.octet_length(unit) > n
    numeric = (n > 4) & F.rlike(unit, F.lit(rf"^[0-9{PUNCT}]"))
    return (
        F.when(other | numeric, single_bytes(unit))
        .when(n <= 8, cut(4))
        .when(n <= 16, cut(3))
        .otherwise(cut(2))
    )


def single_bytes(unit: Column) -> Column:
    """The characters of a text with one character per byte."""
    return F.regexp_extract_all(unit, F.lit("(?s)."), F.lit(0))


def to_base64(data: Column) -> Column:
    """Base64 on a single line."""
    return F.replace(F.base64(data.cast("binary")), F.lit("\r\n"), F.lit(""))


def from_base64(text: Column) -> Column:
    """The bytes of a base64 text, NULL if it is not valid."""
    return F.try_to_binary(text, F.lit("base64"))
