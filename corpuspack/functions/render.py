"""Column expressions that render Markdown pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuspack import fixed
from corpuspack.functions.paths import basename, depth, language_of
from corpuspack.functions.text import ends_with_newline, fence_len, human_size


def heading(path: Column) -> Column:
    return F.concat(F.lit(fixed.FILE_HEADING), path, F.lit("\n\n"))


def tree_label(path: Column, is_dir: Column) -> Column:
    """The counted part of a tree line: icon and name."""
    return F.concat(
        F.when(is_dir, fixed.DIR_ICON).otherwise(fixed.FILE_ICON),
        F.lit(" "),
        basename(path),
        F.when(is_dir, "/").otherwise(""),
        F.lit("\n"),
    )


def tree_line(path: Column, is_dir: Column) -> Column:
    """A whole tree line.

    Stateless: an entry deeper than another always follows its own parent, so
    every enclosing level draws the same vertical bar.
    """
    level = depth(path)
    return F.concat(
        F.repeat(F.lit(fixed.TREE_INDENT), level - 1),
        F.when(level > 0, fixed.TREE_BRANCH).otherwise(""),
        tree_label(path, is_dir),
    )


def fence_of(text: Column) -> Column:
    """The backticks that fence a text."""
    return F.repeat(F.lit("`"), fence_len(text))


def section_opening(path: Column, fence: Column) -> Column:
    """The line before fenced content."""
    return F.concat(fence, language_of(path), F.lit("\n"))


def section_closing(text: Column, fence: Column) -> Column:
    """What comes after fenced content, on a line of its own."""
    missing = (text != "") & ~ends_with_newline(text)
    return F.concat(F.when(missing, "\n").otherwise(""), fence, F.lit("\n"))


def text_section(path: Column, text: Column, fence: Column) -> Column:
    """Fenced content with a language, closed on a line of its own."""
    return F.concat(section_opening(path, fence), text, section_closing(text, fence))


def size_line(n_bytes: Column) -> Column:
    return F.concat(
        F.lit(fixed.SIZE_NOTE), F.coalesce(human_size(n_bytes), F.lit("unknown")), F.lit("\n")
    )


def binary_section(size: Column) -> Column:
    """Note and size line, not fenced; ``size`` is a :func:`size_line`."""
    return F.concat(F.lit(fixed.BINARY_NOTE), size)


def file_body(kind: Column, path: Column, text: Column, fence: Column, size: Column) -> Column:
    """What follows a file's heading, by its kind."""
    return (
        F.when(kind == "text", text_section(path, text, fence))
        .when(kind == "error", fixed.ERROR_NOTE)
        .otherwise(binary_section(size))
    )


def counted_texts(kind: Column, title: Column, text: Column, size: Column) -> Column:
    """The texts of a file section that count, each counted on its own."""
    return (
        F.when(kind == "text", F.array(title, text))
        .when(kind == "error", F.array(title, F.lit(fixed.ERROR_NOTE)))
        .otherwise(F.array(title, F.lit(fixed.BINARY_NOTE), size))
    )


def summary_header(total_tokens: Column, split: bool) -> Column:
    note = fixed.SPLIT_NOTE if split else ""
    return F.concat(
        F.lit(fixed.SUMMARY_INTRO + note + fixed.TOKEN_SIZE),
        total_tokens.cast("string"),
        F.lit("\n\n"),
    )


def continued_from(part: Column) -> Column:
    """Notice at the start of a part; empty for the first."""
    before, after = fixed.CONTINUED_FROM.split("{}")
    return F.when(
        part > 1, F.concat(F.lit(before), (part - 1).cast("string"), F.lit(after))
    ).otherwise("")


def continued_in(part: Column, n_parts: Column) -> Column:
    """Notice at the end of a part; empty for the last two."""
    before, after = fixed.CONTINUED_IN.split("{}")
    return F.when(
        part < n_parts - 1, F.concat(F.lit(before), (part + 1).cast("string"), F.lit(after))
    ).otherwise("")
