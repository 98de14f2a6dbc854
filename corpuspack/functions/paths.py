"""Column expressions over paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuspack import fixed


def sort_key(path: Column) -> Column:
    """String whose byte order is the component-wise order of ``path``.

    NUL cannot occur in a path and is lower than every other byte, so a parent
    sorts right before its children and `a/b` before `a-b`.
    """
    return F.replace(path, F.lit("/"), F.char(F.lit(0)))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """All proper prefixes of a path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def parent(path: Column) -> Column:
    """Enclosing directory; NULL at the top level."""
    return F.when(path.contains("/"), F.regexp_extract(path, "(?s)^(.*)/", 1))


def in_vcs_dir(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), fixed.VCS_DIR)


def language_of(path: Column) -> Column:
    """Fence language of a file, empty if unknown.

    A name whose only dot is its first character has no extension.
    """
    base = F.lower(basename(path))
    languages = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGES.items() for x in kv])
    ext = F.regexp_extract(base, r"(?s)^.+\.([^.]*)\z", 1)
    return F.when(base.isin(list(fixed.MAKE_NAMES)), fixed.MAKE_LANGUAGE).otherwise(
        F.coalesce(F.try_element_at(languages, ext), F.lit(""))
    )


def text_by_extension(path: Column) -> Column:
    """False for image extensions, judged by the last dot of the whole path."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)\z", 1))
    return ~ext.isin(list(fixed.BINARY_EXTENSIONS))


def _without_trailing_slashes(directory: Column) -> Column:
    return F.regexp_replace(directory, r"/+\z", "")


def default_output_name(directory: Column) -> Column:
    """Document name for a directory."""
    name = basename(_without_trailing_slashes(directory))
    return F.concat(
        F.when(name == "", fixed.OUTPUT_FALLBACK).otherwise(name), F.lit(fixed.OUTPUT_SUFFIX)
    )


def title_of(directory: Column) -> Column:
    """Name shown in the title: what follows the last slash."""
    return basename(directory)


def part_file_name(name: Column, part: Column) -> Column:
    """Put ``_part<k>`` before the extension of the last path component."""
    ext = F.regexp_extract(name, r"(\.[^./]*)\z", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(ext))
    return F.concat(stem, F.lit("_part"), part.cast("string"), ext)
