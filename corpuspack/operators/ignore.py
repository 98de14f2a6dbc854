"""Ignore rules: ordered glob patterns per repository, the last match wins.

Patterns keep the loose meaning of the packed format, not that of git: a rule
without a leading slash is matched against the end of the path, ``dir/`` also
matches plain files, ``?`` matches any character and brackets are literal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack import fixed
from corpuspack.functions.paths import ancestors
from corpuspack.functions.text import SPACE

_ANY = "\u0001"  # stands for `**` while single stars are replaced
_NEVER = "(?!)"
_START = "(?s)^"


def _patterns_of(content: Column) -> Column:
    """Lines of an ignore file, trimmed; what is empty or a comment is no pattern."""
    trimmed = F.transform(
        F.split(content.cast("string"), "\n"),
        lambda line: F.regexp_replace(
            F.regexp_replace(line, r"(?s)\r.*\z", ""), rf"^[{SPACE}]+|[{SPACE}]+\z", ""
        ),
    )
    return F.transform(
        trimmed, lambda p: F.when((p != "") & ~F.startswith(p, F.lit("#")), p)
    )


def load_ignore_rules(files: DataFrame) -> DataFrame:
    """Patterns of each repository's top-level ignore file, in line order.

    Reads one small row per repository: the filter on ``path`` reaches the scan.
    """
    return (
        files.filter(F.col("path") == fixed.IGNORE_FILE)
        .select("repo", F.posexplode(_patterns_of(F.col("content"))).alias("pos", "pattern"))
        .filter(F.col("pattern").isNotNull())
        .select("repo", (F.col("pos") + 1).alias("rule_ord"), "pattern")
    )


def extra_ignores(patterns: DataFrame, repos: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Append the caller's patterns, as given, after the file rules of every repository."""
    given = [p for p in extra if p]
    if not given:
        return patterns
    last = patterns.groupBy("repo").agg(F.max("rule_ord").alias("last"))
    added = (
        repos.select("repo")
        .distinct()
        .join(last, "repo", "left")
        .select(
            "repo",
            F.coalesce("last", F.lit(0)).alias("last"),
            F.posexplode(F.array(*[F.lit(p) for p in given])).alias("pos", "pattern"),
        )
        .select("repo", (F.col("last") + F.col("pos") + 1).alias("rule_ord"), "pattern")
    )
    return patterns.select("repo", "rule_ord", "pattern").unionByName(added)


def _bare(pattern: Column) -> Column:
    """A pattern without its negation sign."""
    return F.regexp_replace(pattern, r"^!", "")


def _body(pattern: Column) -> Column:
    """Regex for a pattern, to be matched from the start of a path to its end."""
    glob = _bare(pattern)
    steps = [
        (r"/\z", ""),
        (r"^(?!/)", "**"),
        (r"^/", ""),
        (r"[.^$+()\[\]{}|\\]", r"\\$0"),
        (r"\*\*/?", _ANY),
        (r"\*", "[^/]*"),
        (r"\?", "."),
        (_ANY, ".*"),
    ]
    for regex, replacement in steps:
        glob = F.regexp_replace(glob, regex, replacement)
    return F.concat(glob, F.when(F.endswith(pattern, F.lit("/")), r"(/.*)?\z").otherwise(r"\z"))


def compile_rules(patterns: DataFrame) -> DataFrame:
    """Flags and regex of every pattern.

    The regex is written for a dot that matches newlines and for the very end of
    the text, and reads the same in Java and RE2 syntax.
    """
    pattern = F.col("pattern")
    return patterns.select(
        "repo",
        "rule_ord",
        F.regexp_replace(_bare(pattern), r"/\z", "").alias("pattern"),
        F.startswith(pattern, F.lit("!")).alias("negation"),
        F.startswith(_bare(pattern), F.lit("/")).alias("anchored"),
        F.endswith(pattern, F.lit("/")).alias("dir_only"),
        F.concat(F.lit(_START), _body(pattern)).alias("regex"),
    )


def _fold(rules: Column) -> Column:
    """One regex for an ordered array of ``(negation, body)``.

    "The last matching rule wins": the rules are flat alternatives, last to first, of
    an atomic group, which never goes on to another once one has matched. A plain rule
    then has consumed the path, and a negated one, a lookahead, nothing, so that the
    end is not reached. Any number of rules nests no deeper than one.
    """
    alternatives = F.transform(
        rules,
        lambda rule: F.when(
            rule["negation"], F.concat(F.lit("(?="), rule["body"], F.lit(")"))
        ).otherwise(rule["body"]),
    )
    flat = F.array_join(F.reverse(alternatives), "|")
    return F.concat(
        F.lit(_START + "(?>"),
        F.when(F.size(rules) > 0, flat).otherwise(_NEVER),
        F.lit(r")\z"),
    )


def ignore_matchers(rules: DataFrame) -> DataFrame:
    """One regex per repository that matches exactly the ignored paths.

    A path then needs one match instead of one per rule, and a repository adds
    one row to the join. The list collected per repository is the content of one
    ignore file.
    """
    body = F.substr("regex", F.lit(len(_START) + 1))
    ordered = F.array_sort(
        F.collect_list(F.struct("rule_ord", "negation", body.alias("body")))
    )
    return rules.groupBy("repo").agg(ordered.alias("rules")).select(
        "repo", _fold(F.col("rules")).alias("matcher")
    )


def file_matchers(files: DataFrame) -> DataFrame:
    """:func:`ignore_matchers` straight from the ignore files, without a shuffle."""
    rules = F.transform(
        F.filter(_patterns_of(F.col("content")), lambda p: p.isNotNull()),
        lambda p: F.struct(
            F.startswith(p, F.lit("!")).alias("negation"), _body(p).alias("body")
        ),
    )
    return files.filter(F.col("path") == fixed.IGNORE_FILE).select(
        "repo", _fold(rules).alias("matcher")
    )


def match_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``ignored``: the verdict of the rules on each path alone."""
    return (
        paths.join(ignore_matchers(rules), "repo", "left")
        .withColumn(
            "ignored",
            F.coalesce(F.rlike("path", F.col("matcher")), F.lit(False)),
        )
        .drop("matcher")
    )


def mark_kept(
    rows: DataFrame,
    matchers: DataFrame,
    join: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Add ``kept``: neither the path nor any directory above it is ignored.

    Decided within the row: nothing is exploded, and the only join is with one
    row per repository (``matchers`` from :func:`ignore_matchers`). ``rows`` should be
    narrow, as many matchers are not broadcast.
    """
    matcher = F.col("matcher")
    cut = F.rlike("path", matcher) | F.exists(
        ancestors(F.col("path")), lambda above: F.rlike(above, matcher)
    )
    joined = rows.join(matchers, "repo", "left") if join is None else join(rows, matchers, "repo")
    return joined.select(*rows.columns, (~F.coalesce(cut, F.lit(False))).alias("kept"))


def prune(rows: DataFrame, matchers: DataFrame) -> DataFrame:
    """Keep the rows that are not ignored, by themselves or with a directory."""
    return mark_kept(rows, matchers).filter("kept").select(*rows.columns)


def prune_ignored(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`prune` for a table of compiled rules."""
    return prune(rows, ignore_matchers(rules))
