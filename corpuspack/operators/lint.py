"""Function definitions without a doc comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack import fixed


def _line_code(line: Column) -> Column:
    """One letter per line: F function, S skipped when looking back, D doc comment, O other."""
    text = F.regexp_replace(line, r"^[ \t]+", "")
    return (
        F.when(line.rlike(fixed.FUNCTION_LINE) & ~line.rlike(fixed.NOT_A_FUNCTION), "F")
        .when(F.startswith(text, F.lit("/**")), "D")
        .when(text.rlike(r"^(\*|//|#)"), "S")
        .otherwise("O")
    )


def lint_missing_docs(files: DataFrame) -> DataFrame:
    """``(repo, path, line_no)`` of function lines with no doc comment just above.

    A file becomes a string with one letter per line, in which a documented
    function reads as D, any number of S, then F. So the look-back is a regex
    within the row, and no line is shuffled.
    """
    lines = F.split(F.col("content").cast("string"), "\n")
    code = F.array_join(F.transform(lines, _line_code), "")
    missing = F.regexp_replace(code, "(DS*)F", "$1K")
    return (
        files.select("repo", "path", F.posexplode(F.split(missing, "")).alias("pos", "letter"))
        .filter(F.col("letter") == "F")
        .select("repo", "path", (F.col("pos") + 1).alias("line_no"))
    )
