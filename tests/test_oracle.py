"""Registered queries against SQL on the smallest tables; the rest by check_oracle.py."""

import os

import pytest

import __spark_entry__ as entry
import check_oracle
from corpuspack.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "corpus_entries",
    "compile_rules",
    "prune_ignored_pages",
    "sniff_binary",
    "human_size",
    "lint_missing_docs",
    "count_tokens_approx",
    "render_text_section",
    "hier_sort",
    "split_points",
    "parts",
    "encode_ids",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    ours = entry.queries()[name](spark, SF_DIR).toPandas()
    theirs = check_oracle.connect(SF_DIR).execute(entry.oracle_sql()[name]).df()
    assert len(ours) > 0
    assert check_oracle.compare(ours, theirs) == ""


def test_every_query_but_merging_has_sql():
    """Of the library's own; those of the training-data operators have tests of their own."""
    assert not set(QUERIES) - set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and all(r.total_tokens > 0 and r.n_parts >= 1 for r in rows)
