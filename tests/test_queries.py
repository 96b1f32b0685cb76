"""Registered queries against their SQL on the smallest tables.

A selection runs by default; ``THEMELOOM_ALL_QUERIES=1`` runs them all.
"""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

from tests.conftest import ROOT

sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SELECTED = ("normalize_docs", "word_ngrams", "tfidf_top_term", "label_map", "dedup_conflicts",
            "majority_label", "threshold_grid", "class_report", "session_segments",
            "cache_replay", "encyclopedia_results", "value_percentiles")
NAMES = list(entry.oracle_sql()) if os.environ.get("THEMELOOM_ALL_QUERIES") else SELECTED


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
