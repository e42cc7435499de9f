"""Registered queries against their SQL in DuckDB."""

import duckdb
import pytest

from glyphspark.plans import queries as core

SF = "/root/testdata/sf0.001"
NAMES = ["char_freq", "vocab_stats", "ngram_counts_k2", "global_coverage", "class_distribution", "surprisal_by_char", "mean_ci", "peaks", "panel", "regression_b3", "loo_structural", "domain_permutation", "training_lines"]


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None).astype(str)
    return sorted(map(tuple, frame.values.tolist()))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got, want = core.queries()[name](spark, SF).toPandas(), db.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries())
