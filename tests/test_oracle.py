"""Every registered query with a SQL twin equals DuckDB on the sf0.001 tables
(the driver's correctness gate, at a small scale); the rest run."""

import pytest

import __spark_entry__ as E
from oracle_harness import compare

SQL = E.oracle_sql()
Q = E.queries()
MODEL_QUERIES = sorted(set(Q) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, sf0001, name):
    ok, msg = compare(Q[name](spark, sf0001), SQL[name], sf0001)
    assert ok, msg


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and set(df.columns) == {"MarketingSegment", "rate_pct", "n", "band"}


def test_registry_has_model_queries():
    assert {"train_metrics", "batch_scores", "live_stream_scores", "elbow"} <= set(MODEL_QUERIES)
