"""Every registered ride query equals its DuckDB statement (sf0.001).  The
training-data queries have tests of their own in tests/llm."""

import pytest

import __spark_entry__ as entry
from helpers import SF_SMALL, duck_rows, spark_rows
from ridelens.plans import oracle, registry

QUERIES = registry.queries()
ORACLE = oracle.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    rel = duck(SF_SMALL).sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    assert spark_rows(df, cols) == duck_rows(rel, cols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "pct_from_top" in df.columns
