"""Every query with SQL gives the rows that DuckDB gives for it."""

import duckdb
import pandas as pd
import pytest

from lodestone import oracles, path_oracles, path_queries, queries

QUERIES, SQL = queries.queries() | path_queries.queries(), oracles.oracle_sql() | path_oracles.oracle_sql()

TABLES = ["part", "documents", "embeddings", "pages", "benchmark", "conversations"]


def plain(df):
    """Rows as sorted text; whole floats as integers, missing values as None."""
    one = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(str([one(v) for v in row]) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    for t in TABLES:
        duckdb.sql(f"create or replace view {t} as select * from '{sf_dir}/{t}.parquet'")
    return duckdb


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
