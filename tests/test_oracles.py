"""Every registered feed query against DuckDB over the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from digestflow.plans import feed_queries, run_queries, stream_queries

QUERIES = feed_queries.QUERIES | run_queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL = feed_queries.ORACLE_SQL | run_queries.ORACLE_SQL | stream_queries.ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    sql = ORACLE_SQL.get(name)
    if sql:
        want = duck.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
