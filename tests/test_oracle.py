"""Every query that has SQL against DuckDB, at the smallest scale."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from obliva.oracle import SQL
from obliva.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df, columns):
    part = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in part.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(expected, columns)
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["attribute", "error", "n"]
    assert out.count() == 4
    assert set(SQL) <= set(__spark_entry__.queries())
