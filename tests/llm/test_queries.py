"""Every query that has SQL against DuckDB on the smallest tables, where they are there."""

import collections
import os

import duckdb
import pytest

from embergrid.llm import queries as llm

DATA = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)
    return collections.Counter(map(repr, frame[names].astype(object).where(frame[names].notna(), None).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    got, want = llm.QUERIES[name](spark, DATA).toPandas(), con.sql(llm.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert rows(got) == rows(want)
