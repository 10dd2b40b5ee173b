"""Queries with SQL against DuckDB on whole small tables."""

import duckdb
import pytest

from fluxframe.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(Q.SQL[name]).to_arrow_table()
    got = Q.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.column_names)
    rows = lambda t: sorted(zip(*[t[c].to_pylist() for c in sorted(got.columns)]))
    assert rows(got.toArrow()) == rows(want)
