"""Every catalog query against its SQL at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from fluxframe import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        return
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def joined_rows(df):
    """The most rows that any join of the executed plan has put out."""
    df.collect()
    seen, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        made = node.metrics().get("numOutputRows")
        if "Join" in kind and made.isDefined():
            seen = max(seen, made.get().value())
    return seen


@pytest.mark.parametrize("name", ["join_range", "join_where_theta"])
def test_counts_build_no_pairs(spark, tmp_path, name):
    spark.range(6000).selectExpr("id AS c_custkey", "cast(id % 2 AS int) AS c_nationkey", "cast(id % 60 AS double) AS c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(600).selectExpr("id AS s_suppkey", "cast(id % 2 AS int) AS s_nationkey", "cast(id % 60 AS double) - 0.5 AS s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert 0 < joined_rows(df) <= 2 * 6600
    assert df.agg({df.columns[1]: "sum"}).first()[0] > 800_000
