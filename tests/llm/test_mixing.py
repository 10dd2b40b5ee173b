from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe.llm import mixing, queries
from fluxframe.llm.mixing import Params, fill, split


def test_fill():
    assert fill([10, 10], [5, 2]) == [20 * 5 / 7, 20 * 2 / 7]
    assert fill([1, 9], [5, 2]) == [3, 7]
    assert fill([], []) == [] and fill([0, 0], [5, 2]) == [0, 0]
    got = fill([1, 1, 100, 0], [5, 2, 1, 5])
    assert got[0] == 3 and got[1] == 3 and got[2] == pytest.approx(96) and got[3] == 0


def test_split_deals_out_exactly():
    quota = np.array([100, 7, 0, 33])
    got = split(quota, 0, 8, 1)
    assert len(got) == 8 and (sum(got) == quota).all() and max(x.sum() for x in got) - min(x.sum() for x in got) <= 1
    assert all((a == b).all() for a, b in zip(got, split(quota, 0, 8, 1)))


def test_targets_are_met(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.source, len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")])) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op3_mixing(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s, n = docs[r.doc_id]
        assert r.size == n and r.taken % max(n, 1) == 0 and r.taken <= 3 * n
        size[s] += n
        taken[s] += r.taken
        target[s] = r.target
    order = sorted(size)
    want = fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, w in zip(order, want):
        assert target[s] == pytest.approx(w)
        biggest = max(n for t, n in docs.values() if t == s)
        assert abs(taken[s] - w) <= biggest
    again = queries.op3_mixing(spark, d).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_draw_agrees_with_the_report(docs):
    p = Params(shards=4)
    want = defaultdict(int)
    for r in mixing.report(docs, p).collect():
        want[r.doc_id] += len([s for s in r.shards.split(",") if s])
    drawn = mixing.draw(docs, p)
    assert drawn.columns == docs.columns
    got = Counter(r.doc_id for r in drawn.collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_edges(docs, none):
    assert mixing.report(none).count() == 0 and mixing.draw(none).count() == 0
    rows = mixing.report(docs).collect()
    assert len(rows) == docs.count() and all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (2, 3))
    one = mixing.report(docs.where("doc_id = 8"), Params()).first()
    assert (one.size, one.taken, one.target) == (2, 2, 2.0)
    assert mixing.report(docs.withColumn("source", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] >= 0


def test_a_very_long_document_does_not_stop_the_filling(spark):
    rows = [(i, "a", "w " * (30_000 if i == 0 else 100)) for i in range(400)] + [(1000 + i, "b", "w " * 100) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for seed in range(4):
        for r in mixing.report(df, Params(seed=seed, weights=(1.0, 2.0))).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
            assert abs(r.taken - r.target) <= 100, (seed, r)
