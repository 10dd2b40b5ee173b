"""Dirty ranges, graphs, and incremental == full."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxframe.plans.dag import ALL, RESHAPE, SCATTER, Graph, local_window, union
from fluxframe.plans.frame import ROW
from fluxframe.plans.incremental import ChunkMap, Epochs, History, Incremental, Node
from fluxframe.plans.pipeline import KernelFailure


def test_chunks():
    assert ChunkMap(600).chunks() == [256, 256, 88]


@pytest.mark.parametrize("ranges,want", [([(100, 150)], [0]), ([(250, 300)], [0, 1]), ([(100, 100)], []), ([(0, 1), (512, 513)], [0, 2]), ([(0, 10**18)], [0, 1, 2])])
def test_marks(ranges, want):
    m = ChunkMap(600)
    for a, b in ranges:
        m.mark(a, b)
    assert m.dirty() == want
    m.clear()
    assert not m.is_dirty()


def test_append_dirties_new_chunks():
    m = ChunkMap(512)
    m.append(256)
    assert m.dirty() == [2]
    m = ChunkMap(600)
    m.append(1)
    assert m.dirty() == [2]
    m.mark_range(ALL)
    assert m.dirty() == [0, 1, 2]
    m.clear(1)
    assert not m.is_dirty(1)


def test_map_range():
    assert local_window(10).map_range((100, 200)) == (90, 210)
    assert local_window(50).map_range((10, 20)) == (0, 70)
    assert SCATTER.map_range((1, 2)) is ALL and RESHAPE.is_blocking


def test_propagation():
    g = Graph()
    g.add("a")
    g.add("b", ["a"])
    g.add("c", ["a"], local_window(10))
    g.add("d", ["b"], SCATTER)
    g.add("e", ["b", "c"])
    assert g.propagate("a", (100, 200)) == {"a": (100, 200), "b": (100, 200), "c": (90, 210), "d": ALL, "e": (90, 210)}
    assert g.propagate("a", (5, 5)) == {}
    assert g.order()[0] == "a" and g.consumers("b") == ["d", "e"] and len(g) == 5 and g.reach("e") == 10 and g.reach("d") is None
    with pytest.raises(ValueError, match="unknown"):
        g.add("x", ["nope"])
    g.inputs["a"].append("e")
    with pytest.raises(ValueError, match="cycle"):
        g.order()


@given(st.integers(0, 1000), st.integers(0, 200), st.lists(st.integers(0, 50), min_size=1, max_size=5))
def test_window_chain_adds_up(start, length, halves):
    g = Graph()
    g.add("n0")
    for i, h in enumerate(halves):
        g.add(f"n{i + 1}", [f"n{i}"], local_window(h))
    got = g.propagate("n0", (start, start + length))
    if length:
        lo, hi = start, start + length
        for h in halves:
            lo, hi = max(0, lo - h), hi + h
        assert got[f"n{len(halves)}"] == (lo, hi)
    assert union((1, 2), ALL) is ALL


def prices(spark, n):
    return spark.range(n).select(F.col("id").alias(ROW), (F.col("id") % 97).cast("double").alias("price"))


def nodes():
    return [Node("tax", lambda r: r.price * 0.1), Node("total", lambda r: r.price + r.tax), Node("smooth", rolling=("total", "sum", 3)), Node("twice", rolling=("smooth", "max", 2))]


def same(a, b):
    key = lambda r: r[ROW]
    cols = sorted(a.columns)
    return sorted(a.select(cols).collect(), key=key) == sorted(b.select(cols).collect(), key=key)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(start=st.integers(0, 380), length=st.integers(1, 40), grow=st.integers(0, 50))
def test_incremental_equals_full(spark, start, length, grow):
    inc = Incremental(prices(spark, 400), nodes(), chunk_size=64, max_layers=1 + grow % 2)
    inc.run()
    changed = inc.source.where(F.col(ROW).between(start, start + length)).withColumn("price", F.col("price") * 7 + 1)
    inc.mutate(changed)
    if grow:
        inc.append(prices(spark, 400 + grow).where(F.col(ROW) >= 400))
    got = inc.run()
    assert same(got, inc.full())


def test_only_dirty_chunks_are_recomputed(spark):
    inc = Incremental(prices(spark, 15000), [Node("smooth", rolling=("price", "mean", 3))])
    inc.run()
    inc.mutate(inc.source.where(F.col(ROW).between(510, 513)).withColumn("price", F.lit(1.0)))
    assert sorted(r[0] for r in inc.dirty_chunks().collect()) == [1, 2]
    inc.run()
    assert inc.recomputed.count() == 512
    assert inc.dirty_chunks().count() == 0


def test_impure_nodes_are_always_dirty(spark):
    inc = Incremental(prices(spark, 600), [Node("r", lambda r: r.price + F.rand(), pure=False)])
    inc.run()
    assert inc.dirty_chunks().count() == 3
    assert inc.impure_chunks("r").count() == 3
    assert Incremental(prices(spark, 600), [Node("t", lambda r: r.price + 1)]).impure_chunks("t").count() == 0


def test_chunk_failures(spark):
    bad = Node("inv", lambda r: 1 / r.price, failure="soft", fail_when=lambda r: r.price == 0)
    inc = Incremental(prices(spark, 90), [bad], chunk_size=30)
    out = inc.run()
    assert out.where("inv IS NULL").count() == 30
    warned = inc.drain_warnings()
    assert len(warned) == 2 and "chunk 0" in warned[0] and "NA fraction 1.00" in warned[1]
    with pytest.raises(KernelFailure, match="chunk 0"):
        Incremental(prices(spark, 90), [Node("inv", lambda r: 1 / r.price, failure="hard", fail_when=lambda r: r.price == 0)], chunk_size=30).run()


def test_hard_failures_beyond_the_warning_limit_raise(spark):
    soft = Node("low", lambda r: r.price + 0, failure="soft", fail_when=lambda r: r.price < 60)
    hard = Node("high", lambda r: r.price + 1, failure="hard", fail_when=lambda r: r.price == 80)
    inc = Incremental(prices(spark, 90), [soft, hard], chunk_size=10, max_warnings=2)
    with pytest.raises(KernelFailure, match="'high'.*chunk 8"):
        inc.run()
    assert len(inc.drain_warnings()) == 2


def test_epochs():
    g = Graph()
    g.add("a")
    g.add("b", ["a"])
    e = Epochs(g)
    e.touch("a")
    assert e.is_dirty("b") and not e.is_dirty("a")
    e.done("b")
    assert not e.is_dirty("b")
    e.touch("a")
    assert e.is_dirty("b")


def test_history(spark, tmp_path):
    h = History(str(tmp_path / "h"))
    h.save(prices(spark, 5))
    h.save(prices(spark, 5).withColumn("price", F.col("price") + 1))
    assert [r["price"] for r in h.trace(spark, 2).collect()] == [2.0, 3.0] and h.at(spark, 1).count() == 5


def test_deltas_are_put_together(spark):
    from fluxframe.plans.incremental import Deltas

    base = spark.range(10).select(F.col("id").alias(ROW), F.col("id").cast("double").alias("x"))
    inc = Incremental(base, [Node("y", lambda r: r.x * 2)], chunk_size=4)
    d = Deltas(inc)
    assert d.flush().count() == 10
    of = lambda row, x: spark.createDataFrame([(row, x)], f"{ROW} long, x double")
    d.push("mutate", of(1, 5.0)).push("mutate", of(1, 6.0)).push("append", of(10, 1.0)).push("append", of(11, 1.0)).push("mutate", of(11, 7.0))
    d.push("watermark", 5).push("watermark", 3)
    assert len(d) == 3 and d.watermark == 5
    got = {r[ROW]: r.y for r in d.flush().collect()}
    assert len(got) == 12 and got[1] == 12.0 and got[10] == 2.0 and got[11] == 14.0 and got[2] == 4.0 and len(d) == 0
    d.push("mutate", of(0, 9.0)).push("replace", base)
    assert len(d) == 1 and {r[ROW]: r.y for r in d.flush().collect()}[0] == 0.0
    with pytest.raises(ValueError):
        d.push("drop", base)
