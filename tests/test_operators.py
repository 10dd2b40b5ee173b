"""Edges of the relational operators that the sample tables do not hold."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fluxframe.operators import groupby as G
from fluxframe.operators import joins as J
from fluxframe.operators import missing as M
from fluxframe.operators import reshape as R
from fluxframe.operators import stats as Q
from fluxframe.operators import window as W
from fluxframe.sources import io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_keys_match_nothing(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    b = spark.createDataFrame([(1, "c"), (None, "d")], "k int, y string")
    assert rows(J.join(a, b, "k")) == [(1, "a", "c")]
    assert rows(J.join(a, b, "k", "full")) == [(1, "a", "c"), (None, "b", None), (None, None, "d")]
    assert rows(J.join(a, b, "k", "anti")) == [(None, "b")]


def test_asof_edges(spark):
    l = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 9), (1, None)], "k int, t int")
    r = spark.createDataFrame([(1, 5, "x", 1), (1, 5, "y", 2), (1, 2, "z", 1), (2, 20, "w", 1), (None, 1, "n", 1)], "k int, t int, v string, tie int")
    back = J.asof_join(l, r, "t", "t", ["k"], tie="tie").select("k", "t", "v", "t_right")
    assert rows(back) == rows(spark.createDataFrame([(1, 5, "y", 5), (1, 1, None, None), (2, 9, None, None), (None, 9, None, None), (1, None, None, None)], "k int, t int, v string, u int"))
    ahead = J.asof_join(l, r, "t", "t", ["k"], "forward", tolerance=5, tie="tie").select("k", "t", "v")
    assert rows(ahead) == rows(spark.createDataFrame([(1, 5, "y"), (1, 1, "z"), (2, 9, None), (None, 9, None), (1, None, None)], "k int, t int, v string"))
    assert J.is_sorted(spark.createDataFrame([(1, 0), (2, 1)], "t int, r int"), "t", [], "r") and not J.is_sorted(spark.createDataFrame([(2, 0), (1, 1)], "t int, r int"), "t", [], "r")
    with pytest.raises(ValueError):
        J.asof_join(l, r, "t", "t", ["k"], "nearest")


def test_broadcast_only_below_the_bound(spark):
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    assert J.broadcast_join(a, b, "k").count() == 50 and J.broadcast_join(a, b, "k", max_rows=10).count() == 50


def test_range_join(spark):
    a = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 3.5, 10.0)], "v double")
    b = spark.createDataFrame([(0.0, 3.5, "p"), (-5.0, 12.0, "q"), (4.0, 1.0, "empty")], "lo double, hi double, n string")
    got = J.range_join(a, b, "v", "lo", "hi", 2.0).select("v", "n")
    want = a.join(b, (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select("v", "n")
    assert rows(got) == rows(want)


def test_group_edges(spark):
    df = spark.createDataFrame([("a", None, 0), ("a", 2.0, 1), ("b", None, 2), ("b", math.nan, 3), ("b", 1.0, 4)], "k string, v double, r int")
    got = {r["k"]: r for r in G.group_by(df, "k", G.first("v", "r").alias("f"), G.rows().alias("n"), G.greatest("v").alias("m"), G.std("v").alias("sd"), G.n_unique("v", nulls=True).alias("u")).collect()}
    assert got["a"]["f"] is None and got["a"]["n"] == 2 and got["a"]["sd"] is None and got["a"]["u"] == 2
    assert math.isnan(got["b"]["m"]) and got["b"]["u"] == 3
    s = G.salted(df, ["k"], [F.collect_list("r").alias("x")], [F.sort_array(F.flatten(F.collect_list("x"))).alias("x")], F.col("r"))
    assert rows(s) == [("a", [0, 1]), ("b", [2, 3, 4])]


def test_fills(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, None, 2.0, None])], "r long, v double")
    for chunk in (1, 2, 4, 100):
        assert [r["v"] for r in M.fill_forward(df, "v", "r", chunk=chunk).orderBy("r").collect()] == [None, 1.0, 1.0, 1.0, 2.0, 2.0]
        assert [r["v"] for r in M.fill_backward(df, "v", "r", chunk=chunk).orderBy("r").collect()] == [1.0, 1.0, 2.0, 2.0, 2.0, None]


def test_drop_nulls_keeps_nan(spark):
    df = spark.createDataFrame([(math.nan,), (None,), (1.0,)], "v double")
    assert M.drop_nulls(df).count() == 2


def test_windows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "r long, v double")
    for chunk in (4, 7, 1000):
        got = [r["s"] for r in W.centred(df, "v", "sum", 3, "r", "s", chunk).orderBy("r").collect()]
        assert got == [sum(float(j) for j in range(max(0, i - 3), min(50, i + 4))) for i in range(50)]
    with pytest.raises(ValueError):
        W.centred(df, "v", "sum", 10, "r", "s", 5)
    got = df.select(W.rolling("v", "sum", 3, "r").alias("s")).collect()
    assert got[1]["s"] is None and got[2]["s"] == 3.0
    ema = [r["e"] for r in W.ema(df.withColumn("k", F.lit(1)), "v", 0.5, "r", ["k"], "e").orderBy("r").collect()]
    s = 0.0
    for i, e in enumerate(ema):
        s = 0.5 * i + 0.5 * s if i else 0.0
        assert e == s


def test_pivot_unpivot(spark):
    df = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 6, 0), (2, "b", 7, 2)], "i int, c string, v int, r int")
    assert rows(R.pivot(df, "i", "c", "v", ["a", "b"], "r")) == [(1, 6, None), (2, None, 7)]
    assert rows(R.unpivot(df.select("i", "v", "r"), "i", ["v", "r"])) == [(1, "r", 0), (1, "r", 1), (1, "v", 5), (1, "v", 6), (2, "r", 2), (2, "v", 7)]


def test_stats(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 5, 10, 10)] + [(None,)], "v double")
    assert rows(Q.column_stats(df, ["v"])) == [("v", 0.0, 10.0, 6.25, 1)]
    assert rows(Q.histogram(df, "v", 0, 10, 2)) == [(0.0, 1), (5.0, 3)]
    parts = Q.partition_stats(df, F.floor(F.col("v") / 10), ["v"])
    assert rows(Q.prune(parts, "v", 7.0, 20.0)) == [(1,)]


def test_remote_sql_runs_elsewhere(spark):
    import duckdb

    sql = io.remote_sql("t", [("tax", "price * 0.5"), ("total", "price + tax")], ["total"], "price > 1")
    con = duckdb.connect()
    con.sql("CREATE TABLE t AS SELECT * FROM (VALUES (1.0), (2.0)) v(price)")
    assert [float(r[0]) for r in con.sql(sql).fetchall()] == [3.0]


def test_files(spark, tmp_path):
    df = spark.range(10).withColumn("c", F.col("id") % 2)
    path = str(tmp_path / "t")
    io.save(df, path, partition_by=["c"])
    read = io.load(spark, path)
    seen = io.changed_files(read, spark.createDataFrame([], "__file string, __changed timestamp"))
    assert seen.count() >= 2 and io.changed_files(read, seen).count() == 0
    io.save_chunks(spark.createDataFrame([(99, 1)], "id long, c long"), path, "c")
    spark.catalog.refreshByPath(path)
    assert rows(io.load(spark, path).where("c = 1").select("id")) == [(99,)] and io.load(spark, path).count() == 6
    with pytest.raises(ValueError):
        io.load(spark, path, "tape")
    calls = []
    io.View("v_test").on_change(lambda d: calls.append(d.count())).update(df)
    assert calls == [10] and spark.table("v_test").count() == 10


def test_arrow_file(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"x": pa.array([1, None], pa.int64())})
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert rows(io.load_arrow(spark, str(tmp_path / "a.arrow"))) == [(1,), (None,)]


def test_micro_batches(spark, tmp_path):
    """State must outlive a batch: three files, one a batch."""
    from fluxframe.streaming import streams

    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(i, 1, datetime(2024, 1, 1, i), 10.0 * i)], "event_id long, k long, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(src)
    s = streams.read_files(spark, src, spark.read.parquet(src).schema, files_per_batch=1)
    out = spark.read.parquet(streams.to_parquet(streams.ema(s.select("event_id", "k", "value"), "k", "event_id", "value", 0.5), str(tmp_path / "out"), "append"))
    assert [r["ema"] for r in out.orderBy("event_id").collect()] == [0.0, 5.0, 12.5]
    w = streams.tumbling_window(streams.event_time(s, "ts", "0 minutes"), "ts", "1 hour", [F.count(F.lit(1)).alias("n")])
    closed = spark.read.parquet(streams.to_parquet(w, str(tmp_path / "out2"), "append"))
    assert closed.count() == 2  # the last window is still open


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_without_by_equals_one_group(spark, direction):
    rng = random.Random(4)
    left = spark.createDataFrame([(i, rng.choice([None, *range(60)])) for i in range(200)], "id long, t long")
    right = spark.createDataFrame([(rng.randrange(60), rng.randrange(3), i) for i in range(80)], "t long, tie long, v long").dropDuplicates(["t", "tie"])
    one = J.asof_join(left.withColumn("g", F.lit(1)), right.withColumn("g", F.lit(1)), "t", "t", ["g"], direction, tie="tie")
    got = J.asof_join(left, right, "t", "t", (), direction, tie="tie")
    rows = lambda df: sorted(((r.id, r.t, r.v) for r in df.collect()), key=repr)
    assert rows(got) == rows(one)
    assert J.asof_join(left, right.where("false"), "t", "t", (), direction).where("v IS NOT NULL").count() == 0


def test_whole_table_windows_equal_global_ones(spark):
    from datetime import datetime, timedelta

    rng = random.Random(6)
    rows = [(i, rng.choice([None, 1.0, 2.5, 7.0]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(400)) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "__row long, x double, ts timestamp")
    want = df.withColumn("y", W.rolling("x", "sum", 7, "__row", min_periods=3))
    got = W.rolling_rows(df, "x", "sum", 7, "__row", "y", min_periods=3, chunk=20)
    key = lambda d: sorted(((r["__row"], r.y) for r in d.collect()))
    assert key(got) == key(want)
    want = df.withColumn("y", F.when(F.col("ts").isNotNull(), W.rolling_time("x", "sum", "ts", 30)))
    assert key(W.rolling_span(df, "x", "sum", "ts", 30, "y")) == key(want)


def test_ema_with_nulls(spark):
    rows = [("a", i, None if i in (0, 5, 6) else float(i)) for i in range(600)] + [("b", 0, None), ("c", 0, 4.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    want, state = {}, {}
    for k, i, x in rows:
        if x is not None:
            state[k] = x if state.get(k) is None else 0.3 * x + 0.7 * state[k]
        want[k, i] = state.get(k)
    got = {(r.k, r.i): r.ema for r in W.ema(df, "x", 0.3, "i", ["k"]).collect()}
    assert got.keys() == want.keys() and all((got[z] is None) == (want[z] is None) and (want[z] is None or abs(got[z] - want[z]) < 1e-9) for z in want)


def test_kernels_check_their_contract(spark):
    import pyarrow as pa

    from fluxframe.plans import kernels as K

    df = spark.createDataFrame([(i, None if i == 3 else i) for i in range(10)], "r long, v long")
    with pytest.raises(ValueError):
        K.Kernel(lambda a, _: a, "i64", K.FIXED, 1)
    with pytest.raises(Exception, match="a kernel made 1 values of"):
        K.Kernel(lambda a, _: pa.array([1]), "i64", K.FIXED, chunk=4).apply(df, "v", "w", "r").collect()
    whole = K.Kernel(lambda a, chunk: pa.array([chunk] * len(a)), "i64", K.FIXED, chunk=4).apply(df, "v", "w", "r")
    assert [x.w for x in whole.orderBy("r").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    assert K.Kernel(lambda a, _: a, "i64", K.BOUNDARY, 2).mapping.half == 2 and K.Kernel(lambda a, _: a, "i64", K.FIXED).mapping.is_blocking
    assert rows(df.select(K.row(lambda a, b: f"{a}{b}", "str")("r", "v").alias("x")))[:2] == [("00",), ("11",)]


def test_overflow_policies(spark):
    from fluxframe.streaming import streams

    got = []
    for policy in ("drop_oldest", "drop_newest", "block"):
        streams.overflow(lambda b, _: got.append(sorted(r[0] for r in b.collect())), 2, policy, "id")(spark.range(5), 0)
    assert got == [[3, 4], [0, 1], [0, 1, 2, 3, 4]]
    with pytest.raises(ValueError):
        streams.overflow(print, 1, "drop", "id")


def test_bloom_rules_out_nothing_that_is_there(spark):
    df = spark.range(200).withColumn("part", F.floor(F.col("id") / 20))
    filters = Q.bloom(df, F.col("part"), "id").cache()
    assert all(v // 20 in {r[0] for r in Q.may_hold(filters, v).collect()} for v in (0, 77, 199))
    assert Q.may_hold(filters, 10_000).count() <= 1


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
def test_range_counts_equal_counted_pairs(spark, closed):
    rng = random.Random(9)
    some = lambda: rng.choice([None, math.nan, math.inf, -0.0, *(i / 2 for i in range(-8, 9))])
    a = spark.createDataFrame([(rng.choice([None, 1, 2]), some()) for _ in range(150)] + [(3, 1.0)] * 90, "k int, v double")
    b = spark.createDataFrame([(rng.choice([None, *range(9)]), rng.choice([None, 1, 2, 3, 4]), some(), some()) for _ in range(150)], "g int, k int, lo double, hi double")
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    from_ = v >= lo if closed in ("both", "left") else v > lo
    to = v <= hi if closed in ("both", "right") else v < hi
    for low, high, cond in (("lo", "hi", from_ & to), ("lo", None, from_), (None, "hi", to)):
        for by, same in ((["k"], F.col("a.k") == F.col("b.k")), ([], F.lit(True))):
            want = J.join_where(a.alias("a"), b.alias("b"), same & cond).groupBy("g").count()
            assert rows(J.range_counts(a, b, "v", low, high, "g", by, closed, "count")) == rows(want)
    with pytest.raises(ValueError):
        J.range_counts(a, b, "v", None, None, "g")
    with pytest.raises(ValueError):
        J.range_counts(a, b, "v", "lo", "hi", "g", closed="open")


def test_range_counts_edges(spark):
    a = spark.createDataFrame([(datetime(2024, 1, 1, h), "x") for h in range(9)], "v timestamp, k string")
    b = spark.createDataFrame([(datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 4), "p", 1), (datetime(2024, 1, 1, 4), datetime(2024, 1, 2), "p", 1), (datetime(2024, 1, 3), datetime(2024, 1, 4), "q", 1)], "lo timestamp, hi timestamp, g string, v int")
    assert rows(J.range_counts(a, b, "v", "lo", "hi", ["g", "v"])) == [("p", 1, 8)]
    assert rows(J.range_counts(a.where("false"), b, "v", "lo", "hi", "g")) == rows(J.range_counts(a, b.where("false"), "v", "lo", "hi", "g")) == []
    whole = spark.createDataFrame([(i,) for i in range(5)], "v int")
    assert rows(J.range_counts(whole, spark.createDataFrame([(0.5, 3.5)], "lo double, hi double"), "v", "lo", "hi", "lo")) == [(0.5, 3)]
