"""Frames and pipelines on literal columns."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxframe.functions import exprs as X
from fluxframe.plans.frame import ROW, Frame
from fluxframe.plans.pipeline import HARD, ISOLATE, SOFT, KernelFailure, MissingSource, Pipeline, Settings


def frame(spark, **cols):
    return Frame.from_columns(spark, **cols)


def price(spark, *values):
    return frame(spark, price=("f64", values))


def test_row_and_dependencies(spark):
    p = Pipeline().source("price", "f64").node("tax", lambda r: r.price * 0.2).node("total", lambda r: r.price + r.tax).output("tax", "total")
    out = p.push(price(spark, 10.0, 20.0, 30.0)).compute().result()
    assert out.values("tax") == [2.0, 4.0, 6.0] and out.values("total") == [12.0, 24.0, 36.0]
    assert p.specs()[1].deps == ["price", "tax"] and out.columns == ["tax", "total"]


def test_sort_filter_and_resume(spark):
    assert price(spark, 3.0, 1.0, math.nan, 2.0, None).sort("price").values("price")[0] is None
    got = price(spark, 3.0, 1.0, math.nan, 2.0).sort("price").values("price")
    assert math.isnan(got[0]) and got[1:] == [1.0, 2.0, 3.0]
    assert price(spark, 1.0, -2.0, 3.0, -4.0, math.nan).filter(X.gt(F.col("price"), 0)).values("price") == [1.0, 3.0]
    p = Pipeline().source("price", "f64").column("s", "price", lambda f, c: f.sort(c)).node("t", lambda r: r.s * 0.1).output("s", "t")
    out = p.push(price(spark, 3.0, 1.0, 2.0)).compute().result()
    assert out.values("t") == pytest.approx([0.1, 0.2, 0.3])


def test_positional_zip_across_index_spaces(spark):
    p = Pipeline().source("price", "f64").column("s", "price", lambda f, c: f.sort(c)).node("d", lambda r: r.s - r.price).output("d")
    assert p.push(price(spark, 3.0, 1.0, 2.0)).compute().result().values("d") == [-2.0, 1.0, 1.0]


def test_mixed_types(spark):
    f = frame(spark, prices=("f64", [10.0, 20.0, 30.0]), flags=("i32", [1, 0, 1]))
    p = Pipeline().source("prices", "f64").source("flags", "i32").node("v", lambda r: F.when(r.flags > 0, r.prices).otherwise(F.lit(0.0))).output("v")
    assert p.push(f).compute().result().values("v") == [10.0, 0.0, 30.0]


def test_exact_types_and_missing_source(spark):
    p = Pipeline().source("price", "f64").node("x", lambda r: r.price).output("x")
    with pytest.raises(MissingSource, match="price"):
        p.push(frame(spark, price=("f32", [1.0]))).compute()
    assert frame(spark, price=("f64", [1.0])).get("price", "f32") is None
    assert frame(spark, price=("u8", [1])).get("price", "i16") is None


def test_first_missing_source_wins(spark):
    p = Pipeline().source("a", "f64").source("b", "f64").node("c", lambda r: r.a + r.b).output("c")
    with pytest.raises(MissingSource, match="'a'"):
        p.push(price(spark, 1.0)).compute()


def test_push_again_and_retain(spark):
    p = Pipeline().source("x", "f64").source("y", "f64").node("z", lambda r: r.x * 2 + r.y).output("z")
    p.push(frame(spark, x=("f64", [1.0, 2.0]), y=("f64", [0.0, 1.0])))
    assert p.compute().result().values("z") == [2.0, 5.0]
    p.push(frame(spark, x=("f64", [10.0, 20.0])))
    assert p.compute().result().values("z") == [20.0, 41.0]


def test_nested_reads_the_pushed_frame(spark):
    norm = Pipeline().source("price", "f64").node("n", lambda r: r.price / 10).output("n")
    p = Pipeline().source("price", "f64").nested("norm", norm).node("h", lambda r: r.n * 0.5, of="norm").output("h")
    assert p.push(price(spark, 10.0, 20.0, 40.0)).compute().result().values("h") == [0.5, 1.0, 2.0]


def test_nested_failures(spark):
    def parent(mode):
        broken = Pipeline().source("nowhere", "f64").node("x", lambda r: r.nowhere).output("x")
        return Pipeline().source("price", "f64").nested("b", broken, failure=mode).node("ok", lambda r: r.price * 3).output("ok").push(price(spark, 10.0, 20.0))

    p = parent(ISOLATE).compute()
    assert p.result().values("ok") == [30.0, 60.0] and len(p.errors()) == 1
    p = parent("soft").compute()
    assert "b" in p.drain_warnings()[0] and p.errors() == [] and p.drain_warnings() == []
    with pytest.raises(MissingSource):
        parent("hard").compute()


def test_sub_outputs(spark):
    child = Pipeline().source("price", "f64").node("a", lambda r: r.price * 2).node("b", lambda r: r.price * 3).output("a", "b")
    p = Pipeline().sub(child, a="f64", b="f64").node("s", lambda r: r.a + r.b).output("s")
    assert p.push(price(spark, 10.0, 20.0)).compute().result().values("s") == [50.0, 100.0]
    with pytest.raises(MissingSource, match="missing"):
        Pipeline().sub(child, missing="f64").node("s", lambda r: r.missing).output("s").push(price(spark, 1.0)).compute()


def failing(mode, scope="column"):
    p = Pipeline(Settings(chunk_size=2)).source("price", "f64")
    return p.node("inv", lambda r: 1 / r.price, failure=mode, fail_when=lambda r: r.price == 0, message="division by zero", scope=scope).output("inv")


def test_soft_failure_makes_the_column_na(spark):
    p = failing("soft").push(price(spark, 1.0, 0.0, 2.0)).compute()
    assert p.result().null_count("inv") == 3
    assert p.drain_warnings() == ["node 'inv': kernel failed: division by zero"]
    p = failing("soft").push(price(spark, 1.0, 4.0)).compute()
    assert p.result().values("inv") == [1.0, 0.25] and p.drain_warnings() == []


def test_soft_failure_by_chunk(spark):
    p = failing("soft", "chunk").push(price(spark, 1.0, 0.0, 2.0)).compute()
    assert p.result().values("inv") == [None, None, 0.5]


def test_hard_failure_keeps_the_last_result(spark):
    p = failing("hard").push(price(spark, 2.0)).compute()
    with pytest.raises(KernelFailure, match="node 'inv': division by zero"):
        p.push(price(spark, 0.0)).compute()
    assert p.result().values("inv") == [0.5]


def test_undeclared_nodes_are_checked_too(spark):
    p = Pipeline().source("price", "f64").node("inv", lambda r: 1 / r.price, failure="hard", fail_when=lambda r: r.price == 0).node("ok", lambda r: r.price).output("ok")
    with pytest.raises(KernelFailure):
        p.push(price(spark, 0.0)).compute()


def test_na_goes_downstream(spark):
    p = failing("soft")
    p._outputs = None
    p.node("next", lambda r: r.inv + 1).output("next")
    assert p.push(price(spark, 0.0, 1.0)).compute().result().null_count("next") == 2


def test_empty_frame_never_fails(spark):
    assert failing("hard").push(price(spark)).compute().result().values("inv") == []


def test_declaration_errors():
    with pytest.raises(ValueError, match="twice"):
        Pipeline().source("a", "f64").node("a", lambda r: r.a)
    with pytest.raises(ValueError, match="once"):
        Pipeline().output("a").output("b")
    with pytest.raises(ValueError, match="at least one"):
        Pipeline().output()
    with pytest.raises(ValueError, match="outputs"):
        Pipeline().compute()


def test_frame_rules(spark):
    f = frame(spark, x=("f64", [1.0, 2.0]))
    with pytest.raises(ValueError, match="already contains a column named 'x'"):
        f.append(f)
    with pytest.raises(ValueError, match="length mismatch"):
        f.append(frame(spark, y=("f64", [1.0])))
    assert len(f) == 2 and not f.is_empty() and f.null_count("nope") is None
    assert f.value("x", 1) == 2.0 and f.value("x", 5) is None
    assert f.zip(frame(spark, y=("f64", [5.0]))).values("y") == [5.0]
    assert f.all_na("n", "i32").null_count("n") == 2


def test_vstack(spark):
    a, b = frame(spark, x=("i64", [1, 2])), frame(spark, x=("i64", [3]))
    assert a.vstack(b).values("x") == [1, 2, 3]
    with pytest.raises(ValueError, match="equal columns"):
        a.vstack(frame(spark, x=("f64", [1.0])))


def test_arrow_round_trip_keeps_nulls(spark):
    f = Frame.from_arrow(spark, pa.table({"x": pa.array([1, None, 3], pa.int64())}))
    assert f.null_count("x") == 1 and f.to_arrow()["x"].to_pylist() == [1, None, 3]


def test_number_rows_is_dense(spark):
    df = spark.range(1000).repartition(7)
    assert sorted(Frame.of(df).values("id")) == list(range(1000))
    got = Frame.of(df, [F.desc("id")]).df.orderBy(ROW).collect()
    assert [r["id"] for r in got] == list(range(999, -1, -1)) and [r[ROW] for r in got] == list(range(1000))


def test_outputs_of_different_lengths(spark):
    p = Pipeline().source("price", "f64").column("f", "price", lambda f, c: f.filter(F.col(c) > 1)).output("f", "price")
    with pytest.raises(ValueError, match="length mismatch"):
        p.push(price(spark, 1.0, 2.0)).compute()


def test_plans_push_down(spark, sf):
    from fluxframe.plans.explain import explain, plan_text, pushed_filters, read_columns
    from fluxframe.sources.io import load

    df = load(spark, f"{sf}/lineitem.parquet", columns=["l_orderkey"], where="l_quantity > 10")
    assert any("l_quantity" in f for f in pushed_filters(df)) and set(read_columns(df)) == {"l_orderkey", "l_quantity"}
    from fluxframe.catalog import pricing

    p = pricing().push(Frame.lazy(load(spark, f"{sf}/lineitem.parquet"))).compute()
    assert set(read_columns(p.to_df())) == {"l_extendedprice"}
    assert "Exchange" not in plan_text(p.to_df()) and [n["node"] for n in explain(p)["nodes"]] == ["tax", "total", "net"]


def test_one_check_for_all_nodes_of_a_frame(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(8)], "price double, qty long")
    p = Pipeline().source("price", "f64").source("qty", "i64")
    for i in range(6):
        p.node(f"n{i}", lambda r, i=i: r.price / (r.qty + i + 1), failure=SOFT, fail_when=lambda r, i=i: r.qty + i + 1 == 0)
    p.output("n0", "n5").push(Frame.lazy(df))
    tracker, group = spark.sparkContext.statusTracker(), "one-check"
    spark.sparkContext.setJobGroup(group, group)
    p.compute()
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2 and not p.drain_warnings()


def test_a_soft_failure_is_seen_by_later_checks(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1)], "price double, qty long")
    p = Pipeline().source("price", "f64").source("qty", "i64")
    p.node("a", lambda r: r.price / r.qty, failure=SOFT, fail_when=lambda r: r.qty == 0)
    p.node("b", lambda r: r.a + 1, failure=HARD, fail_when=lambda r: r.a > 1)  # a is all null after its failure
    p.node("c", lambda r: r.price, failure=SOFT, fail_when=lambda r: r.price > 1)
    got = p.output("a", "b", "c").push(Frame.of(df)).compute().to_df().collect()
    assert [tuple(r) for r in got] == [(None, None, None)] * 2
    assert [w.split("'")[1] for w in p.drain_warnings()] == ["a", "c"]


def test_failed_child_keeps_its_types(spark):
    df = spark.createDataFrame([(1.0, 0)], "price double, qty long")
    child = Pipeline().source("qty", "i64").node("x", lambda r: r.qty + 1, failure=HARD, fail_when=lambda r: r.qty == 0).node("s", lambda r: r.x.cast("string")).output("x", "s")
    p = Pipeline().source("price", "f64").nested("kid", child, failure=SOFT).node("y", lambda r: r.x, of="kid").node("z", lambda r: r.s, of="kid").output("y", "z")
    out = p.push(Frame.of(df)).compute().to_df()
    assert dict(out.dtypes) == {"y": "bigint", "z": "string"} and out.count() == 0


def test_settings_are_in_effect(spark):
    df = spark.createDataFrame([(None if i % 4 else 1.0,) for i in range(8)], "price double")
    p = Pipeline(Settings(na_threshold=0.5, chunk_size=4)).source("price", "f64").node("x", lambda r: r.price * 2).output("x").push(Frame.of(df))
    p.compute()
    assert p.drain_warnings() == [f"node 'x' chunk {c}: NA fraction 0.75 exceeds 0.5" for c in (0, 1)]
    p = Pipeline(Settings(purity_check=True)).source("price", "f64").node("x", lambda r: r.price * 2).node("y", lambda r: F.rand()).node("z", lambda r: F.rand(), pure=False).output("x", "y", "z").push(Frame.of(df))
    p.compute()
    assert p.drain_warnings() == ["node 'y': two computations differ, although it is declared pure"]
