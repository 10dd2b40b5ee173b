"""Arithmetic and casts where the rules differ from Spark's own."""

import math

import pytest
from pyspark.sql import functions as F

from fluxframe.functions import exprs as X
from fluxframe.functions import strings as S

NAN, INF = math.nan, math.inf


def one(spark, expr, **cols):
    names, values = list(cols), list(cols.values())
    df = spark.createDataFrame([tuple(v for v, _ in values)], ", ".join(f"{n} {t}" for n, (_, t) in zip(names, values)))
    return df.select(expr.alias("v")).first()[0]


@pytest.mark.parametrize("a,b,want", [(1.0, 0.0, INF), (-1.0, 0.0, -INF), (1.0, -0.0, -INF), (0.0, 0.0, NAN), (NAN, 0.0, NAN), (6.0, 4.0, 1.5), (INF, 0.0, INF), (None, 0.0, None)])
def test_ieee_div(spark, a, b, want):
    got = one(spark, X.ieee_div(F.col("a"), F.col("b")), a=(a, "double"), b=(b, "double"))
    assert got == want or (want is not None and math.isnan(want) and math.isnan(got))


@pytest.mark.parametrize("a,b,want", [(7.5, 2.0, 1.5), (-7.5, 2.0, -1.5), (1.0, 0.0, NAN), (INF, 2.0, NAN), (3.0, INF, 3.0)])
def test_ieee_rem(spark, a, b, want):
    got = one(spark, X.ieee_rem(F.col("a"), F.col("b")), a=(a, "double"), b=(b, "double"))
    assert got == want or math.isnan(want) and math.isnan(got)


@pytest.mark.parametrize("a,b,q,r", [(7, 2, 3, 1), (-7, 2, -3, -1), (7, -2, -3, 1), (10, 3, 3, 1), (5, 0, None, None), (9007199254740993, 1, 9007199254740993, 0)])
def test_int_div_rem(spark, a, b, q, r):
    assert one(spark, X.int_div(F.col("a"), F.col("b")), a=(a, "long"), b=(b, "long")) == q
    assert one(spark, X.int_rem(F.col("a"), F.col("b")), a=(a, "long"), b=(b, "long")) == r


def test_nan_compares_false(spark):
    for f in (X.gt, X.ge, X.lt, X.le, X.eq):
        assert one(spark, f(F.col("a"), F.col("b")), a=(NAN, "double"), b=(1.0, "double")) is False
        assert one(spark, f(F.col("a"), F.col("a")), a=(NAN, "double")) is False
    assert one(spark, X.ne(F.col("a"), F.col("a")), a=(NAN, "double")) is True
    assert one(spark, X.gt(F.col("a"), 1.0), a=(None, "double")) is None


def test_cond_mask(spark):
    rows = spark.createDataFrame([(1.0, 10.0, 100.0), (0.0, 20.0, 200.0), (NAN, 30.0, 300.0), (None, 40.0, 400.0), (1.0, 50.0, None)], "m double, t double, e double")
    assert [r[0] for r in rows.select(X.cond(F.col("m"), F.col("t"), F.col("e"))).collect()] == [10.0, 200.0, 30.0, None, None]
    assert [r[0] for r in rows.select(X.is_null_mask(F.col("m"))).collect()] == [0.0, 0.0, 0.0, 1.0, 0.0]


@pytest.mark.parametrize("v,t,want", [(300.7, "i8", 127), (-300.7, "i8", -128), (NAN, "i32", 0), (1e20, "i32", 2147483647), (-1.9, "i32", -1), (-5.0, "u8", 0), (1e30, "u64", 18446744073709551615), (None, "i8", None), (INF, "i64", 9223372036854775807)])
def test_saturating_from_float(spark, v, t, want):
    assert one(spark, X.saturating_cast(F.col("v"), t, from_float=True), v=(v, "double")) == want


@pytest.mark.parametrize("v,t,saturated,wrapped", [(300, "i8", 127, 44), (-129, "i8", -128, 127), (-1, "u8", 0, 255), (256, "u8", 255, 0), (5, "i16", 5, 5)])
def test_integer_casts(spark, v, t, saturated, wrapped):
    assert one(spark, X.saturating_cast(F.col("v"), t), v=(v, "long")) == saturated
    assert one(spark, X.as_cast(F.col("v"), "i64", t), v=(v, "long")) == wrapped


def test_power(spark):
    assert one(spark, X.int_pow(F.col("v"), 5), v=(-3, "long")) == -243
    assert one(spark, X.int_pow(F.col("v"), 0), v=(7, "long")) == 1
    with pytest.raises(ValueError):
        X.int_pow(F.lit(2), -1)


@pytest.mark.parametrize("s,want", [("aXbX", "a-bX"), ("none", "none"), ("", ""), (None, None), ("X", "-")])
def test_replace_first(spark, s, want):
    assert one(spark, S.str_replace(F.col("s"), "X", "-"), s=(s, "string")) == want


def test_byte_strings(spark):
    assert one(spark, S.str_len(F.col("s")), s=("é!", "string")) == 3
    assert one(spark, S.str_slice(F.col("s"), 0, 2), s=("é!", "string")) == "é"
    assert one(spark, S.str_slice(F.col("s"), -1, 1), s=("é!", "string")) == "!"
