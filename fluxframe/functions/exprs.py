"""Guarded arithmetic: IEEE division, truncating integer division, NaN-safe comparison, casts.

All are Column expressions, so they stay in whole-stage code generation. Nulls propagate: a null in any input gives null.
Spark's ANSI mode may stay on, since each expression keeps its failing cases away from the failing operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import FLOATS, RANGES, spark_type

NAN, INF = float("nan"), float("inf")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def all_valid(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull()
    return out


def propagate(value: Column, *inputs: Column) -> Column:
    """value, but null where any input is."""
    return F.when(all_valid(*inputs), value)


def _negative(x: Column) -> Column:
    """The sign bit, which tells -0.0 from 0.0."""
    return (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))


def ieee_div(a, b) -> Column:
    """Float division with signed infinities and NaN at zero divisors."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(_negative(a) == _negative(b), F.lit(INF)).otherwise(F.lit(-INF))
    return propagate(F.when(b == 0, at_zero).otherwise(F.try_divide(a, b)), a, b)


def ieee_rem(a, b) -> Column:
    """Float remainder with the dividend's sign; NaN for a zero divisor or an infinite dividend."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    bad = (b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF)
    return propagate(F.when(bad, F.lit(NAN)).when(F.abs(b) == INF, a).otherwise(F.try_mod(a, b)), a, b)


def int_div(a, b) -> Column:
    """Truncates toward zero; null where the divisor is 0 (pair it with `zero_divisor` as a failure condition)."""
    a, b = _col(a).cast("long"), _col(b).cast("long")
    return F.call_function("div", a, F.when(b != 0, b))


def int_rem(a, b) -> Column:
    """The remainder with the dividend's sign; null where the divisor is 0."""
    a, b = _col(a).cast("long"), _col(b).cast("long")
    return a % F.when(b != 0, b)


def zero_divisor(b) -> Column:
    return F.coalesce(_col(b) == 0, F.lit(False))


def int_pow(a, n: int) -> Column:
    """Repeated multiplication, by squaring."""
    if n < 0:
        raise ValueError("integer powers need an exponent of at least 0")
    out, base = None, _col(a)
    while n:
        if n & 1:
            out = base if out is None else out * base
        base, n = base * base, n >> 1
    return propagate(F.lit(1), _col(a)) if out is None else out


def power(a, b) -> Column:
    return F.pow(_col(a).cast("double"), _col(b).cast("double"))


def _ordered(a: Column, b: Column, test: Column) -> Column:
    """False if either side is NaN."""
    return propagate(test & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")), a, b)


def gt(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _ordered(a, b, a > b)


def ge(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _ordered(a, b, a >= b)


def lt(a, b) -> Column:
    return gt(b, a)


def le(a, b) -> Column:
    return ge(b, a)


def eq(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _ordered(a, b, a == b)


def ne(a, b) -> Column:
    return ~eq(a, b)


def xor(a, b) -> Column:
    """Of booleans."""
    a, b = _col(a), _col(b)
    return a != b


def cond(mask, then, otherwise) -> Column:
    """then where mask is not 0 (NaN is not 0), else otherwise; a null in any of the three gives null."""
    m, t, o = _col(mask), _col(then), _col(otherwise)
    return propagate(F.when(m.cast("double") != 0, t).otherwise(o), m, t, o)


def is_null_mask(c: Column, one=1.0, zero=0.0) -> Column:
    return F.when(c.isNull(), F.lit(one)).otherwise(F.lit(zero))


def _whole(n: int) -> Column:
    """A literal of any size."""
    return F.lit(str(n)).cast("decimal(38,0)")


def _bounded(x: Column, lo: int, hi: int) -> Column:
    wide = x.cast("decimal(38,0)")
    return F.greatest(F.least(wide, _whole(hi)), _whole(lo))


def saturating_cast(c, dtype: str, from_float: bool = False) -> Column:
    """Narrowing stops at the type's limits; floats are cut toward zero; NaN gives 0; booleans give 1 and 0."""
    c = _col(c)
    if dtype == "bool":
        return c.cast("double") != 0
    if dtype in FLOATS:
        return c.cast(spark_type(dtype))
    lo, hi = RANGES[dtype]
    t = spark_type(dtype)
    if not from_float:
        return _bounded(c, lo, hi).cast(t)
    x = c.cast("double")
    inside = F.when(F.isnan(x), F.lit(0)).when(x >= float(hi), _whole(hi)).when(x <= float(lo), _whole(lo))
    # The cast sees only values that fit, whatever order the optimizer evaluates the branches in.
    fits = F.when((x < float(hi)) & (x > float(lo)), x)
    return propagate(F.coalesce(inside, F.when(fits >= 0, F.floor(fits)).otherwise(F.ceil(fits)).cast("decimal(38,0)")).cast(t), c)


def wrapping_cast(c, dtype: str) -> Column:
    """Integer to integer, keeping the low bits."""
    lo, hi = RANGES[dtype]
    span = _whole(hi - lo + 1)
    x = _col(c).cast("decimal(38,0)")
    return (F.pmod(x - _whole(lo), span) + _whole(lo)).cast(spark_type(dtype))


def as_cast(c, source: str, dtype: str) -> Column:
    """Between numeric types: floats saturate (NaN gives 0), integers wrap, and whole numbers widen."""
    if dtype == "bool":
        raise ValueError("numbers are compared, not cast, to booleans")
    if source in FLOATS:
        return saturating_cast(c, dtype, from_float=True)
    if dtype in FLOATS:
        return _col(c).cast(spark_type(dtype))
    if source == "bool":
        return _col(c).cast("int").cast(spark_type(dtype))
    return wrapping_cast(c, dtype)
