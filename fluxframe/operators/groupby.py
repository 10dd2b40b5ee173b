"""Group-by aggregates. All have partial sums before the exchange, except exact distinct counts of several columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_by(df: DataFrame, keys: Sequence[str] | str, *aggs: Column) -> DataFrame:
    return df.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(*aggs)


def total(c: str, dtype: str | None = None) -> Column:
    """Sum; a group of nulls only gives null. dtype: the type to cast back to."""
    return F.sum(c) if dtype is None else F.sum(c).cast(dtype)


def mean(c: str) -> Column:
    return F.avg(c)


def least(c: str) -> Column:
    return F.min(c)


def greatest(c: str) -> Column:
    """NaN counts as the greatest value."""
    return F.max(c)


def rows() -> Column:
    """Rows, nulls included; `count` and `len` both mean this."""
    return F.count(F.lit(1))


def first(c: str, order: str) -> Column:
    """The value of the first row by position, null if it is null there."""
    return F.min_by(c, order)


def last(c: str, order: str) -> Column:
    return F.max_by(c, order)


def sorted_first(c: str, by: str, order: str, descending: bool = False) -> Column:
    """The value where `by` is least (or greatest); the earliest row of equals."""
    if descending:
        return F.max_by(c, F.struct(F.col(by), -F.col(order)))
    return F.min_by(c, F.struct(F.col(by), F.col(order)))


def std(c: str) -> Column:
    """Sample deviation; null for a single row."""
    return F.stddev_samp(c)


def var(c: str) -> Column:
    return F.var_samp(c)


def filtered(agg, c: str | None, predicate: Column) -> Column:
    """agg over the rows where the predicate holds."""
    return F.count_if(predicate) if c is None else agg(F.when(predicate, F.col(c)))


def n_unique(c: str, nulls: bool = False) -> Column:
    """Distinct values; with nulls=True, null counts as one."""
    out = F.count_distinct(c)
    return out + F.max(F.col(c).isNull().cast("int")) if nulls else out


def approx_n_unique(c: str, error: float = 0.01) -> Column:
    """By a mergeable sketch whose relative standard error is at most `error`."""
    bits = min(21, max(4, math.ceil(2 * math.log2(1.04 / error))))
    return F.hll_sketch_estimate(F.hll_sketch_agg(c, bits))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(rows().alias("count")).orderBy(F.desc("count"), F.col(c))


def unique(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct()


def unique_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(rows().alias("count"))


def salted(df: DataFrame, keys: Sequence[str], partial: Sequence[Column], final: Sequence[Column], salt: Column, n: int = 32) -> DataFrame:
    """Two-stage aggregation for functions without useful partial sums (lists, distinct): first by key and salt."""
    first_ = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(n))).groupBy(*keys, "__salt").agg(*partial)
    return first_.groupBy(*keys).agg(*final)
