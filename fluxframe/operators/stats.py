"""Column statistics, histograms, correlations, outliers and samples, each in one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, min, max, mean, null_count of numeric columns, in one pass."""
    aggs = [a for c in columns for a in (F.min(c).cast("double").alias(f"{c}__a"), F.max(c).cast("double").alias(f"{c}__b"), F.avg(c).alias(f"{c}__m"), F.count_if(F.col(c).isNull()).alias(f"{c}__n"))]
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}__a").alias("min"), F.col(f"{c}__b").alias("max"), F.col(f"{c}__m").alias("mean"), F.col(f"{c}__n").alias("null_count")) for c in columns])
    return df.agg(*aggs).select(F.inline(rows))


def partition_stats(df: DataFrame, by: Column, columns: Sequence[str]) -> DataFrame:
    """min, max and null count of each part: what pruning needs."""
    return df.groupBy(by.alias("part")).agg(*[a for c in columns for a in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))])


def prune(stats: DataFrame, column: str, low, high) -> DataFrame:
    """The parts that may hold a value within [low, high]."""
    return stats.where((F.col(f"{column}_max") >= F.lit(low)) & (F.col(f"{column}_min") <= F.lit(high))).select("part")


def pruned(stats: DataFrame, column: str, low, high) -> DataFrame:
    """The log of `prune`'s decisions: part, kept, reason."""
    reason = F.when(F.col(f"{column}_max").isNull(), "no values").when(F.col(f"{column}_max") < F.lit(low), "all below").when(F.col(f"{column}_min") > F.lit(high), "all above")
    return stats.select("part", reason.isNull().alias("kept"), F.coalesce(reason, F.lit("may match")).alias("reason"))


def _bits(c: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(c.cast("string"), F.lit(i)), F.lit(bits)).cast("int") for i in range(hashes)]


def bloom(df: DataFrame, by: Column, column: str, bits: int = 8192, hashes: int = 3) -> DataFrame:
    """part, bits: the set bits of a Bloom filter of each part's values, `bits` at most."""
    set_ = F.explode(F.array(*_bits(F.col(column), bits, hashes)))
    return df.where(F.col(column).isNotNull()).select(by.alias("part"), set_.alias("bit")).groupBy("part").agg(F.array_sort(F.collect_set("bit")).alias("bits"))


def may_hold(filters: DataFrame, value, bits: int = 8192, hashes: int = 3) -> DataFrame:
    """The parts whose filter does not rule the value out; bits and hashes as the filters were made with."""
    hit = F.lit(True)
    for b in _bits(F.lit(value), bits, hashes):
        hit = hit & F.array_contains("bits", b)
    return filters.where(hit).select("part")


def histogram(df: DataFrame, c: str, low: float, high: float, bins: int) -> DataFrame:
    """bin_edge, count over [low, high]; the last bin includes its end; empty bins are left out."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    rows = df.where(F.col(c).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return rows.select((F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_edge"), "count")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, corr of each pair of columns, all in one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))


def outliers(df: DataFrame, c: str, sigmas: float = 3.0, name: str = "outlier") -> DataFrame:
    """df with a flag. Mean and deviation are one row, joined on as such."""
    one = df.agg(F.avg(c).alias("__mean"), F.stddev_samp(c).alias("__std"))
    out = df.crossJoin(F.broadcast(one))
    return out.withColumn(name, F.abs(F.col(c) - F.col("__mean")) > sigmas * F.col("__std")).drop("__mean", "__std")


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, the same ones at every run: those of the least digests of their key, by partial top-n."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def extend_sample(old: DataFrame, new: DataFrame, key: str, n: int) -> DataFrame:
    """The sample of all rows, from that of the rows before and the new rows alone."""
    return sample(old.unionByName(sample(new, key, n)), key, n)


def page(df: DataFrame, order: Sequence[str | Column], offset: int, limit: int, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).orderBy(*order).offset(offset).limit(limit)
