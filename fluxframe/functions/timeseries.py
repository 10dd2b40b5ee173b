"""Resampling and time ranges over timestamps without a zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Resampling rules.
RULES = ("second", "minute", "hour", "day")


def micros(ts: Column) -> Column:
    """Microseconds since 1970, reading a zoneless timestamp as UTC."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def resample(df: DataFrame, ts: str, rule: str, aggs: Sequence[Column], by: Sequence[str] = (), every: int = 1) -> DataFrame:
    """Groups into windows [start, start + every rules), labelled by their start; one aggregation with partial sums."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    window = F.window(F.col(ts), f"{every} {rule}")
    out = df.groupBy(*by, window.alias("_w")).agg(*aggs)
    return out.select(*by, F.col("_w.start").cast(df.schema[ts].dataType).alias(ts), *[c for c in out.columns if c not in (*by, "_w")])


def ohlc(value: str, ts: str, tie: str | None = None) -> list[Column]:
    """open, high, low and close of a value by time; `tie` orders rows of equal time."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return [F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close")]


def filter_time_range(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Both bounds are included; the bounds are literals, so the filter reaches the scan."""
    kind = df.schema[ts].dataType
    return df.where(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
