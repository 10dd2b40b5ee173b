"""Pivot and unpivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, index: Sequence[str] | str, columns: str, values: str, names: Sequence, order: str | None = None, agg: Column | None = None) -> DataFrame:
    """One column for each of `names`, which are given so that no extra pass looks for them; by default the first value
    in order."""
    keys = [index] if isinstance(index, str) else list(index)
    if agg is None:
        agg = F.min_by(values, order) if order else F.first(values)
    return df.groupBy(*keys).pivot(columns, list(names)).agg(agg)


def unpivot(df: DataFrame, ids: Sequence[str] | str, values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot([ids] if isinstance(ids, str) else list(ids), list(values), variable, value)
