"""Missing data. Fills over a whole table run in two levels: within chunks of rows, then across chunk ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_literal(c: Column | str, value) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(value))


def _fill(df: DataFrame, c: str, row: str, forward: bool, name: str, chunk: int) -> DataFrame:
    part = F.floor(F.col(row) / chunk)
    inside = Window.partitionBy("__chunk").orderBy(row)
    if forward:
        near = F.last(c, True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        edge, ends = F.max_by(c, F.when(F.col(c).isNotNull(), F.col(row))), Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        carry = F.last("__edge", True).over(ends)
    else:
        near = F.first(c, True).over(inside.rowsBetween(0, Window.unboundedFollowing))
        edge, ends = F.min_by(c, F.when(F.col(c).isNotNull(), F.col(row))), Window.orderBy("__chunk").rowsBetween(1, Window.unboundedFollowing)
        carry = F.first("__edge", True).over(ends)
    rows = df.withColumn("__chunk", part)
    # One row a chunk goes through the global window.
    edges = rows.groupBy("__chunk").agg(edge.alias("__edge")).select("__chunk", carry.alias("__carry"))
    out = rows.withColumn("__near", near).join(edges, "__chunk")
    return out.withColumn(name, F.coalesce("__near", "__carry")).drop("__chunk", "__near", "__carry")


def fill_forward(df: DataFrame, c: str, row: str, name: str | None = None, chunk: int = 1 << 16) -> DataFrame:
    """The last value before; leading nulls stay. `row` is a whole number that orders the table."""
    return _fill(df, c, row, True, name or c, chunk)


def fill_backward(df: DataFrame, c: str, row: str, name: str | None = None, chunk: int = 1 << 16) -> DataFrame:
    """The next value; trailing nulls stay."""
    return _fill(df, c, row, False, name or c, chunk)


def drop_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in these (by default all) columns; NaN is a value and stays."""
    for c in columns or df.columns:
        df = df.where(F.col(c).isNotNull())
    return df
