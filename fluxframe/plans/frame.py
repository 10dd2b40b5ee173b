"""Frames: DataFrames whose rows have a position, in a hidden column.

Position is what identifies a row, so it is explicit: `__row`, dense from 0. It is made once, without a global window:
rows keep a number within their partition, and partitions' offsets (one row a partition) are joined on.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import dtype_of, field, matches, spark_type
from .storage import materialise

ROW = "__row"
_MID, _PART, _AT = "__mid", "__part", "__at"


def number_rows(df: DataFrame, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """df with ROW, in the order given (or that of its partitions).

    The input is materialised once, so that counting and numbering see the same rows; with an order, a range exchange
    and a sort within partitions come first. Only one row a partition goes through a single task.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    fixed = materialise(df.withColumn(_MID, F.monotonically_increasing_id()))
    part = F.shiftright(_MID, 33)
    sizes = fixed.groupBy(part.alias(_PART)).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(_PART)) - F.col("n")
    offsets = sizes.select(F.col(_PART), before.alias(_AT))
    out = fixed.withColumn(_PART, part).join(offsets, _PART)
    # The numbers within a partition are dense from 0.
    return out.withColumn(ROW, F.col(_AT) + F.col(_MID).bitwiseAND((1 << 33) - 1)).drop(_MID, _PART, _AT)


def nan_first(c: str, df: DataFrame) -> list[Column]:
    """Ascending with NaN before all numbers and nulls before NaN."""
    if isinstance(df.schema[c].dataType, T.FloatType | T.DoubleType):
        return [F.when(F.isnan(c), 0).otherwise(1), F.col(c).asc_nulls_first()] if not df.schema[c].nullable else [F.when(F.col(c).isNull(), -1).when(F.isnan(c), 0).otherwise(1), F.col(c).asc_nulls_first()]
    return [F.col(c).asc_nulls_first()]


class Frame:
    """Ordered, uniquely named columns of equal length."""

    def __init__(self, df: DataFrame):
        if ROW not in df.columns:
            raise ValueError("a frame needs row positions; use Frame.of or Frame.from_columns")
        self.df = df

    @classmethod
    def of(cls, df: DataFrame, order_by: Sequence[str | Column] | None = None, row: str | None = None) -> Frame:
        """From any DataFrame; `row` names a column that already is a dense position."""
        return cls(df.withColumn(ROW, F.col(row).cast("long")) if row else number_rows(df, order_by))

    @classmethod
    def lazy(cls, df: DataFrame) -> Frame:
        """With positions that are unique and ordered, but not dense: enough for row nodes, and free."""
        return cls(df.withColumn(ROW, F.monotonically_increasing_id()))

    @classmethod
    def from_columns(cls, spark: SparkSession, **columns: tuple[str, Sequence]) -> Frame:
        """name=(dtype, values), for small literal data."""
        sizes = {k: len(v) for k, (_, v) in columns.items()}
        if len(set(sizes.values())) > 1:
            raise ValueError(f"column length mismatch: {sizes}")
        schema = T.StructType([T.StructField(ROW, T.LongType(), False), *[field(k, d) for k, (d, _) in columns.items()]])
        rows = list(zip(range(next(iter(sizes.values()), 0)), *[v for _, v in columns.values()]))
        return cls(spark.createDataFrame(rows, schema))

    @classmethod
    def from_arrow(cls, spark: SparkSession, table: pa.Table) -> Frame:
        """An Arrow table, nulls kept."""
        return cls(spark.createDataFrame(table.append_column(ROW, pa.array(range(table.num_rows), pa.int64()))))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    def is_empty(self) -> bool:
        """Whether there are no columns; rows do not matter."""
        return not self.columns

    def __len__(self) -> int:
        return self.df.count() if self.columns else 0

    def dtype(self, name: str) -> str:
        return dtype_of(self.df.schema[name])

    def get(self, name: str, dtype: str) -> DataFrame | None:
        """The column with its positions, or None unless it is there with exactly this type."""
        return self.df.select(ROW, name) if matches(self.df, name, dtype) else None

    def null_count(self, name: str) -> int | None:
        if name not in self.columns:
            return None
        return self.df.agg(F.count_if(F.col(name).isNull())).first()[0]

    def value(self, name: str, row: int):
        """One value by position; None beyond the end."""
        got = self.df.where(F.col(ROW) == row).select(name).first()
        return None if got is None else got[0]

    def values(self, name: str) -> list:
        return [r[0] for r in self.df.orderBy(ROW).select(name).collect()]

    def to_arrow(self) -> pa.Table:
        return self.df.orderBy(ROW).select(*self.columns).toArrow()

    def select(self, *names: str) -> Frame:
        return Frame(self.df.select(ROW, *names))

    def with_column(self, name: str, expr: Column) -> Frame:
        """A derived column of the same rows: a narrow projection."""
        self._fresh(name)
        return Frame(self.df.withColumn(name, expr))

    def all_na(self, name: str, dtype: str) -> Frame:
        return self.with_column(name, F.lit(None).cast(spark_type(dtype)))

    def _fresh(self, name: str) -> None:
        if name in self.columns:
            raise ValueError(f"frame already contains a column named '{name}'")

    def append(self, other: Frame) -> Frame:
        """Columns of another frame, by position; lengths must agree and names be new."""
        for c in other.columns:
            self._fresh(c)
        a, b = len(self), len(other)
        if self.columns and a != b:
            raise ValueError(f"column length mismatch: {a} and {b}")
        return self.zip(other) if self.columns else other

    def zip(self, other: Frame) -> Frame:
        """Columns side by side by position, as far as the shorter goes."""
        return Frame(self.df.join(other.df, ROW))

    def reindex(self, order_by: Sequence[str | Column]) -> Frame:
        return Frame.of(self.df.drop(ROW), order_by)

    # Whole-column operations: they give a new index space.
    def sort(self, name: str) -> Frame:
        """Ascending, NaN first; ties keep their order."""
        return Frame(number_rows(self.df.withColumnRenamed(ROW, "__old"), [*nan_first(name, self.df), F.col("__old")]).drop("__old"))

    def filter(self, predicate: Column) -> Frame:
        """Rows where the predicate holds, in their order."""
        return Frame(number_rows(self.df.where(predicate).withColumnRenamed(ROW, "__old"), ["__old"]).drop("__old"))

    def vstack(self, other: Frame) -> Frame:
        """Rows of another frame below; names and types must agree exactly."""
        if [(f.name, dtype_of(f)) for f in self.select(*self.columns).df.schema[1:]] != [(f.name, dtype_of(f)) for f in other.select(*other.columns).df.schema[1:]]:
            raise ValueError(f"vstack needs equal columns: {self.df.schema} and {other.df.schema}")
        below = other.df.withColumn(ROW, F.col(ROW) + F.lit(len(self)))
        return Frame(self.df.select(ROW, *self.columns).unionAll(below.select(ROW, *self.columns)))

    def hstack(self, other: Frame) -> Frame:
        return self.append(other)
