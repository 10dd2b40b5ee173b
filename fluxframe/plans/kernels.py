"""Python code in nodes, for what Columns cannot say: it runs in Arrow batches.

`row` makes a Column of a Python function, for Pipeline.node. A Kernel maps a column's chunks to as many values; its
contract says which rows a value depends on, and so how the column is dealt out: an element-independent kernel runs in
whatever batches there are, without a shuffle; one of fixed chunks gets whole chunks; a boundary-dependent one gets
chunks with `half` rows more to each side. A chunk fits one task; its size is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.types import spark_type
from .dag import POINTWISE, RESHAPE, Mapping, local_window
from .frame import ROW, Frame

ELEMENT, FIXED, BOUNDARY = "element independent", "fixed chunks", "boundary dependent"


def row(fn: Callable, dtype: str, deterministic: bool = True) -> Callable[..., Column]:
    """A Column function of a Python function of single values. A null argument gives null without a call."""
    kind = to_arrow_type(spark_type(dtype))

    def batch(*columns: pa.Array) -> pa.Array:
        rows = zip(*[c.to_pylist() for c in columns])
        return pa.array([None if None in r else fn(*r) for r in rows], kind)

    udf = F.arrow_udf(batch, spark_type(dtype))
    return udf if deterministic else udf.asNondeterministic()


@dataclass(frozen=True)
class Kernel:
    """fn: a chunk's values in order and its number, to as many values. A boundary-dependent fn also gets up to `half`
    rows of either neighbour and returns a value for those too, which is left out."""

    fn: Callable[[pa.Array, int], pa.Array]
    dtype: str
    contract: str = ELEMENT
    half: int = 0
    chunk: int = 1 << 16

    def __post_init__(self):
        if self.contract not in (ELEMENT, FIXED, BOUNDARY):
            raise ValueError(f"unknown contract '{self.contract}'")
        if self.half and self.contract != BOUNDARY or not 0 <= self.half < self.chunk:
            raise ValueError("half is 0 or more, less than a chunk, and of boundary-dependent kernels only")

    @property
    def mapping(self) -> Mapping:
        """How changes pass through: a fixed chunk's values all depend on each other."""
        return {ELEMENT: POINTWISE, FIXED: RESHAPE, BOUNDARY: local_window(self.half)}[self.contract]

    def _run(self, values: pa.Array, chunk: int) -> pa.Array:
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        out = pa.array(self.fn(values, chunk), to_arrow_type(spark_type(self.dtype)))
        if len(out) != len(values):
            raise ValueError(f"a kernel made {len(out)} values of {len(values)}")
        return out

    def apply(self, df: DataFrame, c: str, name: str, row: str = ROW) -> DataFrame:
        """df with the kernel's values. An element-independent kernel is told chunk -1, for its batches are no chunks."""
        if self.contract == ELEMENT:

            def batch(values: pa.Array) -> pa.Array:
                return self._run(values, -1)

            return df.withColumn(name, F.arrow_udf(batch, spark_type(self.dtype))(c))
        at = F.floor(F.col(row) / F.lit(self.chunk)).cast("long")
        ids = F.array(at)
        if self.half:
            near = [F.floor(F.greatest(F.col(row) + k, F.lit(0)) / F.lit(self.chunk)).cast("long") for k in (-self.half, self.half)]
            ids = F.array_distinct(F.array(near[0], at, near[1]))
        wide = df.withColumn("__home", at).withColumn("__at", F.explode(ids))
        schema = T.StructType([*df.schema.fields, T.StructField(name, spark_type(self.dtype), True)])

        def group(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by(row)
            own = pc.equal(t["__home"], key[0])
            t = t.append_column(name, self._run(t[c], key[0].as_py()))
            return t.filter(own).select(schema.names)

        return wide.groupBy("__at").applyInArrow(group, schema)

    def column(self, frame: Frame, name: str) -> Frame:
        """For Pipeline.column: the column replaced by the kernel's values, in the same index space."""
        return Frame(self.apply(frame.df, name, "__value").select(ROW, F.col("__value").alias(name)))
