"""Logical dtypes and their Spark types. Types without a Spark counterpart keep a tag in the field's metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TAG = "logical_type"
# Logical type names, their Spark types and integer ranges.
SPARK_TYPES: dict[str, T.DataType] = {
    "f16": T.FloatType(),
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "bool": T.BooleanType(),
    "str": T.StringType(),
    "ts": T.TimestampNTZType(),
}
RANGES = {f"i{n}": (-(1 << n - 1), (1 << n - 1) - 1) for n in (8, 16, 32, 64)} | {f"u{n}": (0, (1 << n) - 1) for n in (8, 16, 32, 64)}
TAGGED = {"f16", "u8", "u16", "u32", "u64"}
FLOATS = {"f16", "f32", "f64"}
NUMERIC = {*RANGES, *FLOATS}


def spark_type(dtype: str) -> T.DataType:
    if dtype not in SPARK_TYPES:
        raise ValueError(f"unknown dtype '{dtype}'")
    return SPARK_TYPES[dtype]


def field(name: str, dtype: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, spark_type(dtype), nullable, {TAG: dtype} if dtype in TAGGED else None)


def dtype_of(f: T.StructField) -> str:
    """The logical type of a field: its tag, or the first type that Spark's type stands for."""
    if f.metadata and TAG in f.metadata:
        return f.metadata[TAG]
    for name, t in SPARK_TYPES.items():
        if name not in TAGGED and t == f.dataType:
            return name
    return f.dataType.simpleString()


def matches(df: DataFrame, name: str, dtype: str) -> bool:
    """Exact: no coercion, and tags count."""
    return name in df.columns and dtype_of(df.schema[name]) == dtype
