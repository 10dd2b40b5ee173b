"""Batch sources and sinks. Paths are opened by Spark's own readers, so any store that Spark knows works."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats that Spark reads without further jars, and those that need one.
BUILT_IN = ("parquet", "orc", "csv", "json", "text", "avro")
NEEDS_JAR = ("delta", "iceberg")


def load(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema: T.StructType | str | None = None, columns: Sequence[str] | None = None, where: Column | str | None = None, **options) -> DataFrame:
    """A static table. Columns and filter are part of the plan, so they reach columnar scans."""
    if fmt not in BUILT_IN + NEEDS_JAR:
        raise ValueError(f"unknown format '{fmt}'")
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path if isinstance(path, str) else list(path))
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def load_arrow(spark: SparkSession, source: str | bytes) -> DataFrame:
    """An Arrow IPC file or stream, read by the driver: for small tables."""
    with pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source) as f:
        try:
            table = pa.ipc.open_file(f).read_all()
        except pa.ArrowInvalid:
            f.seek(0)
            table = pa.ipc.open_stream(f).read_all()
        return spark.createDataFrame(table)


def load_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A query that the database runs. partition: (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, parts = partition
    return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def remote_sql(table: str, steps: Sequence[tuple[str, str]], outputs: Sequence[str], where: str | None = None) -> str:
    """A chain of derived columns as one statement of common table expressions, to be run where the data is.

    steps: (name, SQL expression over what is there before).
    """
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    ctes = [f"s0 AS (SELECT * FROM {table}{f' WHERE {where}' if where else ''})"]
    for i, (name, expr) in enumerate(steps, 1):
        ctes.append(f"s{i} AS (SELECT *, {expr} AS {quote(name)} FROM s{i - 1})")
    return f"WITH {', '.join(ctes)} SELECT {', '.join(map(quote, outputs))} FROM s{len(steps)}"


def with_files(df: DataFrame) -> DataFrame:
    """df with the file and its change time of each row, for file sources."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_modification_time").alias("__changed"))


def changed_files(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Files of df that are new, or newer than in `seen` (__file, __changed)."""
    now = with_files(df).groupBy("__file").agg(F.max("__changed").alias("__changed"))
    old = seen.select("__file", F.col("__changed").alias("__before"))
    return now.join(old, "__file", "left").where("__before IS NULL OR __changed > __before").select("__file", "__changed")


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: Sequence[str] = (), **options) -> None:
    df.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def save_buckets(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """A table whose later joins and groups on these keys need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def save_chunks(df: DataFrame, path: str, chunk: str) -> None:
    """Replaces only the chunks that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(path)


class View:
    """A materialised view: the last result under one name, and callbacks on change."""

    def __init__(self, name: str):
        self.name, self._calls = name, []

    def on_change(self, fn: Callable[[DataFrame], None]) -> View:
        self._calls.append(fn)
        return self

    def update(self, df: DataFrame) -> None:
        df.createOrReplaceTempView(self.name)
        for fn in self._calls:
            fn(df)
