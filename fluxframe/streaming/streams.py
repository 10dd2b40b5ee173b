"""Streams: sources, event-time windows, per-key state, sinks that keep a table up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of files. files_per_batch bounds a batch, so a slow sink holds the source back."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None, **options) -> DataFrame:
    """Needs the Kafka connector's jar on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    return (reader.option("maxOffsetsPerTrigger", max_offsets) if max_offsets else reader).load()


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """df with a watermark. Zoneless times become timestamps of the session's zone, which should be UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _windowed(df: DataFrame, window: Column, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    out = df.groupBy(window.alias("w"), *by).agg(*aggs)
    names = [c for c in out.columns if c not in ("w", *by)]
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *by, *names)


def tumbling_window(df: DataFrame, ts: str, duration: str, aggs: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Windows side by side; in append mode a window is emitted when the watermark passes its end."""
    return _windowed(df, F.window(ts, duration), by, aggs)


def sliding_window(df: DataFrame, ts: str, size: str, step: str, aggs: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    return _windowed(df, F.window(ts, size, step), by, aggs)


def ema(df: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """key, order, ema: an exponential moving average per key, whose state outlives batches.

    Rows of a batch are ordered by `order`; batches must arrive in that order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        s = state.get[0] if state.exists else None
        out = []
        for v in rows[value]:
            s = float(v) if s is None else alpha * float(v) + (1 - alpha) * s
            out.append(s)
        state.update((s,))
        yield pd.DataFrame({key: k[0], order: rows[order], "ema": out})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, ema double", "s double", "append", GroupStateTimeout.NoTimeout)


def to_parquet(df: DataFrame, path: str, mode: str = "complete") -> str:
    """Drains what is there; path/result then holds the output (of complete mode), written by the executors."""
    replace = "overwrite" if mode == "complete" else "append"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode(replace).parquet(f"{path}/result")

    to_batches(df, put, f"{path}/checkpoint", mode).awaitTermination()
    return f"{path}/result"


def to_table(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Drains what is there into an in-memory table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def to_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Calls fn with each batch, at least once; with the batch id, fn can make it exactly once."""
    return df.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def overflow(fn: Callable[[DataFrame, int], None], capacity: int, policy: str, order: str) -> Callable[[DataFrame, int], None]:
    """A batch function that hands at most `capacity` rows of a batch on, by the policy that the caller chose: drop_oldest
    keeps the rows latest in `order`, drop_newest the earliest, block all of them (bound the source's batches then)."""
    if policy not in ("block", "drop_oldest", "drop_newest"):
        raise ValueError(f"unknown policy '{policy}'")

    def put(batch: DataFrame, batch_id: int) -> None:
        if policy != "block":
            batch = batch.orderBy(F.col(order).desc() if policy == "drop_oldest" else F.col(order).asc()).limit(capacity)
        fn(batch, batch_id)

    return put


def to_view(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the latest row of each key: versions side by side, the newest named by a batch id."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*batch.columns, F.lit(batch_id).alias("__batch"))
        try:
            old = spark.read.parquet(f"{path}/v{batch_id - 1}")
        except Exception as e:  # no version before
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = new.where("false")
        kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
        kept.unionByName(new).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return merge
