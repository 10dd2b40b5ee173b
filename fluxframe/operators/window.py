"""Window functions, partitioned by keys; the functions of a DataFrame serve whole tables, in chunks that run in parallel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeseries import micros

# The aggregates that roll or broadcast.
AGGREGATES: dict[str, Callable] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def over(c: str, agg: str, keys: Sequence[str] | str) -> Column:
    """A group's aggregate on each of its rows."""
    return AGGREGATES[agg](c).over(Window.partitionBy(*([keys] if isinstance(keys, str) else keys)))


def over_list(c: str, keys: Sequence[str] | str, order: str) -> Column:
    """A group's values, in order, on each of its rows."""
    w = Window.partitionBy(*([keys] if isinstance(keys, str) else keys))
    return F.transform(F.array_sort(F.collect_list(F.struct(order, c)).over(w)), lambda s: s[c])


def explode_groups(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows with groups together, in order within each."""
    return df.orderBy(*keys, order)


def rolling_rows(df: DataFrame, c: str, agg: str, rows: int, row: str, name: str, min_periods: int | None = None, chunk: int = 1 << 16) -> DataFrame:
    """`rolling` for a whole table without keys, in the order of dense positions `row`: each chunk of positions also gets
    the rows before it that its windows reach, so chunks run in parallel."""
    chunk = max(chunk, rows)
    at = F.floor(F.col(row) / chunk)
    wide = df.withColumn("__home", at).withColumn("__chunk", F.explode(F.array_distinct(F.array(at, F.floor((F.col(row) + (rows - 1)) / chunk)))))
    w = Window.partitionBy("__chunk").orderBy(row).rowsBetween(-(rows - 1), 0)
    need = rows if min_periods is None else min_periods
    out = wide.withColumn(name, F.when(F.count(c).over(w) >= need, AGGREGATES[agg](c).over(w)))
    return out.where("__home = __chunk").drop("__home", "__chunk")


def rolling_span(df: DataFrame, c: str, agg: str, ts: str, seconds: float, name: str) -> DataFrame:
    """`rolling_time` for a whole table without keys: time falls into bins as long as the window, and each bin also gets
    the rows of the bin before, so bins run in parallel. Rows without a time get null."""
    span = int(seconds * 1_000_000)
    at = F.floor(micros(F.col(ts)) / F.lit(span))
    wide = df.withColumn("__home", at).withColumn("__bin", F.explode(F.array_distinct(F.array("__home", F.col("__home") + 1))))
    w = Window.partitionBy("__bin").orderBy(micros(F.col(ts))).rangeBetween(-(span - 1), 0)
    out = wide.withColumn(name, F.when(F.col(ts).isNotNull(), AGGREGATES[agg](c).over(w)))
    return out.where("__home = __bin OR (__home IS NULL AND __bin IS NULL)").drop("__home", "__bin")


def rolling(c: str, agg: str, rows: int, order: str, keys: Sequence[str] | str = (), min_periods: int | None = None) -> Column:
    """Over the row and those before it, `rows` together; null until min_periods (by default all) values are there.

    Without keys this is one global window; use `rolling_rows` for whole tables.
    """
    w = Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order).rowsBetween(-(rows - 1), 0)
    need = rows if min_periods is None else min_periods
    return F.when(F.count(c).over(w) >= need, AGGREGATES[agg](c).over(w))


def rolling_time(c: str, agg: str, ts: str, seconds: float, keys: Sequence[str] | str = ()) -> Column:
    """Over (t - seconds, t]. Without keys this is one global window; use `rolling_span` for whole tables."""
    w = Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(micros(F.col(ts))).rangeBetween(-(int(seconds * 1_000_000) - 1), 0)
    return AGGREGATES[agg](c).over(w)


def centred(df: DataFrame, c: str, agg: str, half: int, row: str, name: str, chunk: int = 1 << 16) -> DataFrame:
    """df with an aggregate over half rows to each side of a row, for a whole table without keys: rows near a chunk's
    border are copied to the neighbour, so chunks run in parallel."""
    at = F.floor(F.col(row) / chunk)
    ids = F.array_distinct(F.array(F.floor(F.greatest(F.col(row) - half, F.lit(0)) / chunk), at, F.floor((F.col(row) + half) / chunk)))
    if half >= chunk:
        raise ValueError("half must be smaller than a chunk")
    wide = df.withColumn("__home", at).withColumn("__chunk", F.explode(ids))
    w = Window.partitionBy("__chunk").orderBy(row).rowsBetween(-half, half)
    return wide.withColumn(name, AGGREGATES[agg](c).over(w)).where("__home = __chunk").drop("__home", "__chunk")


def _smoothed(x, alpha: float, state: float | None):
    """The averages after each value of x, from a state before it, and the state after it."""
    import numpy as np

    if not len(x):
        return x, state
    out = np.empty(len(x))
    step = 256 if alpha < 0.9 else 16  # so that powers of 1 - alpha stay far above the least double
    while (1 - alpha) ** step < 1e-200 and step > 1:
        step //= 2
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        if state is None:
            out[lo], state, part, lo = part[0], part[0], part[1:], lo + 1
        weight = (1 - alpha) ** np.arange(1, len(part) + 1)
        if len(part):
            if alpha >= 1:
                out[lo : lo + len(part)] = part
            else:
                out[lo : lo + len(part)] = weight * (state + np.cumsum(alpha * part / weight))
            state = out[lo + len(part) - 1]
    return out, float(state)


def ema(df: DataFrame, c: str, alpha: float, order: str, keys: Sequence[str], name: str = "ema") -> DataFrame:
    """Exponential moving average in order, per key: s = alpha * x + (1 - alpha) * s, from the first value.

    A null repeats the average before it (null, if there is none). A row-ordered fold: each key's rows are sorted and
    streamed as Arrow batches, of which only the state is kept; runs of a key are filtered in numpy.
    """
    import numpy as np
    import pyarrow as pa

    def fold(batches):
        last: tuple | None = None  # key of the rows before, and its state
        for b in batches:
            if not b.num_rows:
                continue
            ids = list(zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]))
            x = b.column(b.schema.get_field_index(c)).to_pandas().to_numpy(dtype=float, na_value=np.nan)
            null = b.column(b.schema.get_field_index(c)).is_null().to_numpy(zero_copy_only=False)
            first = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            out = np.empty(len(x))
            gone = np.zeros(len(x), bool)
            for lo, hi in zip(first, first[1:]):
                state = last[1] if last is not None and last[0] == ids[lo] else None
                own, there = x[lo:hi], ~null[lo:hi]
                smooth, state = _smoothed(own[there], alpha, state)
                # A null leaves the state as it is.
                at = np.cumsum(there) - 1
                before = last[1] if last is not None and last[0] == ids[lo] else None
                out[lo:hi] = np.where(at >= 0, smooth[np.maximum(at, 0)] if len(smooth) else np.nan, np.nan if before is None else before)
                gone[lo:hi] = (at < 0) & (before is None)
                last = (ids[lo], state)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=gone)], [*b.schema.names, name])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(fold, f"{kind}, {name} double")
