"""Incremental recomputation: change tracking by chunk of rows, and pipelines that recompute only what a change reaches.

A chunk is floor(row / chunk_size). Chunk bookkeeping for a known number of rows is plain driver-side sets. The changes of a
large table are DataFrames; up to LISTED dirty chunk ids are known to the driver and become ranges of positions, which
filter files by their statistics, and more are a DataFrame that is joined on. Inputs of a recomputed chunk include the
rows that its windows reach, so results do not depend on chunk borders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as dc_field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.window import centred
from .dag import ALL, POINTWISE, Graph, Mapping, Range, local_window
from .frame import ROW
from .pipeline import HARD, SOFT, KernelFailure, Scope
from .storage import materialise

CHUNK = "__chunk"
LISTED = 10_000  # dirty chunk ids that the driver holds, at most
RANGES = 200  # runs of chunks that become range filters; more are looked up by id


def chunk_of(row: Column | str, size: int) -> Column:
    return F.floor((F.col(row) if isinstance(row, str) else row) / F.lit(size)).cast("long")


class ChunkMap:
    """Which chunks of a column of `rows` rows are dirty."""

    def __init__(self, rows: int = 0, size: int = 256):
        self.rows, self.size, self._dirty = rows, size, set()

    @property
    def count(self) -> int:
        return -(-self.rows // self.size)

    def chunks(self) -> list[int]:
        """Rows in each chunk."""
        return [min(self.size, self.rows - c * self.size) for c in range(self.count)]

    def mark(self, start: int, end: int) -> None:
        """Marks rows start .. end - 1; an empty range marks nothing, and rows beyond the end do not count."""
        end = min(end, self.rows)
        if start < end:
            self._dirty.update(range(start // self.size, (end - 1) // self.size + 1))

    def mark_range(self, rows: Range) -> None:
        self.mark_all() if rows is ALL else self.mark(*rows)

    def mark_all(self) -> None:
        self._dirty = set(range(self.count))

    def clear(self, chunk: int | None = None) -> None:
        if chunk is None:
            self._dirty.clear()
        else:
            self._dirty.discard(chunk)

    def is_dirty(self, chunk: int | None = None) -> bool:
        return bool(self._dirty) if chunk is None else chunk in self._dirty

    def dirty(self) -> list[int]:
        return sorted(self._dirty)

    def append(self, rows: int) -> None:
        """New rows dirty the chunks that they fall into, a partly filled last one included."""
        before = self.rows
        self.rows += rows
        self.mark(before, self.rows)


@dataclass
class Node:
    name: str
    fn: Callable[[Scope], Column] | None = None
    mapping: Mapping = POINTWISE
    rolling: tuple[str, str, int] | None = None  # (column, aggregate, half) instead of fn: over half rows to each side
    pure: bool = True
    failure: str | None = None
    fail_when: Callable[[Scope], Column] | None = None
    deps: list[str] = dc_field(default_factory=list)


Chunks = list[int] | DataFrame  # ids, in order if listed; a DataFrame has CHUNK


def _within(chunks: list[int], size: int) -> Column:
    """Whether a row is in one of the chunks."""
    runs: list[list[int]] = []
    for c in chunks:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    if len(runs) > RANGES:
        return chunk_of(ROW, size).isin(chunks)
    out = F.lit(False)
    for a, b in runs:
        out = out | F.col(ROW).between(a * size, (b + 1) * size - 1)
    return out


def rows_of(df: DataFrame, chunks: Chunks, size: int) -> DataFrame:
    if isinstance(chunks, list):
        return df.where(_within(chunks, size))
    return df.withColumn(CHUNK, chunk_of(ROW, size)).join(chunks, CHUNK, "left_semi").select(*df.columns)


def replace_chunks(base: DataFrame, new: DataFrame, chunks: Chunks, size: int) -> DataFrame:
    """base with the rows of these chunks taken from `new`, which has no others."""
    if isinstance(chunks, list):
        kept = base.where(~_within(chunks, size))
    else:
        kept = base.withColumn(CHUNK, chunk_of(ROW, size)).join(chunks, CHUNK, "left_anti")
    return kept.select(*base.columns).unionByName(new.select(*base.columns))


class Incremental:
    """Derived columns over a source with ROW, kept up to date under appends, mutations and replacement.

    Window nodes give (column, aggregate, half) as `rolling`. Nodes whose mapping blocks are recomputed as a whole.
    """

    def __init__(self, source: DataFrame, nodes: list[Node], chunk_size: int = 256, na_threshold: float = 0.5, max_warnings: int = 1000, max_layers: int = 8):
        self.size, self.na_threshold, self.max_warnings, self.max_layers = chunk_size, na_threshold, max_warnings, max_layers
        self._base: DataFrame | None = None  # the result as it was last written as a whole
        self._replaced: set[int] = set()  # chunks of it that later layers hold
        self._layers: list[tuple[DataFrame, set[int]]] = []  # results of runs since, with their chunks that are still valid
        self.source, self.nodes = source, nodes
        self.inputs = [c for c in source.columns if c != ROW]
        self.graph = Graph()
        for c in self.inputs:
            self.graph.add(c)
        for n in nodes:
            scope = Scope({c: F.col(c) for c in self.graph.inputs})
            if n.rolling:
                scope[n.rolling[0]]
                n.mapping = local_window(n.rolling[2])
            else:
                n.fn(scope)
            n.deps = scope.deps
            self.graph.add(n.name, scope.deps, n.mapping)
        self.graph.order()
        self.result: DataFrame | None = None
        self.recomputed: DataFrame | None = None
        self._dirty: Chunks = []  # those of source rows that changed
        self._all = True
        self._warnings: list[str] = []

    def drain_warnings(self) -> list[str]:
        out, self._warnings = self._warnings, []
        return out

    def reach(self) -> int | None:
        """Rows to each side of a change that its effects go; None if some node needs all rows."""
        found = [self.graph.reach(n.name) for n in self.nodes]
        return None if None in found else max(found, default=0)

    def _spread(self, rows: DataFrame, reach: int) -> DataFrame:
        """CHUNK ids that rows within `reach` of these rows fall into."""
        lo = chunk_of(F.greatest(F.col(ROW) - reach, F.lit(0)), self.size)
        hi = chunk_of(F.col(ROW) + reach, self.size)
        return rows.select(F.explode(F.sequence(lo, hi)).alias(CHUNK)).distinct()

    def _touch(self, rows: DataFrame) -> None:
        reach = self.reach()
        if reach is None:
            self._all = True
        if self._all:
            return
        new = self._spread(rows.select(ROW), reach)
        if isinstance(self._dirty, list):
            found = [r[0] for r in new.limit(LISTED + 1).collect()]
            both = sorted({*self._dirty, *found})
            if len(found) <= LISTED and len(both) <= LISTED:
                self._dirty = both
                return
            self._dirty = self._listed(rows.sparkSession, self._dirty)
        self._dirty = self._dirty.union(new).distinct()

    @staticmethod
    def _listed(spark, ids: list[int]) -> DataFrame:
        return spark.createDataFrame([(i,) for i in ids], f"{CHUNK} long")

    def mutate(self, changed: DataFrame) -> None:
        """changed: ROW and all source columns of rows that have new values."""
        kept = self.source.join(changed.select(ROW), ROW, "left_anti")
        self.source = kept.unionByName(changed.select(*self.source.columns))
        self._touch(changed)

    def append(self, rows: DataFrame) -> None:
        """rows: ROW beyond the present ones, and all source columns."""
        self.source = self.source.unionByName(rows.select(*self.source.columns))
        self._touch(rows)

    def replace(self, source: DataFrame) -> None:
        self.source, self._all = source, True

    def dirty_chunks(self) -> DataFrame:
        """CHUNK ids that the next run recomputes."""
        every = self.source.select(chunk_of(ROW, self.size).alias(CHUNK)).distinct()
        if self._all or self.result is None or not all(n.pure for n in self.nodes):
            return every
        if isinstance(self._dirty, list):
            return every.where(F.col(CHUNK).isin(self._dirty))
        return every.join(self._dirty, CHUNK, "left_semi")

    def evaluate(self, df: DataFrame) -> DataFrame:
        for n in self.nodes:
            if n.rolling:
                df = centred(df, *n.rolling, ROW, n.name)
                continue
            scope = Scope({c: F.col(c) for c in self.graph.inputs})
            value = n.fn(scope)
            if n.fail_when is not None:
                fails = F.coalesce(n.fail_when(Scope({c: F.col(c) for c in self.graph.inputs})), F.lit(False))
                # A failing row takes its whole chunk with it.
                value = F.when(~F.bool_or(fails).over(Window.partitionBy(chunk_of(ROW, self.size))), F.when(~fails, value))
            df = df.withColumn(n.name, value)
        return df

    def full(self) -> DataFrame:
        return self.evaluate(self.source)

    def run(self) -> DataFrame:
        """The derived table. Only dirty chunks, with the rows that their windows reach, are computed."""
        reach = self.reach()
        chunks: Chunks | None = None  # all
        if self.result is None or reach is None or self._all or not all(n.pure for n in self.nodes):
            new = self.full()
        else:
            chunks = self._dirty
            beside = -(-reach // self.size)
            if isinstance(chunks, list):
                near: Chunks = sorted({c for x in chunks for c in range(max(x - beside, 0), x + beside + 1)})
            else:
                chunks = materialise(chunks)
                near = chunks.select(F.explode(F.sequence(F.greatest(F.col(CHUNK) - F.lit(beside), F.lit(0)), F.col(CHUNK) + F.lit(beside))).alias(CHUNK)).distinct()
            new = rows_of(self.evaluate(rows_of(self.source, near, self.size)), chunks, self.size)
        new = materialise(new)
        self._failures(new)
        self.recomputed = new
        self._keep(new, chunks)
        self.source = self.result.select(*self.source.columns)
        self._dirty, self._all = [], False
        return self.result

    def _keep(self, new: DataFrame, chunks: Chunks | None) -> None:
        """Makes `new` part of the result. Only new chunks are written; a layer whose chunks have all been replaced since
        is dropped, and many layers are merged."""
        if isinstance(chunks, list):
            gone = set(chunks)
            self._replaced |= gone
            self._layers = [(df, left) for df, live in self._layers if (left := live - gone)] + [(new, gone)]
            parts = [df.where(_within(sorted(live), self.size)) if df is not new else df for df, live in self._layers]
            self.result = self._base.where(~_within(sorted(self._replaced), self.size)).select(*new.columns)
            for part in parts:
                self.result = self.result.unionByName(part)
            if len(self._layers) < self.max_layers and len(self._replaced) <= LISTED:
                return
            self._base = materialise(self.result)
        else:
            self._base = new if chunks is None else materialise(replace_chunks(self.result.select(*new.columns), new, chunks, self.size))
        self.result, self._layers, self._replaced = self._base, [], set()

    def _failures(self, new: DataFrame) -> None:
        """One aggregate by chunk: failed chunks of nodes with a mode, and chunks with too many nulls."""
        watched = [n for n in self.nodes if n.failure in (SOFT, HARD) and n.fail_when is not None]
        if not watched:
            return
        sums = []
        for n in watched:
            fails = n.fail_when(Scope({c: F.col(c) for c in self.graph.inputs}))
            sums += [F.bool_or(F.coalesce(fails, F.lit(False))).alias(f"f_{n.name}"), F.avg(F.col(n.name).isNull().cast("double")).alias(f"n_{n.name}")]
        by = new.groupBy(chunk_of(ROW, self.size).alias(CHUNK)).agg(*sums)
        any_ = F.lit(False)
        for n in watched:
            any_ = any_ | F.col(f"f_{n.name}") | (F.col(f"n_{n.name}") > self.na_threshold)
        rows = by.where(any_).orderBy(CHUNK).limit(self.max_warnings).collect()
        for r in rows:
            for n in watched:
                if r[f"f_{n.name}"] and n.failure == HARD:
                    raise KernelFailure(n.name, "failure condition holds", r[CHUNK])
                if r[f"f_{n.name}"]:
                    self._warn(f"node '{n.name}' chunk {r[CHUNK]}: kernel failed: failure condition holds")
                if r[f"n_{n.name}"] > self.na_threshold:
                    self._warn(f"node '{n.name}' chunk {r[CHUNK]}: NA fraction {r[f'n_{n.name}']:.2f} exceeds {self.na_threshold}")
        hard = [n for n in watched if n.failure == HARD]
        if hard and len(rows) >= self.max_warnings:  # the limit is one of warnings: hard failures may lie in chunks beyond
            first = by.agg(*[F.min(F.when(F.col(f"f_{n.name}"), F.col(CHUNK))).alias(n.name) for n in hard]).first()
            failed = [(first[n.name], k) for k, n in enumerate(hard) if first[n.name] is not None]
            if failed:
                at, k = min(failed)
                raise KernelFailure(hard[k].name, "failure condition holds", at)

    def _warn(self, text: str) -> None:
        if len(self._warnings) < self.max_warnings:
            self._warnings.append(text)

    def impure_chunks(self, name: str) -> DataFrame:
        """CHUNK ids where two evaluations of a node differ."""
        hashed = lambda: self.full().groupBy(chunk_of(ROW, self.size).alias(CHUNK)).agg(F.bit_xor(F.xxhash64(ROW, name)).alias("h"))
        a, b = materialise(hashed()), materialise(hashed())
        return a.alias("a").join(b.alias("b"), CHUNK).where("a.h <> b.h").select(CHUNK)


class Deltas:
    """Changes that are pushed without computing anything, and put together before they reach the table.

    A replacement makes earlier changes void. Neighbouring mutations become one, in which the last value of a row counts,
    and neighbouring appends one; appends and mutations keep their order, since a mutation may be of appended rows. The
    watermark is the greatest that was pushed; it never goes back.
    """

    KINDS = ("append", "mutate", "replace", "watermark")

    def __init__(self, target: Incremental):
        self.target, self.watermark = target, None
        self._held: list[tuple[str, list[DataFrame]]] = []

    def push(self, kind: str, change) -> Deltas:
        """change: rows with ROW and all source columns, or the time of a watermark."""
        if kind not in self.KINDS:
            raise ValueError(f"unknown kind of change '{kind}'")
        if kind == "watermark":
            self.watermark = change if self.watermark is None else max(self.watermark, change)
        elif kind == "replace":
            self._held = [(kind, [change])]
        elif self._held and self._held[-1][0] == kind:
            self._held[-1][1].append(change)
        else:
            self._held.append((kind, [change]))
        return self

    def __len__(self) -> int:
        """Changes to the table that are left after putting them together."""
        return len(self._held)

    def _latest(self, changes: list[DataFrame]) -> DataFrame:
        names = [ROW, *self.target.inputs]
        every = None
        for i, df in enumerate(changes):
            one = df.select(F.lit(i).alias("__at"), F.struct(*names).alias("__new"))
            every = one if every is None else every.union(one)
        return every.groupBy(F.col(f"__new.{ROW}").alias("__key")).agg(F.max_by("__new", "__at").alias("__new")).select("__new.*")

    def flush(self) -> DataFrame:
        """Applies what is held and computes what it reaches; with nothing held, the result as it is."""
        held, self._held = self._held, []
        for kind, changes in held:
            if kind == "mutate":
                self.target.mutate(changes[0] if len(changes) == 1 else materialise(self._latest(changes)))
            elif kind == "replace":
                self.target.replace(changes[0])
            else:
                rows = changes[0]
                for more in changes[1:]:
                    rows = rows.unionByName(more)
                self.target.append(rows)
        return self.target.run() if held or self.target.result is None else self.target.result


def na_fraction(df: DataFrame, name: str, size: int = 256, row: str = ROW) -> DataFrame:
    """The part of nulls in each chunk."""
    return df.groupBy(chunk_of(row, size).alias("chunk_id")).agg(F.avg(F.col(name).isNull().cast("double")).alias("na_fraction"))


def refresh_groups(old: DataFrame, before: DataFrame, after: DataFrame, changed_keys: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """A group-by under change: only groups with a key of a changed row, old or new, are computed again.

    old: the previous result; before and after are only needed for the keys' existence, so `before` may be the old rows
    that changed; changed_keys: the keys of changed rows in their old and new versions.
    """
    touched = changed_keys.select(*keys).distinct()
    new = after.join(touched, keys, "left_semi").groupBy(*keys).agg(*aggs)
    return old.join(touched, keys, "left_anti").unionByName(new.select(*old.columns))


def refresh_join(old: DataFrame, left: DataFrame, right: DataFrame, changed_keys: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join under change: only rows with a changed key on either side are joined again."""
    touched = changed_keys.select(*keys).distinct()
    new = left.join(touched, keys, "left_semi").join(right.join(touched, keys, "left_semi"), keys, how)
    return old.join(touched, keys, "left_anti").unionByName(new.select(*old.columns))


class Epochs:
    """Nodes are dirty while a dependency is newer than their own computation."""

    def __init__(self, graph: Graph):
        self.graph, self._now = graph, 0
        self.changed: dict[str, int] = {}
        self.computed: dict[str, int] = {}

    def touch(self, name: str) -> int:
        self._now += 1
        self.changed[name] = self._now
        return self._now

    def version(self, name: str) -> int:
        """The newest change that the node or anything below it has seen."""
        return max([self.changed.get(name, 0), *(self.version(i) for i in self.graph.inputs[name])])

    def is_dirty(self, name: str) -> bool:
        return bool(self.graph.inputs[name]) and self.version(name) > self.computed.get(name, 0)

    def done(self, name: str) -> None:
        self.computed[name] = self.version(name)


class History:
    """Versions of a table in one folder, for replay and row traces."""

    def __init__(self, path: str):
        self.path, self.version = path, 0

    def save(self, df: DataFrame) -> int:
        self.version += 1
        df.write.parquet(f"{self.path}/version={self.version}")
        return self.version

    def at(self, spark, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/version={version}")

    def trace(self, spark, row: int) -> DataFrame:
        """A row's values in every version; versions are pruned by folder, rows by the scan's filter."""
        return spark.read.parquet(self.path).where(F.col(ROW) == row).orderBy("version")
