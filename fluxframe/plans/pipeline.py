"""Pipelines: typed sources, derived nodes and outputs, compiled into one DataFrame plan.

A row node is a function of Columns; it becomes a projection. A node over a column of another index space (after a sort
or filter) is a positional join. Failure conditions are declared per node and checked by one aggregate over all of them,
so that nodes that are not declared as outputs count too, although the optimizer would never run them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field as dc_field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import matches, spark_type
from .frame import ROW, Frame

SOFT, HARD, ISOLATE = "soft", "hard", "isolate"


class PipelineError(Exception):
    pass


class MissingSource(PipelineError):
    def __init__(self, name: str):
        super().__init__(f"missing source '{name}'")
        self.name = name


class KernelFailure(PipelineError):
    def __init__(self, node: str, message: str, chunk: int | None = None):
        super().__init__(f"node '{node}': {message}" if chunk is None else f"node '{node}' chunk {chunk}: {message}")
        self.node, self.message, self.chunk = node, message, chunk


@dataclass(frozen=True)
class Settings:
    failure: str | None = None  # of nodes that do not say their own
    na_threshold: float | None = None  # a chunk with a larger part of nulls in a node is warned of; takes a pass over the rows
    purity_check: bool = False  # nodes declared pure are computed twice and compared
    chunk_size: int = 256
    max_warnings: int = 1000


class Scope:
    """What a node function reads its inputs from; it records the names in order of first use."""

    def __init__(self, columns: dict[str, Column]):
        self._columns, self.deps = columns, []

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Column:
        if name not in self._columns:
            raise KeyError(f"no source or node '{name}' is declared before")
        if name not in self.deps:
            self.deps.append(name)
        return self._columns[name]


@dataclass
class NodeSpec:
    name: str
    kind: str  # row, col, nested, sub
    fn: Callable | None = None
    failure: str | None = None
    fail_when: Callable | None = None
    message: str = "failure condition holds"
    scope: str = "column"  # what a soft failure turns to null: the column, or the chunk
    pure: bool = True
    dtype: str | None = None
    of: str | None = None  # the nested frame that a row node reads
    child: Any = None
    outputs: dict[str, str] = dc_field(default_factory=dict)
    deps: list[str] = dc_field(default_factory=list)


class Pipeline:
    def __init__(self, settings: Settings = Settings()):
        self.settings = settings
        self._sources: dict[str, str] = {}
        self._renamed: dict[str, str] = {}
        self._items: list[NodeSpec] = []
        self._outputs: list[str] | None = None
        self._pushed: dict[str, Frame] = {}
        self._frame: Frame | None = None  # the last frame pushed, for nested and sub-pipelines
        self._result: Frame | None = None
        self._warnings: list[str] = []
        self._errors: list[PipelineError] = []

    # Declaration
    def source(self, name: str, dtype: str, from_: str | None = None) -> Pipeline:
        spark_type(dtype)
        self._sources[name] = dtype
        self._renamed[name] = from_ or name
        return self

    def _add(self, spec: NodeSpec) -> Pipeline:
        if spec.name in self._sources or any(i.name == spec.name for i in self._items):
            raise ValueError(f"'{spec.name}' is declared twice")
        self._items.append(spec)
        return self

    def node(self, name: str, fn: Callable[[Scope], Column], *, failure: str | None = None, fail_when: Callable[[Scope], Column] | None = None, message: str = "failure condition holds", scope: str = "column", pure: bool = True, dtype: str | None = None, of: str | None = None) -> Pipeline:
        """A row node. `fail_when` says for which rows the function fails; it is never evaluated there.

        failure: soft turns the column (or chunk) to null with a warning, hard raises at compute, None leaves Spark's
        own error to the action that meets it. `of` names a nested pipeline whose output columns are read as well.
        """
        if failure not in (None, SOFT, HARD):
            raise ValueError(f"unknown failure mode '{failure}'")
        return self._add(NodeSpec(name, "row", fn, failure or self.settings.failure, fail_when, message, scope, pure, dtype, of))

    def column(self, name: str, of: str, fn: Callable[[Frame, str], Frame]) -> Pipeline:
        """A whole-column node: fn gets a frame with the one column and its name, and returns a frame in a new index space."""
        return self._add(NodeSpec(name, "col", fn, of=of))

    def nested(self, name: str, child: Pipeline, failure: str = HARD) -> Pipeline:
        """A pipeline that is pushed the same frame; its outputs are read with node(of=name)."""
        return self._add(NodeSpec(name, "nested", failure=failure, child=child))

    def sub(self, child: Pipeline, **outputs: str) -> Pipeline:
        """A pipeline whose named outputs, of these types, become columns here; always hard."""
        return self._add(NodeSpec(f"sub({', '.join(outputs)})", "sub", failure=HARD, child=child, outputs=outputs))

    def output(self, *names: str) -> Pipeline:
        if self._outputs is not None:
            raise ValueError("outputs are declared once")
        if not names:
            raise ValueError("a pipeline has at least one output")
        self._outputs = list(names)
        return self

    # Use
    def push(self, frame: Frame) -> Pipeline:
        """Takes the columns that are sources here, of exactly their types; other sources keep what they had."""
        for name, dtype in self._sources.items():
            if matches(frame.df, self._renamed[name], dtype):
                self._pushed[name] = frame
        self._frame = frame
        for i in self._items:
            if i.child is not None:
                i.child.push(frame)
        return self

    def compute(self, eager: bool = False) -> Pipeline:
        """Builds the plan. Runs the failure checks, if any node has one; with eager, the whole plan too."""
        if self._outputs is None:
            raise ValueError("a pipeline needs outputs")
        self._errors = []
        for name in self._sources:
            if name not in self._pushed:
                raise MissingSource(name)
        state = self._compiled()
        result = state.outputs(self._outputs)
        if self.settings.na_threshold is not None:
            self._warn_of_nulls(state)
        if self.settings.purity_check:
            self._warn_of_impure(state)
        if eager:
            result.df.write.format("noop").mode("overwrite").save()
        self._result = result
        return self

    def _compiled(self) -> _Compiler:
        """The plan with all failure conditions checked: one aggregate over all of an index space's conditions if none
        holds. After a soft failure, what depends on the failed node is checked again."""
        known: dict[str, bool] = {}
        children: dict[str, Any] = {}
        while True:
            state = _Compiler(self, known, children).run()
            failed = state.first_failure()
            if failed is None:
                return state
            spec, error = failed
            if spec.failure == HARD:
                raise KernelFailure(spec.name, spec.message if error is None else str(error)) from error
            self.warn(f"node '{spec.name}': kernel failed: {spec.message}")
            for other in state.checked_before(spec):
                known[other] = False
            known[spec.name] = True

    def _declared(self, like: DataFrame) -> list[T.StructField]:
        """The outputs' types, from the declared types of the sources and the nodes' functions, without any data."""
        empty = Pipeline(self.settings)
        empty._sources, empty._renamed, empty._items, empty._outputs = self._sources, {n: n for n in self._sources}, self._items, self._outputs
        schema = T.StructType([T.StructField(ROW, T.LongType()), *[T.StructField(n, spark_type(t), True) for n, t in self._sources.items()]])
        none = Frame(like.sparkSession.createDataFrame([], schema))
        empty._pushed = dict.fromkeys(self._sources, none)
        children: dict[str, Any] = {}
        for i in self._items:
            if i.child is not None:
                fields = i.child._declared(like)
                children[i.name] = Frame(like.sparkSession.createDataFrame([], T.StructType([T.StructField(ROW, T.LongType()), *fields])))
        state = _Compiler(empty, {i.name: False for i in self._items}, children).run()
        return [T.StructField(n, state.spaces[state.where[n]].schema[n].dataType, True) for n in self._outputs]

    def _warn_of_nulls(self, state: _Compiler) -> None:
        for df, names in state.nodes():
            share = [F.avg(F.col(n).isNull().cast("double")).alias(n) for n in names]
            by = df.groupBy(F.floor(F.col(ROW) / self.settings.chunk_size).cast("long").alias("__chunk")).agg(*share)
            many = by.where(" OR ".join(f"`{n}` > {self.settings.na_threshold}" for n in names)).orderBy("__chunk").limit(self.settings.max_warnings)
            for r in many.collect():
                for n in names:
                    if r[n] > self.settings.na_threshold:
                        self.warn(f"node '{n}' chunk {r['__chunk']}: NA fraction {r[n]:.2f} exceeds {self.settings.na_threshold}")

    def _warn_of_impure(self, state: _Compiler) -> None:
        pure = {i.name for i in self._items if i.kind == "row" and i.pure}

        def hashes(x: _Compiler) -> dict[str, int]:
            out = {}
            for df, names in x.nodes():
                names = [n for n in names if n in pure]
                if names:
                    out |= df.agg(*[F.bit_xor(F.xxhash64(ROW, n)).alias(n) for n in names]).first().asDict()
            return out

        one, two = hashes(state), hashes(_Compiler(self, state.known, state.children).run())
        for n in one:
            if one[n] != two[n]:
                self.warn(f"node '{n}': two computations differ, although it is declared pure")

    def result(self) -> Frame | None:
        """The output frame of the last successful compute; None before the first."""
        return self._result

    def to_df(self) -> DataFrame:
        """The declared outputs without positions."""
        if self._result is None:
            raise ValueError("nothing is computed yet")
        return self._result.df.select(*self._outputs)

    def warn(self, text: str) -> None:
        if len(self._warnings) < self.settings.max_warnings:
            self._warnings.append(text)

    def drain_warnings(self) -> list[str]:
        out, self._warnings = self._warnings, []
        return out

    def errors(self) -> list[PipelineError]:
        return list(self._errors)

    def specs(self) -> list[NodeSpec]:
        return list(self._items)

    def sources(self) -> dict[str, str]:
        return dict(self._sources)


class _Compiler:
    """Turns the items, in declaration order, into one DataFrame for each index space."""

    def __init__(self, p: Pipeline, known: dict[str, bool], children: dict[str, Any]):
        self.p = p
        self.known = known  # whether a node fails, as far as it is checked
        self.children = children  # results of nested and sub-pipelines, computed once
        self.checks: list[tuple[NodeSpec, int, Column]] = []  # conditions that are not checked yet, by index space
        self.spaces: list[DataFrame] = []
        self.where: dict[str, int] = {}  # column -> index space
        self.nested: dict[str, tuple[int, list[str]]] = {}
        by_frame: dict[int, tuple[Frame, list[str]]] = {}
        for name, frame in p._pushed.items():
            by_frame.setdefault(id(frame), (frame, []))[1].append(name)
        for frame, names in by_frame.values():
            df = frame.df.select(ROW, *[F.col(p._renamed[n]).alias(n, metadata=dict(frame.df.schema[p._renamed[n]].metadata or {})) for n in names])
            if self.spaces:
                self.spaces[0] = self.spaces[0].join(df, ROW)
            else:
                self.spaces.append(df)
            self.where.update(dict.fromkeys(names, 0))

    def run(self) -> _Compiler:
        for spec in self.p._items:
            getattr(self, f"_{spec.kind}")(spec)
        return self

    def _space_with(self, names: Sequence[str]) -> int:
        """The index space of the first name, with the others' columns joined on by position if they are elsewhere."""
        home = self.where[names[0]] if names else 0
        away: dict[int, list[str]] = {}
        for n in names:
            if self.where[n] != home and n not in self.spaces[home].columns:
                away.setdefault(self.where[n], []).append(n)
        for space, cols in away.items():
            self.spaces[home] = self.spaces[home].join(self.spaces[space].select(ROW, *cols), ROW)
        return home

    def _row(self, spec: NodeSpec) -> None:
        visible = {n: F.col(n) for n in self.where}
        rename = {}
        if spec.of is not None:
            space, cols = self.nested[spec.of]
            rename = {c: f"{spec.of}__{c}" for c in cols}
            visible |= {c: F.col(f"{spec.of}__{c}") for c in cols}
        scope = Scope(visible)
        value = spec.fn(scope)
        fails = spec.fail_when(scope) if spec.fail_when else None
        spec.deps = scope.deps
        home = self._space_with([rename.get(d, d) for d in scope.deps])
        if fails is not None:
            fails = F.coalesce(fails, F.lit(False))
            value = F.when(~fails, value)
            if spec.failure is not None and spec.name not in self.known:
                self.checks.append((spec, home, fails))
            failed = self.known.get(spec.name, False)
            if failed and spec.scope == "chunk":
                chunk = Window.partitionBy(F.floor(F.col(ROW) / self.p.settings.chunk_size))
                value = F.when(~F.bool_or(fails).over(chunk), value)
            elif failed:
                value = F.when(F.lit(False), value)
        if spec.dtype:
            value = value.cast(spark_type(spec.dtype))
        self.spaces[home] = self.spaces[home].withColumn(spec.name, value)
        self.where[spec.name] = home

    def first_failure(self) -> tuple[NodeSpec, PySparkException | None] | None:
        """The first node, as declared, whose condition holds for a row, or whose check fails (with its error)."""
        found: set[str] = set()
        try:
            for home in dict.fromkeys(h for _, h, _ in self.checks):
                own = [(spec.name, fails) for spec, h, fails in self.checks if h == home]
                row = self.spaces[home].agg(*[F.bool_or(fails).alias(name) for name, fails in own]).first()
                found |= {name for name, _ in own if row[name]}
        except PySparkException:  # one at a time, to say which
            for spec, home, fails in self.checks:
                try:
                    if self.spaces[home].agg(F.bool_or(fails)).first()[0]:
                        return spec, None
                except PySparkException as e:
                    return spec, e
        return next(((spec, None) for spec, _, _ in self.checks if spec.name in found), None)

    def checked_before(self, spec: NodeSpec) -> list[str]:
        names = [x.name for x, _, _ in self.checks]
        return names[: names.index(spec.name)]

    def nodes(self) -> list[tuple[DataFrame, list[str]]]:
        """Row nodes by index space."""
        rows = [i.name for i in self.p._items if i.kind == "row"]
        return [(df, own) for k, df in enumerate(self.spaces) if (own := [n for n in rows if self.where[n] == k])]

    def _col(self, spec: NodeSpec) -> None:
        spec.deps = [spec.of]
        frame = Frame(self.spaces[self.where[spec.of]].select(ROW, spec.of))
        out = spec.fn(frame, spec.of)
        self.spaces.append(out.df.select(ROW, F.col(spec.of).alias(spec.name)))
        self.where[spec.name] = len(self.spaces) - 1

    def _computed(self, spec: NodeSpec) -> Frame:
        if spec.name not in self.children:
            try:
                spec.child.compute()
                self.children[spec.name] = spec.child.result()
            except PipelineError as e:
                self.children[spec.name] = e
                if spec.failure == SOFT:
                    self.p.warn(f"node '{spec.name}': nested pipeline failed: {e}")
                elif spec.failure == ISOLATE:
                    self.p._errors.append(e)
        if isinstance(self.children[spec.name], PipelineError):
            raise self.children[spec.name]
        return self.children[spec.name]

    def _nested(self, spec: NodeSpec) -> None:
        cols = spec.child._outputs
        try:
            df = self._computed(spec).df
        except PipelineError:
            if spec.failure == HARD:
                raise
            df = self.spaces[0].sparkSession.createDataFrame([], T.StructType([T.StructField(ROW, T.LongType()), *spec.child._declared(self.spaces[0])]))
        self.spaces.append(df.select(ROW, *[F.col(c).alias(f"{spec.name}__{c}") for c in cols]))
        self.where.update({f"{spec.name}__{c}": len(self.spaces) - 1 for c in cols})
        self.nested[spec.name] = (len(self.spaces) - 1, cols)

    def _sub(self, spec: NodeSpec) -> None:
        frame = self._computed(spec)
        for name, dtype in spec.outputs.items():
            if not matches(frame.df, name, dtype):
                raise MissingSource(name)
        self.spaces.append(frame.df.select(ROW, *spec.outputs))
        self.where.update(dict.fromkeys(spec.outputs, len(self.spaces) - 1))

    def outputs(self, names: list[str]) -> Frame:
        for n in names:
            if n not in self.where:
                raise MissingSource(n)
        home = self.where[names[0]]
        spaces = {self.where[n] for n in names}
        if len(spaces) > 1:
            sizes = [self.spaces[s].count() for s in spaces]
            if len(set(sizes)) > 1:
                raise ValueError(f"column length mismatch: outputs have {sizes} rows")
            home = self._space_with(names)
        return Frame(self.spaces[home].select(ROW, *names))
