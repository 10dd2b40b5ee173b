"""What a pipeline will do: nodes, dependencies, mappings, and Spark's own plan."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from .incremental import CHUNK, Incremental
from .pipeline import Pipeline


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that reach the scans."""
    return [f for group in re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(df)) for f in re.split(r", (?=[A-Z])", group) if f]


def read_columns(df: DataFrame) -> list[str]:
    """The columns that the scans read."""
    return re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<(.*?)>\n", plan_text(df) + "\n")))


def count_nodes(df: DataFrame, pattern: str) -> int:
    return len(re.findall(rf"^[\s:+\-*()\d]*({pattern})\b", plan_text(df, "simple"), re.M))


def explain(p: Pipeline) -> dict:
    """Nodes in declaration order with mode, dependencies and failure mode, and the compiled physical plan."""
    nodes = [{"node": s.name, "kind": s.kind, "deps": list(s.deps), "failure": s.failure, "pure": s.pure} for s in p.specs()]
    df = p.to_df() if p.result() is not None else None
    return {"sources": p.sources(), "nodes": nodes, "warnings": list(p._warnings), "plan": plan_text(df) if df is not None else None}


def profile(inc: Incremental, run: Callable[[], DataFrame] | None = None) -> dict:
    """Seconds of a run, and the parts of chunks and rows that it recomputed."""
    total = inc.source.count()
    dirty = inc.dirty_chunks().count()
    chunks = -(-total // inc.size)
    began = time.perf_counter()
    (run or inc.run)()
    return {"seconds": time.perf_counter() - began, "chunks": chunks, "dirty_chunks": dirty, "dirty_ratio": dirty / chunks if chunks else 0.0, "key": CHUNK}
