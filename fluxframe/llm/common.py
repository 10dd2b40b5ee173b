"""What the operators share: table access, shared-folder cuts of lineage, worker import path, bounded slices."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes of an Arrow batch, and rows of a Parquet reader's, so that batches of very long texts stay in memory.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20
READER_ROWS = 512
GROUP_BYTES = 16 << 20  # of settled files' row groups, which a writer holds in memory


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep batches of texts small. Settings of the session only; no job runs.

    They last, since plans are lazy and read them when they run; results do not depend on them.
    """
    env = spark.sparkContext.environment
    # The driver's own path may have been set after its JVM began, so what counts is what workers are given.
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[x for x in paths if x and x != ROOT]])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see; a temporary one only in local mode, where none
    is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="fluxframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class _Scratch(threading.local):
    def __init__(self):
        self.open: list[list[str]] = []


_scratch = _Scratch()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread's settle() writes within is deleted at the end, unless lasting: that goes with the scratch around
    this one, if there is any. Nothing that is used later may read it."""
    _scratch.open.append([])
    try:
        yield
    finally:
        for path in _scratch.open.pop():
            delete(spark, path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query shuffled within is deleted from the executors' disks when it ends, not when the driver happens to
    collect its garbage. The setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    schema = df.schema
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", str(GROUP_BYTES)).parquet(path)
    depth = 2 if lasting else 1
    if len(_scratch.open) >= depth:
        _scratch.open[-depth].append(path)
    return spark.read.schema(schema).parquet(path)


def fresh(name: str, df: DataFrame) -> str:
    """The name, with as many underscores as keep it apart from all columns of df (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hashed_share(key: Column, salt: str, share: float) -> Column:
    """True for about this share of the keys: the same keys at each run, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def text_slices(texts: list[str], size: int, overlap: int = 0) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row, piece) of about `size` characters together; longer texts are cut into overlapping pieces."""
    rows: list[int] = []
    pieces: list[str] = []
    room = size
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - overlap, 1), size):
            piece = t[at : at + size + overlap]
            if rows and len(piece) > room:
                yield rows, pieces
                rows, pieces, room = [], [], size
            rows.append(i)
            pieces.append(piece)
            room -= len(piece)
    if rows:
        yield rows, pieces


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings, with nulls as empty texts."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
