"""Words and word shingles of whole texts as 64-bit hashes, a batch at a time in numpy.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased. A text's set holds the hashes of its
distinct n-word shingles; with fewer than n words, the whole sequence is one; without words it is empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 18  # bytes that are hashed together
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[[32, 9, 10, 11, 12, 13]] = 0
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(2 * n, BASE)))
    return _powers


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where each begins."""
    b = np.frombuffer(data, np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    begins = np.flatnonzero(~gap & np.append(True, gap[:-1])) if len(b) else np.zeros(0, np.int64)
    if not len(begins):
        return np.zeros(0, np.uint64), begins
    span = np.diff(np.append(begins, len(b)))
    offset = np.arange(begins[0], len(b)) - np.repeat(begins, span)
    return mix(np.add.reduceat(BYTE[b[begins[0] :]] * _power(int(span.max()) + 1)[offset], begins - begins[0])), begins


def words(texts: list[str]) -> Iterator[np.ndarray]:
    """The hashed words of each text; long texts are hashed in pieces cut at gaps between words."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if held:
            h, begins = _hash_words(b" ".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            yield from np.split(h, np.searchsorted(begins, ends[:-1]))
            held.clear()

    for t in texts:
        data = t.encode("utf-8", "surrogatepass").lower()
        if size + len(data) > PIECE:
            yield from flush()
            size = 0
        if len(data) <= PIECE:
            held.append(data)
            size += len(data)
            continue
        parts, at = [], 0
        while at < len(data):
            end = at + PIECE
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            parts.append(_hash_words(data[at:end])[0])
            at = end
        yield np.concatenate(parts)
    yield from flush()


def sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes as sorted int64."""
    for w in words(texts):
        if len(w) >= n:
            h = w[: len(w) - n + 1] * PLACE[0]
            for k in range(1, n):
                h = h + w[k : len(w) - n + 1 + k] * PLACE[k]
            yield np.unique(mix(h).view(np.int64))
        elif len(w):
            yield mix((w * PLACE[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w))).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def signature(s: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def gathered(df: DataFrame, cells: int, dtype: str, fill: Callable[[np.ndarray, pa.RecordBatch], None], how: str = "add") -> np.ndarray:
    """An array of a fixed number of cells, filled from all batches of df and added (or or-ed) over the partitions.

    Each partition sends its array in compressed slices; a slice's parts are combined as a stream, in groups of partitions
    first if there are more shuffle partitions than slices, and only the combined array, whose size is fixed, comes to the
    driver.
    """
    slices = min(16, max(1, cells >> 12))
    step = -(-cells // slices)
    combine = np.add if how == "add" else np.bitwise_or

    def part(batches):
        out = np.zeros(cells, dtype)
        for b in batches:
            fill(out, b)
        at = [i for i in range(slices) if out[i * step : (i + 1) * step].any()]
        for i in at:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(out[i * step : (i + 1) * step].tobytes(), 1)], pa.binary())], ["slice", "data"])

    def whole(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(data), dtype)
                sums[i] = combine(sums[i], x) if i in sums else x
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["slice", "data"])

    schema = "slice int, data binary"
    out = np.zeros(slices * step, dtype)
    parts = df.mapInArrow(part, schema)
    fan = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // slices
    if fan > 1:
        parts = parts.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(fan))).repartition(slices * fan, "slice", "group").select("slice", "data").mapInArrow(whole, schema)
    for i, data in parts.repartition(slices, F.col("slice")).mapInArrow(whole, schema).collect():
        x = np.frombuffer(zlib.decompress(data), dtype)
        out[i * step : i * step + len(x)] = x
    return out[:cells]
