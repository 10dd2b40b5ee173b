"""Media columns: ISO media containers, read by walking nested boxes and decoding sample tables, not payloads.

`pack` stores bytes losslessly as 8-bit PCM ('raw ') samples of one audio track; `probe` reads any box tree with
classic sample tables (stts, stsc, stsz, stco or co64, stss) and returns codec, duration and keyframe byte ranges.

Defined cases: a null or empty text is a payload of 64 zero bytes; a text of any length is one container (64-bit box
sizes and offsets beyond 4 GB); equal texts give equal containers, so repeated rows agree; an empty table gives no rows;
extra columns are ignored. A truncated or foreign file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

RATE = 8000  # 8-bit frames a second
UNIT = 64  # frames in a sample of the container
PER_CHUNK = 64  # samples in a chunk
KEY_EVERY = 16  # each so-many-th sample is marked as a sync sample

# Box types of ISO/IEC 14496-12 that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"udta"}
# The unity matrix of ISO/IEC 14496-12 headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int  # in units of timescale
    sizes: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray  # indices of sync samples

    def key_ranges(self) -> list[tuple[int, int]]:
        return [(int(self.offsets[i]), int(self.sizes[i])) for i in self.keys]


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I", len(body) + 8) + kind + body
    return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def pack(payload: bytes) -> bytes:
    """A container of the payload, whose length is a positive multiple of UNIT."""
    n, rest = divmod(len(payload), UNIT)
    if rest or not n:
        raise ValueError("the payload's length must be a positive multiple of 64")
    frames = len(payload)
    wide = frames >= 1 << 32
    word, ver = (">Q", 1) if wide else (">I", 0)
    times = lambda: struct.pack(">QQ" if wide else ">II", 0, 0)
    chunks = -(-n // PER_CHUNK)
    runs = [(1, PER_CHUNK)] if n % PER_CHUNK == 0 else [(1, n)] if chunks == 1 else [(1, PER_CHUNK), (chunks, n % PER_CHUNK)]
    entry = _box(b"raw ", bytes(6), struct.pack(">HQHHHHI", 1, 0, 1, 8, 0, 0, RATE << 16))
    keys = np.arange(1, n + 1, KEY_EVERY)

    def moov(first: int) -> bytes:
        starts = first + np.arange(chunks, dtype=np.int64) * (UNIT * PER_CHUNK)
        big = bool(starts[-1] >= 1 << 32)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", c, k, 1) for c, k in runs]),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64" if big else b"stco", struct.pack(">I", chunks), starts.astype(">u8" if big else ">u4").tobytes()),
            _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", times(), struct.pack(">I", RATE), struct.pack(word, frames), struct.pack(">HH", 0x55C4, 0), version=ver)
        hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0")
        tkhd = _full(b"tkhd", times(), struct.pack(">II", 1, 0), struct.pack(word, frames), struct.pack(">8xHHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=ver, flags=7)
        mvhd = _full(b"mvhd", times(), struct.pack(">I", RATE), struct.pack(word, frames), struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=ver)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    head = 8 if frames + 8 < 1 << 32 else 16
    size = len(ftyp) + len(moov(0)) + head
    if size + frames >= 1 << 32:  # chunk offsets may need 64 bits, which lengthens the box
        size = len(ftyp) + len(moov(1 << 32)) + head
    return ftyp + moov(size) + _box(b"mdat", payload)


def boxes(data: memoryview, at: int, end: int):
    """(type, start of body, end) of each box from at to end."""
    while at < end:
        if end - at < 8:
            raise ValueError("box header cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError("box header cut short")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if at + size < body or at + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, body, at + size
        at += size


def probe(data: bytes) -> list[Track]:
    """The tracks, from their sample tables alone."""
    view = memoryview(data)
    tracks: list[dict] = []

    def walk(at: int, end: int) -> None:
        for kind, body, stop in boxes(view, at, end):
            if kind == b"trak":
                tracks.append({})
            if kind in CONTAINERS:
                walk(body, stop)
            elif tracks and kind in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz", b"stco", b"co64", b"stss"):
                tracks[-1][kind] = (body, stop)

    walk(0, len(data))

    def table(t: dict, kind: bytes, width: int, dtype: str = ">u4") -> np.ndarray:
        body, stop = t[kind]
        (n,) = struct.unpack_from(">I", view, body + 4)
        if body + 8 + n * width * np.dtype(dtype).itemsize > stop:
            raise ValueError(f"table {kind!r} cut short")
        return np.frombuffer(view, dtype, n * width, body + 8).astype(np.int64).reshape(n, width)

    out = []
    for t in tracks:
        if not {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"} <= t.keys() or not {b"stco", b"co64"} & t.keys():
            raise ValueError("track without sample tables")
        body, _ = t[b"mdhd"]
        scale = struct.unpack_from(">I", view, body + (20 if view[body] else 12))[0]
        codec = bytes(view[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16]).decode("latin-1")
        body, stop = t[b"stsz"]
        uniform, n = struct.unpack_from(">II", view, body + 4)
        if not uniform and body + 12 + 4 * n > stop:
            raise ValueError("table b'stsz' cut short")
        sizes = np.full(n, uniform, np.int64) if uniform else np.frombuffer(view, ">u4", n, body + 12).astype(np.int64)
        starts = (table(t, b"co64", 1, ">u8") if b"co64" in t else table(t, b"stco", 1))[:, 0]
        runs = table(t, b"stsc", 3)
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(starts) + 1)))
        if per.sum() != n:
            raise ValueError("chunks and samples disagree")
        chunk = np.repeat(np.arange(len(starts)), per)
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(per) - per
        offsets = starts[chunk] + before - before[first[chunk]]
        if n and (offsets + sizes).max() > len(data):
            raise ValueError("a sample lies beyond the file")
        stts = table(t, b"stts", 2)
        keys = table(t, b"stss", 1)[:, 0] - 1 if b"stss" in t else np.arange(n)
        out.append(Track(codec, scale, int((stts[:, 0] * stts[:, 1]).sum()), sizes, offsets, keys))
    return out


def read(data: bytes, t: Track) -> bytes:
    """The samples' bytes, in order; neighbouring samples are cut out together."""
    if not len(t.sizes):
        return b""
    cut = np.flatnonzero(t.offsets[1:] != t.offsets[:-1] + t.sizes[:-1]) + 1
    first = np.append(0, cut)
    last = np.append(cut, len(t.sizes)) - 1
    return b"".join(data[a:b] for a, b in zip(t.offsets[first].tolist(), (t.offsets[last] + t.sizes[last]).tolist()))


def describe(text: str | None) -> tuple:
    """Stores one text, reads it back, and returns the digest columns."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    media = pack(pad(raw))
    track = probe(media)[0]
    back = read(media, track)
    keys = track.key_ranges()
    feature = f"{track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, [{"offset": x, "size": y} for x, y in keys]


RANGES = "array<struct<offset:long,size:long>>"
SCHEMA = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes {RANGES}"


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: what was stored, what came back, and all keyframe byte ranges."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = zip(*[describe(t.as_py()) for t in b.column(1)]) if b.num_rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(rows, kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "keyframes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def media_columns(df: DataFrame, column: str, key: str) -> DataFrame:
    """For a binary column of containers: key, track number, codec, seconds, and keyframe byte ranges.

    A null value gives no rows; a damaged file gives one row with an error text.
    """
    prepare(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, data in enumerate(b.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    found = [(n, t.codec, t.duration / max(t.timescale, 1), [{"offset": x, "size": y} for x, y in t.key_ranges()], None) for n, t in enumerate(probe(bytes(data)))]
                except (ValueError, struct.error) as e:
                    found = [(None, None, None, None, str(e))]
                at += [i] * len(found)
                rows += found
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int32(), pa.string(), pa.float64(), ranges, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], ["key", "track", "codec", "seconds", "keyframes", "error"])

    out = df.selectExpr(f"`{key}` AS key", f"`{column}` AS data").mapInArrow(run, f"key {kind}, track int, codec string, seconds double, keyframes {RANGES}, error string")
    return out.withColumnRenamed("key", key)
