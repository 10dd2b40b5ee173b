"""Suffix-array de-duplication: common-prefix interval trees over enhanced suffix arrays, dealt out by content.

A byte goes if it is covered by a string of `length` bytes (400) that also starts anywhere else in the corpus. Each such
string (window) is assigned to its least 32-gram by hash, the leftmost of equals, so equal windows meet wherever they
stand. Neighbouring windows with the same least 32-gram form a segment of text. It is cut in two by where the windows lie
around the 32-gram, so that all windows of a part also share about half their bytes, whose hash is the part's group.

1. Parts of groups that occur once go: nothing of them repeats. This is one count with map-side combining.
2. Equal contents are pre-aggregated: a content that occurs twice is a maximal repeat by itself, and is sent once.
3. Groups of different contents have their bytes read again (named by a Bloom filter of fixed size), each content once.
   A group of more than `task_kinds` contents is split: its windows, by where they lie around the 32-gram, fall into
   quarters that share more bytes and so form finer groups of shorter contents, of which equal ones are joined again. This
   goes on until each piece fits a task, down to single windows at most, so no group is too large and none is left out.
4. In each group, the suffixes that start a window form a suffix array, by prefix doubling over the windows' names, with
   the common prefixes of neighbours. (Windows are named by 128-bit hashes. Suffixes of different windows never share
   `length` bytes, so the order among names does not matter.) A stack scan builds the common-prefix interval tree; an
   interval whose occurrences are preceded by different bytes is a maximal repeat, with all its occurrences.
5. The repeats' spans are joined back to the occurrences, merged within each document, and cut out.

Shorter passages that documents share are found in the same way with `passage` bytes (280, about 50 words) and reported
as `n_shared`, without being cut out. Only documents with `length` bytes of passages in a row can hold a longer repeat, so
the search for those reads no others.

Defined cases: a null text is empty; texts under 400 bytes lose nothing; texts of any length are read whole, in slices;
each row is a document of its own, so repeated rows (and all exact copies) of 400 bytes or more go wholly; ties in the
hash go to the left; an empty table gives no rows; null ids are allowed; extra columns are ignored. Rows of equal id and
text count as one document in `n_shared`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, scratch, settle, strings
from .shingles import BYTE, gathered, mix

GRAM = 32
SLICE = 1 << 16  # bytes that are placed together
PLACE_BITS = 21
_rng = np.random.default_rng(400)
LEVEL = _rng.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CONTEXT = _rng.integers(1, 1 << 62, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NAME = _rng.integers(1, 1 << 62, (2, 32), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTES = BYTE.copy()
BYTES[BYTES == 0] = _rng.integers(1, 1 << 62, int((BYTES == 0).sum()), dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Params:
    length: int = 400
    passage: int = 280
    task_kinds: int = 128  # different contents of a group that are sorted together; larger groups are split
    bloom_bits: int = 25


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes whose high bits depend on all bits of h, which are hashes by multiplication; cheaper than mix."""
    out = h >> np.uint64(32)
    out ^= h
    out *= np.uint64(0x9FB21C651E98DF25)
    return out


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(n, base, np.uint64)))
    return _powers[base]


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Groups of (text, place in it) and pieces of at least `length` bytes, of about SLICE bytes together. Longer texts
    are cut into pieces that overlap, so that each window is in one piece."""
    at, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        for x in range(0, len(t) - length + 1, SLICE):
            piece = t if len(t) < SLICE + length else t[x : x + SLICE + length - 1]
            if size and size + len(piece) > SLICE:
                yield at, pieces
                at, pieces, size = [], [], 0
            at.append((i, x))
            pieces.append(piece)
            size += len(piece)
    if size:
        yield at, pieces


def _parts(texts: list[bytes], p: Params):
    """(text, begin of first window, windows, group, anchor, content) of each part of the texts, as arrays.

    group names the bytes that all windows of the part share; anchor is where these begin, from the part's begin; content
    names all of the part's bytes.
    """
    side = p.length // 2 - GRAM // 2  # 184 of 400: windows that begin so far before the 32-gram, or nearer
    for places, pieces in _blocks(texts, p.length):
        b = np.frombuffer(b"".join(pieces), np.uint8)
        values = BYTES.take(b)
        h, size, eights = values, 1, None
        for level in range(5):
            h = h[:-size] * LEVEL[level] + h[size:]
            size *= 2
            if size == 8:
                eights = h
        least = _spread(h) & np.uint64(-1 << PLACE_BITS & (1 << 64) - 1)
        least |= np.arange(len(least), dtype=np.uint64)
        # The least of each window's keys, by doubling; arrays of a slice stay in the processor's cache.
        w, size = p.length - GRAM + 1, 1
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[: size - w], least[w - size :])
        least &= np.uint64((1 << PLACE_BITS) - 1)
        least = least.view(np.int64)
        sizes = np.array([len(x) for x in pieces])
        starts = np.cumsum(sizes) - sizes
        for end in (starts + sizes).tolist():  # windows that leave their piece
            least[end - p.length + 1 : end] = -1
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        first, last = np.append(0, change), np.append(change, len(least)) - 1
        gram = least[first]
        first, last, gram = (x[gram >= 0] for x in (first, last, gram))
        cut = gram - side
        begin = np.concatenate([first, np.maximum(first, cut + 1)])
        end = np.concatenate([np.minimum(last, cut), last])
        shared = np.concatenate([cut, gram])
        kind = np.repeat(np.array([1, 2], np.uint64), len(first))
        ok = begin <= end
        begin, end, shared, kind = begin[ok], end[ok], shared[ok], kind[ok]
        group = kind.copy()
        for k in range((side + GRAM) // 8):
            group += eights[shared + 8 * k] * CONTEXT[k]
        sums = np.append(np.uint64(0), np.cumsum(values * _power(BASE, SLICE + p.length)[: len(b)]))
        stop = end + p.length
        content = (sums[stop] - sums[begin]) * _power(pow(BASE, -1, 1 << 64), SLICE + p.length)[begin]
        content = mix(content + (stop - begin).astype(np.uint64) * CONTEXT[-1])
        piece = np.searchsorted(starts, begin, "right") - 1
        text, moved = np.array(places).T
        yield text[piece], begin - starts[piece] + moved[piece], end - begin + 1, mix(group).view(np.int64), shared - begin, content.view(np.int64)


def _bytes(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: rows of equal id and key are equal."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def _scan_parts(keyed: DataFrame, p: Params) -> DataFrame:
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, keys = b.column(0), b.column(1)
            for row, begin, n, g, _, c in _parts(_bytes(strings(b, "text")), p):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), pa.array(g), pa.array(c), pa.array(begin), pa.array(n.astype(np.int32))], ["doc_id", "key", "g", "c", "begin", "windows"])

    return keyed.mapInArrow(run, f"doc_id {kind}, key long, g long, c long, begin long, windows int")


def _cells(g: np.ndarray, bits: int) -> np.ndarray:
    u = g.view(np.uint64)
    return np.stack([mix(u + CONTEXT[i]) >> np.uint64(64 - bits) for i in range(4)], 1).astype(np.int64)


def _bloom(keys: DataFrame, bits: int):
    """A broadcast Bloom filter of a column of longs, of fixed size."""

    def fill(out: np.ndarray, b: pa.RecordBatch) -> None:
        at = _cells(b.column(0).to_numpy(zero_copy_only=False), bits).ravel()
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))

    return keys.sparkSession.sparkContext.broadcast(gathered(keys, 1 << (bits - 3), "u1", fill, "or"))


def _known(filter_: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = _cells(keys, bits)
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def _read_segments(keyed: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """g, c, anchor, data and wanted's other columns of the wanted (g, c), once each.

    Each content is read from the row of its lowest key, so only the rows that are lowest of any content are hashed again.
    """
    shared, lowest = (_bloom(wanted.select(x), p.bloom_bits) for x in ("g", "low"))

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            b = b.filter(pa.array(_known(lowest.value, b.column(0).to_numpy(zero_copy_only=False), p.bloom_bits)))
            texts = _bytes(strings(b, "text"))
            for row, begin, n, g, anchor, c in _parts(texts, p):
                hit = np.flatnonzero(_known(shared.value, g, p.bloom_bits))
                out = []
                for k, i, x, y, name, a in zip(hit.tolist(), row[hit].tolist(), begin[hit].tolist(), (begin + n + p.length - 1)[hit].tolist(), zip(g[hit].tolist(), c[hit].tolist()), anchor[hit].tolist()):
                    if name not in seen:
                        seen.add(name)
                        out.append((*name, a, texts[i][x:y]))
                if len(seen) > 200_000:
                    seen.clear()
                for i in range(0, len(out), 4096):
                    cols = list(zip(*out[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["g", "c", "anchor", "data"])

    found = keyed.select("key", "text").mapInArrow(run, "g long, c long, anchor int, data binary")
    return found.join(wanted, ["g", "c"]).dropDuplicates(["g", "c"])


@dataclass
class SuffixArray:
    place: np.ndarray  # of each window in the joined texts, in text order
    left: np.ndarray  # windows from it on to its text's last
    order: np.ndarray  # numbers of windows, sorted
    lcp: np.ndarray  # bytes that a sorted window's suffix shares with the one before; 0 if under `length`


def _names(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the `length` bytes from each place on: doubled, then put together from powers of two."""
    out = []
    for factors in NAME:
        h, size, level = BYTES[b], 1, 0
        total, done, rest = np.zeros(max(len(b) - length + 1, 0), np.uint64), 0, length
        while rest:
            if rest & 1:  # the piece of `size` bytes behind those put together so far
                total += h[done : done + len(total)] * factors[16 + level]
                done += size
            rest >>= 1
            if rest:
                h = mix(h[:-size] * factors[level] + h[size:])
                size, level = size * 2, level + 1
        out.append(mix(total))
    return out[0], out[1]


def suffix_array(texts: list[bytes], length: int) -> SuffixArray:
    """The suffixes of at least `length` bytes, by prefix doubling over the names of their windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    n = int(windows.sum())
    number = np.arange(n)
    place = number + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    left = np.repeat(np.cumsum(windows), windows) - number
    if not n:
        return SuffixArray(place, left, number, number)
    one, two = (h[place] for h in _names(np.frombuffer(b"".join(texts), np.uint8), length))
    order = np.lexsort((two, one))
    new = np.append(True, (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]))
    rank = np.zeros(n, np.int64)  # 1 + the place in the order of the first suffix that is equal so far
    rank[order] = np.maximum.accumulate(np.where(new, number, 0)) + 1
    ranks, size = [rank], 1
    while size < int(windows.max()):
        tied = np.bincount(rank, minlength=n + 2)[rank] > 1
        slots = np.flatnonzero(tied[order])
        if not len(slots):
            break
        own = order[slots]
        after = np.where(left[own] > size, rank[np.minimum(own + size, n - 1)], 0)
        by = np.lexsort((after, rank[own]))
        own, after, before = own[by], after[by], rank[own[by]]
        order[slots] = own
        new = np.append(True, (before[1:] != before[:-1]) | (after[1:] != after[:-1]))
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        ranks.append(rank)
        size *= 2
    x, y = order[:-1], order[1:]
    same = np.zeros(max(n - 1, 0), np.int64)
    near = np.flatnonzero(ranks[0][x] == ranks[0][y])
    x, y, l = x[near], y[near], same[near]
    for k in range(len(ranks) - 1, -1, -1):
        i, j = np.minimum(x + l, n - 1), np.minimum(y + l, n - 1)
        l = l + ((left[x] > l) & (left[y] > l) & (ranks[k][i] == ranks[k][j])) * (1 << k)
    same[near] = length - 1 + np.minimum(np.minimum(l, left[x]), left[y])
    return SuffixArray(place, left, order, np.append(0, same))


def intervals(lcp: list[int], before: list[int], low: list[int], high: list[int]) -> Iterator[tuple[int, int, int, bool]]:
    """(depth, first rank, end, whether `low` and `high` differ) of each maximal repeat.

    A stack scan of the common prefixes opens and closes the intervals of the tree. An interval is reported if its
    occurrences are preceded by different bytes, or one by none (-1); it cannot be extended to the right either, since
    the next interval inside of it is deeper. Ranks without a common prefix open nothing.
    """
    stack: list[list[int]] = []  # depth, first rank, byte before all of its occurrences or -1, least low, most high
    n = len(lcp)
    for r in range(1, n + 1):
        depth = lcp[r] if r < n else 0
        if not depth and not stack:
            continue
        begin, left, lo, hi = r - 1, before[r - 1], low[r - 1], high[r - 1]
        top = stack[-1] if stack else None
        if top:  # the suffix before belongs to the deepest open interval
            top[2] = top[2] if top[2] == left else -1
            top[3], top[4] = min(top[3], lo), max(top[4], hi)
        while stack and stack[-1][0] > depth:
            d, begin, left, lo, hi = stack.pop()
            if left == -1:
                yield d, begin, r, lo != hi
            if stack and stack[-1][0] >= depth:
                top = stack[-1]
                top[2] = top[2] if top[2] == left else -1
                top[3], top[4] = min(top[3], lo), max(top[4], hi)
        if depth and (not stack or stack[-1][0] < depth):
            stack.append([depth, begin, left, lo, hi])


def _tree(texts: list[bytes], low: np.ndarray, high: np.ndarray, length: int):
    """The suffix array, and its intervals over texts whose documents have keys from low to high."""
    sa = suffix_array(texts, length)
    text = np.repeat(np.arange(len(texts)), np.maximum(np.array([len(t) for t in texts], np.int64) - length + 1, 0))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
    before = np.where(begins, -1, joined[sa.place - 1].astype(np.int64)) if len(text) else np.zeros(0, np.int64)
    of = text[sa.order]
    return sa, text, intervals(sa.lcp.tolist(), before[sa.order].tolist(), low[of].tolist(), high[of].tolist())


def maximal_repeats(texts: list[bytes], length: int):
    """(depth, [(text, begin), ...]) of each maximal repeat of at least `length` bytes among the texts."""
    own = np.arange(len(texts))
    sa, text, found = _tree(texts, own, own, length)
    starts = np.cumsum([0, *map(len, texts)])
    for depth, lo, hi, _ in found:
        at = sa.order[lo:hi]
        yield depth, list(zip(text[at].tolist(), (sa.place[at] - starts[text[at]]).tolist()))


def covered(texts: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(whether shared, text, begin, end) of the merged spans that maximal repeats cover: of all of them, and of those that
    stand in different documents."""
    sa, text, found = _tree(texts, low, high, length)
    reach = np.zeros((2, len(text)), np.int64)
    for depth, lo, hi, shared in found:
        at = sa.order[lo:hi]
        reach[0, at] = np.maximum(reach[0, at], depth)
        if shared:
            reach[1, at] = np.maximum(reach[1, at], depth)
    starts = np.cumsum([0, *map(len, texts)])
    for k in (0, 1):
        at = np.flatnonzero(reach[k])
        if not len(at):
            continue
        begin, of = sa.place[at], text[at]
        upto = np.maximum.accumulate(begin + reach[k, at])
        new = np.append(True, (begin[1:] > upto[:-1]) | (of[1:] != of[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        yield bool(k), of[first], begin[first] - starts[of[first]], upto[last] - starts[of[first]]


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


TOGETHER = 1 << 19  # bytes of groups that are sorted together, about
FOUND = "g long, c long, a int, b int, shared boolean"


def _trees(pieces: DataFrame, p: Params) -> DataFrame:
    """FOUND of pieces (g, c, k, low, high, data), whose groups fit a task: what repeats between a group's contents or
    within them. Whole groups are sorted together with others; windows of different groups are never equal."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def done():
            if not held:
                return
            g, c, k, low, high, data = zip(*held)
            g, c, k = np.array(g), np.array(c), np.array(k)
            low, high = np.array(low), np.array(high)
            held.clear()
            for shared, of, a, b in covered(list(data), low, high, p.length):
                # A content that occurs twice, or in two documents, is reported as a whole already.
                ok = (low[of] == high[of]) if shared else (k[of] == 1)
                of, a, b = of[ok], a[ok], b[ok]
                yield pa.RecordBatch.from_arrays([pa.array(g[of]), pa.array(c[of]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.full(len(of), shared))], ["g", "c", "a", "b", "shared"])

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if held and held[-1][0] != row[0] and size > TOGETHER:
                    yield from done()
                    size = 0
                held.append(row)
                size += len(row[5])
        yield from done()

    return pieces.select("g", "c", "k", "low", "high", "data").repartition(F.col("g")).sortWithinPartitions("g", "c").mapInArrow(run, FOUND)


def _whole(contents: DataFrame, p: Params) -> DataFrame:
    """FOUND of contents (g, c, k, low, high, windows) that repeat as a whole."""
    rows = contents.where("k > 1").select("g", "c", F.lit(0).alias("a"), (F.col("windows") + p.length - 1).cast("int").alias("b"), F.explode(F.when(F.expr("low <> high"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("shared"))
    return rows


PIECE = "g long, c long, k long, low long, high long, anchor int, least int, span int, data binary"


def _quarters(pieces: DataFrame, p: Params) -> DataFrame:
    """The quarters of each piece, by the distance of its windows' begins to the anchor, with the piece (pg, pc) and where
    the quarter begins in it (shift)."""

    def run(batches):
        for b in batches:
            out = []
            for g, c, k, low, high, anchor, least, span, data in zip(*[b.column(i).to_pylist() for i in range(9)]):
                n, size = len(data) - p.length + 1, max(span // 4, 1)
                for x in range(least, least + span, size):
                    # Windows at distances x to x + size - 1, as far as there are any, and the bytes that all such share.
                    i0, i1 = max(0, anchor - x - size + 1), min(n - 1, anchor - x)
                    if i0 > i1:
                        continue
                    part = data[i0 : i1 + p.length]
                    h = xxhash.xxh3_64(data[anchor - x : anchor - x - size + 1 + p.length], seed=g & (1 << 64) - 1)
                    h.update(x.to_bytes(4, "little"))
                    out.append((h.intdigest() - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63), k, low, high, anchor - i0, x, size, part, g, c, i0))
            if out:
                kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["g", "c", "k", "low", "high", "anchor", "least", "span", "data", "pg", "pc", "shift"])

    names = [x.split()[0] for x in PIECE.split(", ")]
    return pieces.select(*names).mapInArrow(run, f"{PIECE}, pg long, pc long, shift int")


def _found(pieces: DataFrame, p: Params) -> DataFrame:
    """FOUND of pieces with the size (kinds) of their groups, however large."""
    out = _trees(pieces.where(F.col("kinds") <= p.task_kinds), p)
    large = pieces.where(F.col("kinds") > p.task_kinds)
    if large.isEmpty():
        return out
    quarters = settle(_quarters(large, p))
    same = [F.first(x).alias(x) for x in ("anchor", "least", "span", "data")]
    contents = settle(quarters.groupBy("g", "c").agg(F.sum("k").alias("k"), F.min("low").alias("low"), F.max("high").alias("high"), *same))
    sizes = contents.groupBy("g").agg(F.count("*").alias("kinds"), F.bool_or(F.expr("low = high")).alias("some")).where("kinds > 1 AND some")
    smaller = settle(contents.join(sizes.select("g", "kinds"), "g"))
    windows = contents.withColumn("windows", F.octet_length("data") - (p.length - 1))
    inside = _whole(windows, p).union(_found(smaller, p))
    back = quarters.select("pg", "pc", "g", "c", "shift").join(inside, ["g", "c"])
    return out.union(back.select(F.col("pg").alias("g"), F.col("pc").alias("c"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"), "shared").distinct())


def repeated(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, key, spans (a set of begin, end in bytes, shared) of the rows that hold repeats of p.length bytes; one row
    for equal rows. Spans with `shared` are of repeats that another document holds too; the others are of all repeats."""
    prepare(docs.sparkSession)
    return _repeated(_keyed(docs), p)


def _repeated(keyed: DataFrame, p: Params) -> DataFrame:
    with scratch(keyed.sparkSession):
        parts = settle(_scan_parts(keyed, p))
        twice = settle(parts.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"))
        hits = settle(parts.join(twice, "g", "left_semi"), lasting=True)
    kinds = settle(hits.groupBy("g", "c").agg(F.count("*").alias("k"), F.min("windows").alias("windows"), F.min("key").alias("low"), F.max("key").alias("high")))
    open_ = kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.bool_or(F.expr("low = high")).alias("some")).where("kinds > 1 AND some").select("g", "kinds")
    wanted = settle(kinds.join(settle(open_), "g").select("g", "c", "k", "low", "high", "kinds"))
    span = 1 << (p.length // 2).bit_length()
    pieces = settle(_read_segments(keyed, wanted, p).withColumns({"least": F.lit(0), "span": F.lit(span)}))
    found = settle(_whole(kinds, p).union(_found(pieces, p)))
    spans = hits.select("doc_id", "key", "g", "c", "begin").join(found, ["g", "c"])
    spans = spans.select("doc_id", "key", F.struct((F.col("a") + F.col("begin")).alias("a"), (F.col("b") + F.col("begin")).alias("b"), "shared").alias("span"))
    return spans.groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans"))


def _merged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the merged spans of a column of span lists, null lists left out."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    flat = lists.flatten()
    a, b = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) + (row << 40) for x in ("a", "b"))
    order = np.argsort(a, kind="stable")
    a, upto, row = a[order], np.maximum.accumulate(b[order]), row[order]
    if not len(a):
        return row, a, b
    first = np.append(0, np.flatnonzero(a[1:] > upto[:-1]) + 1)
    last = np.append(first[1:], len(a)) - 1
    row = row[first]
    return row, a[first] - (row << 40), upto[last] - (row << 40)


def _candidates(keyed: DataFrame, passages: DataFrame, p: Params) -> DataFrame:
    """The rows of keyed that hold p.length bytes of passages in a row, and the few more that a Bloom filter lets through.
    All bytes of a longer repeat are covered by passages that repeat, so no other row holds any."""

    def long(batches):
        for b in batches:
            row, x, y = _merged(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.unique(row[y - x >= p.length])))], ["key"])

    all_ = passages.select("key", F.filter("spans", lambda s: ~s["shared"]).alias("spans"))
    shared = _bloom(all_.mapInArrow(long, "key long"), p.bloom_bits)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_known(shared.value, b.column(1).to_numpy(zero_copy_only=False), p.bloom_bits)))

    return keyed.mapInArrow(run, keyed.schema)


def digest(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared (bytes in passages that another document holds too): one
    row a row of docs."""
    prepare(docs.sparkSession)
    keyed = _keyed(docs)
    spark = docs.sparkSession
    with scratch(spark):  # each search leaves its spans only
        with scratch(spark):
            passages = settle(_repeated(keyed, replace(p, length=p.passage)), lasting=True)
        longer = _repeated(_candidates(keyed, passages, p), p)
        # What is to be cut out, and passages in other documents.
        cut = passages.select("doc_id", "key", F.filter("spans", lambda s: s["shared"]).alias("passages")).join(longer.withColumnsRenamed({"doc_id": "id2", "key": "key2"}), F.expr("key = key2 AND doc_id <=> id2"), "left")
        cut = settle(cut.select(F.col("doc_id").alias("id2"), F.col("key").alias("key2"), "passages", F.filter("spans", lambda s: ~s["shared"]).alias("spans")), lasting=True)
    rows = keyed.join(cut, F.expr("key = key2 AND doc_id <=> id2"), "left").select("doc_id", "text", "spans", "passages")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data = _bytes(strings(b, "text"))
            row, x, y = _merged(b.column(2))
            n_spans = np.bincount(row, minlength=len(data))
            removed, shared = (np.bincount(i, z - w, len(data)).astype(np.int64) for i, w, z in ((row, x, y), _merged(b.column(3))))
            cut, at, kept = list(zip(x.tolist(), y.tolist())), 0, []
            for t, n in zip(data, n_spans.tolist()):
                sha, upto = hashlib.sha256(), 0
                for x, y in cut[at : at + n]:
                    sha.update(t[upto:x])
                    upto = y
                sha.update(t[upto:])
                kept.append(sha.hexdigest())
                at += n
            cols = [pa.array([len(t) for t in data], pa.int64()), pa.array(removed), pa.array(n_spans), pa.array(kept, pa.string()), pa.array(shared)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")
