"""Exact top-k search by inner product: a forest of M-trees, searched best first.

Inner products become distances by one more coordinate: with M the largest norm, x gets sqrt(M^2 - |x|^2) and a query 0,
so d(q, x)^2 = |q|^2 + M^2 - 2 q.x, and larger scores are nearer. Objects are integers, so scores are exact.

The forest's routing objects are vectors of a bounded sample; each vector goes to its nearest one, and a routing object's
vectors are dealt by hash into trees of about `tree_rows`. A tree is bulk-loaded in one task: a node's vectors are dealt to
`fan_out` routing objects among them, down to leaf pages of `page_rows`. A node stores its routing object, covering radius
and distance to its parent's; a page also each entry's distance to the page's routing object, in order. A tree is one row.

Queries are searched in waves of bounded bytes, which are broadcast; trees stay where they are, and no pair of a query and
a vector, a page or a tree is ever a row. A wave's queries form blocks of neighbours. A query's score to beat starts as its
k-th best in the sample. For each block a priority queue holds the nodes still to be visited, by their nearest possible
object. A node is passed over by the triangle inequality: from stored parent distances without computing any distance,
then by its covering radius, for the block's queries that are still live; a page's entries by their stored distances.
Bounds keep a margin for rounding; what is left is scored exactly, in whole numbers where squared norms pass 2**53. A score
beyond 64 bits among the results is an error.

Defined cases: vectors that are null, empty, of another length than most, or with a null or non-finite component take no
part; null ids neither; ties go to the smaller id; equal ids are separate candidates but one query, that of the smallest
vector, and a query never finds rows of its own id; fewer than k candidates give as many rows; many equal vectors fill many
trees; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, settle, shared_dir


@dataclass(frozen=True)
class Params:
    k: int = 20
    routes: int = 64  # routing objects of the forest
    sample: int = 2048  # vectors that give routing objects and first scores to beat
    tree_rows: int = 16384
    fan_out: int = 8
    page_rows: int = 256
    block_rows: int = 256  # queries that share a queue
    wave_bytes: int = 8 << 20  # of the queries that are broadcast together


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, in double; rows that can take part only."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _width(most: float) -> type:
    """What holds each component of a vector whose squared norm is at most `most`."""
    return np.int16 if most < 2**30 else np.int32 if most < 2**61 else np.int64


def _rounding(dim: int, most: float | np.ndarray) -> float | np.ndarray:
    """A bound on the error of a score in double, by the product of the two norms."""
    return 8 * (dim + 4) * np.finfo(float).eps * most


TREE = "t_centre binary, t_radius binary, t_parent binary, t_first binary, t_count binary, t_leaf binary, t_ids binary, t_vectors binary, t_near binary"


class Tree:
    """Nodes in breadth-first order, the children of each side by side; first and count are those of a node's children,
    or of a page's entries."""

    KINDS = (("centre", np.float64), ("radius", np.float64), ("parent", np.float64), ("first", np.int32), ("count", np.int32), ("leaf", np.bool_), ("ids", np.int64), ("vectors", None), ("near", np.float64))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def load(cls, ids: np.ndarray, x: np.ndarray, most: float, p: Params) -> Tree:
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], x[by]
        lifted = _lift(x, most)
        rng = np.random.default_rng(len(ids))
        centre, radius, parent, first, count, leaf = [], [], [], [], [], []
        entries, near = [], []
        work: list[tuple[np.ndarray, int]] = [(np.arange(len(ids)), -1)]  # members and parent of each node to come
        done = n_entries = 0
        while done < len(work):
            at, above = work[done]
            work[done] = (at[:0], above)
            done += 1
            points = lifted[at]
            c = points[((points - points.mean(0)) ** 2).sum(1).argmin()]
            d = _distances(points, c[None])[:, 0]
            centre.append(c)
            radius.append(d.max())
            parent.append(0.0 if above < 0 else np.sqrt(((c - centre[above]) ** 2).sum()))
            leaf.append(len(at) <= p.page_rows or not (points != c).any())
            if leaf[-1]:
                order = np.argsort(d, kind="stable")
                first.append(n_entries)
                count.append(len(at))
                entries.append(at[order])
                near.append(d[order])
                n_entries += len(at)
                continue
            # The farthest vector is one of the routing objects, so that there are two groups at least.
            seeds = np.unique(np.append(points[rng.choice(len(at), min(p.fan_out - 1, len(at)), replace=False)], points[d.argmax()][None], axis=0), axis=0)
            if len(seeds) < 2:
                seeds = np.stack([c, seeds[0]])
            to = _distances(points, seeds).argmin(1)
            groups = [at[to == i] for i in range(len(seeds))]
            groups = [g for g in groups if len(g)]
            if len(groups) < 2:  # alike up to rounding
                groups = np.array_split(at, 2)
            first.append(len(work))
            count.append(len(groups))
            work += [(g, done - 1) for g in groups]
        of = np.concatenate(entries)
        return cls(centre=np.array(centre), radius=np.array(radius), parent=np.array(parent), first=np.array(first, np.int32), count=np.array(count, np.int32), leaf=np.array(leaf), ids=ids[of], vectors=x[of].astype(_width(most)), near=np.concatenate(near))

    def row(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, name)).tobytes() for name, _ in self.KINDS]

    @classmethod
    def read(cls, row: list[bytes], dim: int, most: float) -> Tree:
        out = {name: np.frombuffer(data, kind or _width(most)) for (name, kind), data in zip(cls.KINDS, row)}
        out["centre"], out["vectors"] = out["centre"].reshape(-1, dim + 1), out["vectors"].reshape(-1, dim)
        return cls(**out)


def search(vectors: DataFrame, is_query: Column, p: Params = Params()) -> DataFrame:
    """vectors: vec_id, v (array of longs, all of one length). Returns query_id, rank, vec_id, score."""
    spark = prepare(vectors.sparkSession)
    rows = settle(vectors.select("vec_id", "v"))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)).alias("norm")).orderBy(F.desc("n"), "d").first()
    result = "query_id long, rank int, vec_id long, score long"
    if dims is None:
        return spark.createDataFrame([], result)
    dim, most = dims["d"], float(dims["norm"])
    rows = rows.where(F.size("v") == dim)
    order = F.xxhash64(F.lit("mtree"), "vec_id")
    sample = rows.orderBy(order, "vec_id").limit(p.sample).toArrow()
    s_ids, s_vec = sample["vec_id"].to_numpy(), _matrix(sample["v"])
    _, first = np.unique(s_vec, axis=0, return_index=True)
    first = np.sort(first)
    route_vec = _lift(s_vec[_spread(_lift(s_vec[first], most), p.routes, first)], most)
    shared = spark.sparkContext.broadcast((route_vec, most))

    def assign(batches):
        routes, most = shared.value
        for b in batches:
            at = _distances(_lift(_matrix(b.column(1)), most), routes).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32))], ["vec_id", "v", "route"])

    placed = settle(rows.mapInArrow(assign, "vec_id long, v array<long>, route int"))
    sizes = {r["route"]: r["count"] for r in placed.groupBy("route").count().collect()}
    trees = F.create_map(*[F.lit(x) for r, c in sizes.items() for x in (r, max(1, -(-c // p.tree_rows)))])
    dealt = placed.withColumn("tree", F.pmod(F.xxhash64("vec_id", "v"), trees[F.col("route")]).cast("int"))

    def build(key, t):
        names = [x.split()[0] for x in TREE.split(", ")]
        tree = Tree.load(t["vec_id"].to_numpy(), _matrix(t["v"]), shared.value[1], p)
        return pa.table([pa.array([x], pa.binary()) for x in tree.row()], names)

    forest = settle(dealt.groupBy("route", "tree").applyInArrow(build, TREE))
    asked = settle(placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "route")).alias("q")).select("vec_id", "q.v", "q.route"))
    waves = -(-asked.count() * dim * 8 // p.wave_bytes)
    if not waves:
        return spark.createDataFrame([], result)
    at = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    for wave in range(waves):
        q = asked.where(F.pmod(F.xxhash64(F.lit("wave"), "vec_id"), F.lit(waves)) == wave).orderBy("route", "vec_id").toArrow()
        if q.num_rows:
            x = _matrix(q["v"])
            beat = _first_beats(q["vec_id"].to_numpy(), x, s_ids, s_vec, most, p)
            sent = spark.sparkContext.broadcast((q["vec_id"].to_numpy(), x.astype(_width(most)), beat))
            _best_rows(forest.mapInArrow(_visitor(sent, dim, most, p), "query_id long, vec_id long, score long"), p).write.mode("append").parquet(at)
            sent.destroy()
    return spark.read.schema(result).parquet(at)


def _first_beats(ids: np.ndarray, x: np.ndarray, s_ids: np.ndarray, s_vec: np.ndarray, most: float, p: Params) -> np.ndarray:
    """Each query's k-th best score in the sample, or less than any where the sample has too few."""
    out = np.full(len(ids), -np.inf)
    for lo in range(0, len(ids), 1024):
        part = slice(lo, lo + 1024)
        scores = x[part] @ s_vec.T
        scores[ids[part, None] == s_ids[None]] = -np.inf
        if scores.shape[1] >= p.k:
            out[part] = np.partition(scores, -p.k, axis=1)[:, -p.k]
    return out - _rounding(x.shape[1], most) if most >= 2**53 else out


def _visitor(sent, dim: int, most: float, p: Params):
    """Searches a wave's blocks in each tree of a partition, with the scores to beat that its trees before have left."""

    def visit(batches):
        ids, x, beat = sent.value
        blocks = [Block(ids[i : i + p.block_rows], x[i : i + p.block_rows], beat[i : i + p.block_rows], p.k, most) for i in range(0, len(ids), p.block_rows)]
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                tree = Tree.read(row, dim, most)
                for block in blocks:
                    block.search(tree)
        for block in blocks:
            yield block.rows()

    return visit


def _best_rows(near: DataFrame, p: Params) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def reach(x: np.ndarray, beat: np.ndarray, most: float) -> np.ndarray:
    """The distance within which a score of at least `beat` lies. Squared distances are whole, so half of one is a margin
    for rounding as long as squared norms stay below 2**46; beyond, the margin grows with the distances' error."""
    slack = 8 * np.sqrt(_rounding(x.shape[1], most)) if most >= 2**46 else 0.0
    with np.errstate(invalid="ignore"):
        d2 = (x * x).sum(1) + most - 2 * beat
    return np.where(np.isfinite(beat), np.sqrt(np.maximum(d2, 0) * (1 + 1e-9) + 0.5) + slack, np.inf)


def _spread(points: np.ndarray, k: int, names: np.ndarray) -> np.ndarray:
    """Up to k of the points, each the farthest from those before it."""
    if not len(points):
        return names[:0]
    out, d = [0], _distances(points, points[:1])[:, 0]
    while len(out) < min(k, len(points)) and d.max() > 0:
        out.append(int(d.argmax()))
        d = np.minimum(d, _distances(points, points[out[-1]][None])[:, 0])
    return names[out]


def _whole_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x.astype(object) @ np.array([int(c) for c in q], object)


class Block:
    """One block's search within a task: the k best of each query so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, beat: np.ndarray, k: int, most: float):
        self.k, self.most, self.dim = k, most, x.shape[1]
        self.ids, self.x, self.beat = ids, x.astype(np.float64), beat.copy()
        self.flat = np.hstack([self.x, np.zeros((len(self.x), 1))])
        self.far = reach(self.x, self.beat, most)
        self.got_ids = [np.zeros(0, np.int64)] * len(self.ids)
        self.got = [np.zeros(0)] * len(self.ids)

    def search(self, t: Tree) -> None:
        """Visits the tree's nodes, the one with the nearest possible object for a live query first."""
        live = np.arange(len(self.ids))
        d = _distances(self.flat, t.centre[:1])[:, 0]
        queue = [(float((d - t.radius[0]).min()), 0, live, d)]
        while queue:
            _, node, live, d = heapq.heappop(queue)
            ok = d - t.radius[node] <= self.far[live]  # scores to beat may have risen since
            if not ok.any():
                continue
            live, d = live[ok], d[ok]
            lo, hi = int(t.first[node]), int(t.first[node] + t.count[node])
            if t.leaf[node]:
                self.page(t, lo, hi, live, d)
                continue
            # First bound: without a new distance, from the queries' and the children's distances to this node.
            far = self.far[live][:, None]
            maybe = np.abs(d[:, None] - t.parent[lo:hi][None]) - t.radius[lo:hi][None] <= far
            some = np.flatnonzero(maybe.any(0))
            if not len(some):
                continue
            near = _distances(self.flat[live], t.centre[lo + some])
            maybe = maybe[:, some] & (near - t.radius[lo + some][None] <= far)
            for j in np.flatnonzero(maybe.any(0)).tolist():
                own, child = maybe[:, j], lo + int(some[j])
                heapq.heappush(queue, (float((near[own, j] - t.radius[child]).min()), child, live[own], near[own, j]))

    def page(self, t: Tree, first: int, end: int, live: np.ndarray, d: np.ndarray) -> None:
        near, ids, x = t.near[first:end], t.ids[first:end], t.vectors[first:end]
        # Entries are ordered by their distance to the page's routing object; bounds cut a range of them.
        lo = np.searchsorted(near, d - self.far[live], "left")
        hi = np.searchsorted(near, d + self.far[live], "right")
        a, b = int(lo.min()), int(hi.max())
        if a >= b:
            return
        scores = self.x[live] @ x[a:b].astype(np.float64).T
        beat = self.beat[live][:, None]
        whole = self.most >= 2**53
        if whole:
            norms = [np.sqrt((y.astype(np.float64) ** 2).sum(1)) for y in (self.x[live], x[a:b])]
            beat = beat - _rounding(self.dim, norms[0][:, None] * norms[1][None])
        hits = scores >= beat
        for row in np.flatnonzero(hits.any(1)).tolist():
            q = live[row]
            at = np.flatnonzero(hits[row])
            at = at[ids[a + at] != self.ids[q]]
            if not len(at):
                continue
            all_ids = np.concatenate([self.got_ids[q], ids[a + at]])
            all_scores = np.concatenate([self.got[q], _whole_scores(self.x[q], x[a + at]) if whole else scores[row, at]])
            best = _best(all_ids, all_scores, self.k)
            self.got_ids[q], self.got[q] = all_ids[best], all_scores[best]
            if len(best) == self.k and self.got[q][-1] > self.beat[q]:
                self.beat[q] = np.nextafter(float(self.got[q][-1]), -np.inf) if whole else self.got[q][-1]
                self.far[q] = reach(self.x[q : q + 1], self.beat[q : q + 1], self.most)[0]

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.got_ids]
        none = np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([none.astype(np.int64), *self.got_ids])), pa.array(np.concatenate([none, *self.got]).astype(np.int64))],
            ["query_id", "vec_id", "score"],
        )


def brute_force(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """The same rows by comparing all; for tests."""
    out = []
    for i in np.flatnonzero(asked):
        keep = np.flatnonzero(ids != ids[i])
        scores = x[keep] @ x[i]
        for rank, j in enumerate(np.lexsort((ids[keep], -scores))[:k]):
            out.append((int(ids[i]), rank + 1, int(ids[keep][j]), int(scores[j])))
    return out
