"""Mixing sources to target weights: block quotas dealt to output shards by a multivariate-hypergeometric splitting tree.

A source's documents fall into 256 blocks by hash. A target of r times the source's size takes each block floor(r) times
and, for the rest, blocks in a permuted order that still fit; one that would pass the target is cut the same way into 4096
smaller ones, of which those that still fit are taken, and later blocks fill what is left until it is less than any smaller
block that was left out. The smallest left out of the cut blocks goes in at the end if that comes nearer to the target. The block quotas of all sources are split down a binary tree over the output shards, left and right
share drawn without replacement, so that each shard is a fair sample of the exact mix; a shard then draws the next
blocks of each source's permutation, disjoint from the other shards', and is shuffled on its own.

Only sums by source and block come to the driver (256 rows a source). A document's fate follows from its source and
hash, so texts are not shuffled to decide it.

Defined cases: a null text has size 0; a null source is a source of its own, after the others; a source of size 0 has
target 0 and takes nothing; an empty table gives no rows; repeated rows share their block and are taken together;
equal ids do too; a null id is allowed. Extra columns are kept by `draw`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, settle

# The weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
MOST = 3.0  # times its size that a source, and so a document, is taken


@dataclass(frozen=True)
class Params:
    seed: int = 20
    shards: int = 16
    slot_words: int = 1 << 22  # words that are shuffled together, about
    weights: tuple[float, ...] = WEIGHTS
    most: float = MOST


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets that share the sum of sizes by weight, stopping at `most` times a size; the excess is shared again."""
    total = float(sum(sizes))
    capped = [s == 0 for s in sizes]
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped) if c)
        share = sum(w for w, c in zip(weights, capped) if not c)
        targets = [most * s if c else left * w / share for s, w, c in zip(sizes, weights, capped)]
        over = [not c and t > most * s for s, t, c in zip(sizes, targets, capped)]
        if not any(over):
            return targets
        capped = [c or o for c, o in zip(capped, over)]


def _permuted(items: list[int], *key) -> list[int]:
    return sorted(items, key=lambda i: hashlib.blake2b(repr((*key, i)).encode(), digest_size=8).digest())


def split(quota: np.ndarray, lo: int, hi: int, seed: int) -> list[np.ndarray]:
    """The quotas of shards lo .. hi - 1: at each node, the left half's share is drawn without replacement."""
    if hi - lo == 1:
        return [quota]
    mid = (lo + hi) // 2
    rng = np.random.default_rng([seed, lo, hi])
    left = rng.multivariate_hypergeometric(quota, int(quota.sum()) * (mid - lo) // (hi - lo), method="marginals")
    return split(left, lo, mid, seed) + split(quota - left, mid, hi, seed)


@dataclass
class Plan:
    blocks: DataFrame  # mix_source, mix_b1, mix_shards: one shard for each time that the block is taken
    edges: DataFrame  # mix_source, mix_b1, mix_b2, mix_edge: the shard that the smaller block goes to
    sources: DataFrame  # mix_source, mix_source_size, mix_target
    words: float


def keyed(docs: DataFrame, p: Params, size=None) -> DataFrame:
    """docs with mix_size, mix_source, mix_h and the block numbers."""
    out = docs.withColumns({"mix_size": size_of(F.col("text")) if size is None else size, "mix_source": F.col("source"), "mix_h": F.xxhash64(F.lit(p.seed), F.col("doc_id"))})
    return out.withColumns({"mix_b1": F.shiftrightunsigned("mix_h", 56).cast("int"), "mix_b2": F.shiftrightunsigned("mix_h", 44).bitwiseAND(4095).cast("int")})


def plan(narrow: DataFrame, p: Params = Params()) -> Plan:
    """narrow: keyed() rows; their texts are not read."""
    spark = narrow.sparkSession
    sums: dict = {}
    least: dict = {}  # of each source and block: its smallest smaller block that has words
    small = narrow.groupBy("mix_source", "mix_b1", "mix_b2").agg(F.sum("mix_size").alias("w"))
    for s, b, w, lo in small.groupBy("mix_source", "mix_b1").agg(F.sum("w"), F.min(F.when(F.col("w") > 0, F.col("w")))).collect():
        sums.setdefault(s, {})[b] = w
        least[s, b] = math.inf if lo is None else lo
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    sizes = [sum(sums[s].values()) for s in order]
    targets = fill(sizes, [p.weights[i % len(p.weights)] for i in range(len(order))], p.most)
    draws: list[list[tuple[int, bool]]] = []  # of each source: (block, whole)
    left: list[float] = []
    later: list[list[int]] = []  # blocks that may fill the rest, the next one last
    for s, size, target in zip(order, sizes, targets):
        times = math.floor(target / size + 1e-12) if size else 0
        draws.append([(b, True) for e in range(times) for b in _permuted(list(sums[s]), p.seed, s, e)])
        left.append(target - times * size)
        later.append(_permuted(list(sums[s]), p.seed, s, "rest")[::-1] if left[-1] > 0 else [])
    cut: list[DataFrame] = []
    over: dict[int, tuple[int, int, int]] = {}  # of each source: words, block and smaller block of the smallest left out
    while True:
        at: dict = {}
        for i, s in enumerate(order):
            while later[i] and s not in at:
                b = later[i].pop()
                if sums[s][b] <= left[i]:
                    draws[i].append((b, True))
                    left[i] -= sums[s][b]
                elif i not in over or least[s, b] <= left[i]:  # what is left only shrinks, so others never fit
                    draws[i].append((b, False))
                    at[s] = (i, b)
        if not at:
            break
        got = _cut(narrow, [(s, b, left[i]) for s, (i, b) in at.items()], p)
        cut.append(got.where("fits"))
        for r in got.groupBy("mix_source", "fits").agg(F.sum("w").alias("w"), F.min(F.struct("w", "mix_b1", "mix_b2")).alias("first")).collect():
            i = at[r["mix_source"]][0]
            if r["fits"]:
                left[i] -= r["w"]
            else:
                over[i] = min(over.get(i, (math.inf, 0, 0)), tuple(r["first"]))
    extra = [(order[i], b, b2) for i, (w, b, b2) in over.items() if w - left[i] < left[i]]
    shards = split(np.array([len(d) for d in draws], np.int64), 0, p.shards, p.seed) if order else []
    taken: dict = {}
    edge = []
    next_ = [0] * len(order)
    for shard, quota in enumerate(shards):
        for i, k in enumerate(quota.tolist()):
            for b, whole in draws[i][next_[i] : next_[i] + k]:
                if whole:
                    taken.setdefault((i, b), []).append(shard)
                else:
                    edge.append((order[i], b, shard))
            next_[i] += k
    blocks = spark.createDataFrame([(order[i], b, x) for (i, b), x in taken.items()], "mix_source string, mix_b1 int, mix_shards array<int>")
    at = spark.createDataFrame(edge, "s string, b int, mix_edge int")
    edges = spark.createDataFrame(extra, "mix_source string, mix_b1 int, mix_b2 int")
    for got in cut:
        edges = edges.unionByName(got.select(*edges.columns))
    edges = edges.join(F.broadcast(at), F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_b1") == F.col("b"))).select("mix_source", "mix_b1", "mix_b2", "mix_edge")
    sources = spark.createDataFrame(list(zip(order, sizes, targets)), "mix_source string, mix_source_size long, mix_target double")
    return Plan(blocks, edges, sources, float(sum(targets)))


def _cut(narrow: DataFrame, at: list[tuple], p: Params) -> DataFrame:
    """Of each (source, block, words needed), the smaller blocks in hashed order that still fit, and the smallest that does not."""
    at_df = narrow.sparkSession.createDataFrame(at, "s string, b int, need double")
    on = F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_b1") == F.col("b"))
    small = narrow.join(F.broadcast(at_df), on).groupBy("mix_source", "mix_b1", "mix_b2", "need").agg(F.sum("mix_size").alias("w"))
    small = small.withColumn("o", F.xxhash64(F.lit(p.seed), "mix_b2"))

    def choose(t):
        rows = sorted(t.to_pylist(), key=lambda r: (r["o"], r["mix_b2"]))
        left, out, rest = rows[0]["need"], [], []
        for r in rows:
            r["fits"] = r["w"] <= left
            left -= r["w"] if r["fits"] else 0
            (out if r["fits"] else rest).append(r)
        out += sorted(rest, key=lambda r: (r["w"], r["mix_b2"]))[:1]
        return pa.Table.from_pylist(out, pa.schema([("mix_source", pa.string()), ("mix_b1", pa.int32()), ("mix_b2", pa.int32()), ("w", pa.int64()), ("fits", pa.bool_())]))

    return settle(small.groupBy("mix_source").applyInArrow(choose, "mix_source string, mix_b1 int, mix_b2 int, w long, fits boolean"))


BROADCAST_ROWS = 1_000_000  # of narrow rows, at most


def _small(df: DataFrame) -> DataFrame:
    """df, written, and broadcast if its rows are counted to be few; otherwise joins shuffle."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def decide(rows: DataFrame, x: Plan) -> DataFrame:
    """keyed() rows with mix_shards: the shards that take the row, one for each time; empty if none does.

    The plan has at most 256 blocks and 4096 smaller ones a source, so as a rule it is broadcast and texts stay in place.
    """
    same = lambda *more: F.expr(" AND ".join(["l.mix_source <=> r.mix_source", *(f"l.{c} = r.{c}" for c in more)]))
    out = rows.alias("l").join(_small(x.blocks).alias("r"), same("mix_b1"), "left").select("l.*", "r.mix_shards")
    out = out.alias("l").join(_small(x.edges).alias("r"), same("mix_b1", "mix_b2"), "left").select("l.*", "r.mix_edge")
    none = F.array().cast("array<int>")
    got = F.concat(F.coalesce("mix_shards", none), F.when(F.col("mix_edge").isNull(), none).otherwise(F.array("mix_edge")))
    return out.withColumn("mix_shards", got).drop("mix_edge")


def report(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards: one row a document, taken or not."""
    prepare(docs.sparkSession)
    narrow = settle(keyed(docs.select("doc_id", "source", "text"), p).drop("text"))
    x = plan(narrow, p)
    out = decide(narrow, x).alias("l").join(x.sources.alias("r"), F.expr("l.mix_source <=> r.mix_source"))
    return out.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_shards")).alias("taken"),
        F.array_join(F.col("mix_shards").cast("array<string>"), ",").alias("shards"),
    )


def draw(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken, dealt to shards and shuffled within each.

    A shard larger than p.slot_words is shuffled in several slots, so that no task holds a whole shard.
    """
    prepare(docs.sparkSession)
    narrow = settle(keyed(docs.select("doc_id", "source", "text"), p).drop("text"))
    x = plan(narrow, p)
    slots = max(1, math.ceil(x.words / p.shards / p.slot_words))
    # The caller's columns go by number meanwhile, so that none is taken for one of ours.
    own = [f"c{i}" for i in range(len(docs.columns))]
    numbered = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, own)], F.col("doc_id"), F.col("source"))
    rows = decide(keyed(numbered, p, F.lit(0)), x).where(F.size("mix_shards") > 0)
    rows = rows.select("*", F.posexplode("mix_shards").alias("mix_time", "mix_shard"))
    rows = rows.withColumn("mix_place", F.xxhash64(F.lit(p.seed + 1), "mix_h", "mix_time", "mix_shard"))
    rows = rows.withColumn("mix_slot", F.pmod("mix_place", F.lit(slots)).cast("int"))
    return rows.repartition(p.shards * slots, "mix_shard", "mix_slot").sortWithinPartitions("mix_shard", "mix_slot", "mix_place").select(*own).toDF(*docs.columns)
