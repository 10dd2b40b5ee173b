"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters; pairs verified once.

Two texts link when 100 * intersection >= percent * union of their shingle sets. Texts of equal sets form a class, and
classes are joined:

1. A table of counts over all texts' shingles (a fixed number of hashed cells) orders shingles, rare ones first.
2. A class's prefix is its first n - ceil(percent/100 * n) + 1 shingles in that order; linked classes share one of them.
   Only prefix shingles of two or more classes go on (counted with map-side combining), so most rows end here.
3. Classes that agree in a few minimum hashes are compared with one of their group first, and those left apart with a
   few more. Verified, these links give preliminary components, which let a large group of near copies be joined by as many links as it has members.
4. Within each shared prefix shingle, the pairs of classes from different preliminary components that pass the length
   and positional filters are kept, each once; their common prefix shingles are counted, a suffix filter bounds their overlap by counts in hashed parts; what
   is left is verified on the whole sets. Skipping pairs inside a component cannot change any component.
5. Components come from alternating stars, and every row gets the smallest doc_id of its component.

The sets that verification needs are made anew from the texts of the classes in filtered pairs, named by a Bloom filter of
fixed size, so they are never stored for all texts.

Defined cases: a null, empty or blank text has an empty set, links with nothing, and is its own component; texts of any
length are read whole; ties in the order are broken by hash; repeated rows and equal ids are rows of one class and each
get the component; a null id is allowed, and a component's id is the smallest id that is not null; an empty table gives
no rows. Extra columns are ignored by `component_ids` and kept by `keep_one`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare, scratch, settle, strings
from .components import components
from .shingles import PLACE, gathered, mix, sets, signature

PARTS = 32


@dataclass(frozen=True)
class Params:
    n: int = 5
    percent: int = 80
    order_bits: int = 21  # cells of the table of counts
    bloom_bits: int = 26  # of the filter that names the texts to read again
    bands: int = 4  # of two minimum hashes each
    rounds: int = 8  # in which a group of equal minimum hashes gets a new class to compare with


def _overlap(p: Params, a: str, b: str) -> str:
    """The least intersection of linked sets of sizes a and b: ceil(percent * (a + b) / (100 + percent))."""
    return f"({p.percent} * ({a} + {b}) + {99 + p.percent}) div {100 + p.percent}"


def _order(docs: DataFrame, p: Params) -> np.ndarray:
    """For each cell, the logarithm of its count over all texts, in eighths of a doubling."""

    def fill(out: np.ndarray, b: pa.RecordBatch) -> None:
        cells = [(s.view(np.uint64) >> np.uint64(64 - p.order_bits)).astype(np.int64) for s in sets(strings(b, "text"), p.n)]
        if cells:
            np.add.at(out, np.concatenate(cells), 1)

    counts = gathered(docs.select("text"), 1 << p.order_bits, "<i8", fill)
    return np.minimum(np.log2(np.maximum(counts, 1)) * 8, 255).astype(np.uint8)


def _base(docs: DataFrame, p: Params) -> DataFrame:
    """tag, doc_id, n, sig, common (mean logarithm of its shingles' counts), prefix (shingles, rarest first), parts (counts
    by hashed part), bands."""
    shared = docs.sparkSession.sparkContext.broadcast(_order(docs, p))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        rank = shared.value
        for b in batches:
            n, sig, common, prefix, parts, bands = [], [], [], [], [], []
            for s in sets(strings(b, "text"), p.n):
                n.append(len(s))
                if not len(s):
                    sig.append(None), common.append(0), prefix.append(s), parts.append(s), bands.append(s)
                    continue
                sig.append(signature(s))
                u = s.view(np.uint64)
                k = len(s) + 1 - (p.percent * len(s) + 99) // 100
                r = rank[(u >> np.uint64(64 - p.order_bits)).astype(np.int64)]
                common.append(int(r.sum(dtype=np.int64)) * 1000 // len(s))
                last = np.partition(r, k - 1)[k - 1]
                near = np.flatnonzero(r <= last)
                prefix.append(s[near[np.lexsort((s[near], r[near]))[:k]]])
                parts.append(np.bincount((u & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS))
                low = [int(mix(u ^ np.uint64(0xA5A5A5A5 * (i + 1))).min()) for i in range(2 * p.bands)]
                bands.append(np.array([hash((i, low[2 * i], low[2 * i + 1])) for i in range(p.bands)], np.int64))
            lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in xs])).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *xs]).astype(t))) for xs, t in ((prefix, np.int64), (parts, np.int32), (bands, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(common, pa.int64()), *lists], ["tag", "doc_id", "n", "sig", "common", "prefix", "parts", "bands"])

    rows = docs.select(F.monotonically_increasing_id().alias("tag"), "doc_id", "text")
    return settle(rows.mapInArrow(run, f"tag long, doc_id {kind}, n long, sig binary, common long, prefix array<long>, parts array<int>, bands array<long>"))


def _cells(key: np.ndarray, bits: int) -> np.ndarray:
    """Four cells of each key (uint64)."""
    return np.stack([mix(key + PLACE[i]) >> np.uint64(64 - bits) for i in range(4)], 1).astype(np.int64)


def _bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2**bits bits of one long column."""

    def fill(out: np.ndarray, b: pa.RecordBatch) -> None:
        at = _cells(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits).ravel()
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))

    return gathered(keys, 1 << (bits - 3), "u1", fill, "or")


def _in_bloom(bits_: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    at = _cells(key.view(np.uint64), bits)
    return ((bits_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def _live(reps: DataFrame, p: Params) -> DataFrame:
    """token, node, n, pos: prefix shingles of two or more classes.

    Tokens are counted with map-side combining; a Bloom filter of the shared ones, of fixed size, keeps most others from
    being shuffled again, and a join removes what it lets through.
    """
    tokens = reps.select("node", F.explode("prefix").alias("token"))
    shared = settle(tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token"))
    bits = reps.sparkSession.sparkContext.broadcast(_bloom(shared, p.bloom_bits))

    def run(batches):
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            ok = _in_bloom(bits.value, flat, p.bloom_bits) if len(flat) else np.zeros(0, bool)
            row = np.repeat(np.arange(b.num_rows), sizes)[ok]
            pos = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[ok]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(flat[ok]), b.column(0).take(at), b.column(1).take(at), pa.array(pos.astype(np.int32))], ["token", "node", "n", "pos"])

    near = reps.select("node", "n", "prefix").mapInArrow(run, "token long, node long, n long, pos int")
    return settle(near.join(shared, "token", "left_semi"))


def _head(sig: str):
    """The first eight bytes of a signature as a long."""
    return F.conv(F.hex(F.substring(sig, 1, 8)), 16, -10).cast("long").alias("head")


def _sets_of(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """sig, set of the wanted signatures, once each; texts are read again and most stop at a Bloom filter."""

    wanted = settle(wanted)
    if wanted.isEmpty():
        return docs.sparkSession.createDataFrame([], "node long, set binary")
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(wanted.select(_head("sig")), p.bloom_bits))

    def run(batches):
        bits = shared.value
        done: set[bytes] = set()
        for b in batches:
            got = [s for s in sets(strings(b, "text"), p.n) if len(s)]
            if not got:
                continue
            sigs = [signature(s) for s in got]
            hit = _in_bloom(bits, np.frombuffer(b"".join(x[:8] for x in sigs), ">i8").astype(np.int64), p.bloom_bits)
            out = []
            for h, sig, s in zip(hit, sigs, got):
                if h and sig not in done:
                    done.add(sig)
                    out.append((sig, s))
            if len(done) > 200_000:
                done.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([s.tobytes() for _, s in out], pa.binary())], ["sig", "set"])

    # The exchange by signature serves both the removal of repeated sets and the join.
    found = docs.select("text").mapInArrow(run, "sig binary, set binary").dropDuplicates(["sig"])
    return found.join(wanted.select("sig", "node"), "sig").select("node", "set")


def _fits(p: Params) -> str:
    """The suffix filter over na, ha, nb, hb: counts in hashed parts leave room for the overlap that a link needs."""
    return f"aggregate(zip_with(ha, hb, (x, y) -> least(x, y)), 0, (s, x) -> s + x) >= {_overlap(p, 'na', 'nb')}"


def _bounded(pairs: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """The pairs that pass the suffix filter."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    info = settle(reps.select("node", "n", "parts").join(nodes, "node", "left_semi"))
    a, b = (info.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parts").alias(f"h{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where(_fits(p)).select("a", "b")


def _stars(reps: DataFrame, p: Params) -> DataFrame:
    """a, b, round: in each group of equal minimum hashes, each class with the one of the most common shingles, which among
    near copies is the least altered, then with the second, and so on for p.rounds rounds; only pairs that the suffix
    filter lets through."""
    bands = reps.select("node", F.explode("bands").alias("band"))
    many = bands.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    bands = settle(bands.join(many, "band", "left_semi"))
    info = reps.select("node", "n", "common", "parts").join(bands.select("node").distinct(), "node", "left_semi")
    rows = settle(bands.join(info, "node"))
    found = reps.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("round")).where("false")
    for i in range(p.rounds):
        least = rows.groupBy("band").agg(F.count("*").alias("k"), F.max(F.struct("common", "node", "n", "parts")).alias("m")).where("k > 1").select("band", F.col("m.node").alias("a"), F.col("m.n").alias("na"), F.col("m.parts").alias("ha"))
        pairs = rows.select("band", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("common").alias("cb"), F.col("parts").alias("hb")).join(least, "band").where("a <> b")
        pairs = settle(pairs.withColumn("fits", F.expr(_fits(p))))
        if pairs.isEmpty():
            break
        found = found.union(pairs.where("fits").select("a", "b", F.lit(i)))
        rows = pairs.select("band", F.col("b").alias("node"), F.col("nb").alias("n"), F.col("cb").alias("common"), F.col("hb").alias("parts"))
    return settle(found.groupBy("a", "b").agg(F.min("round").alias("round")))


def _counted(pairs: DataFrame, rows: DataFrame, p: Params) -> DataFrame:
    """The pairs a, b, na, nb that share enough prefix shingles.

    What is shared beyond the prefixes lies behind the one whose last shingle comes first in the order, so the overlap is
    at most the prefix shingles in common and what that text has left: the positional filter, over the whole prefix.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    rows = settle(rows.select("node", "token").join(nodes, "node", "left_semi"))
    both = pairs.join(rows.withColumnRenamed("node", "a"), "a").join(rows.withColumnRenamed("node", "b"), ["b", "token"])
    rest = f"(({p.percent} * greatest(na, nb) + 99) div 100 - 1)"
    return both.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("m")).where(f"m + {rest} >= {_overlap(p, 'na', 'nb')}").select("a", "b")


def _named(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """node, sig of the classes in pairs."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    return reps.select("node", "sig").join(nodes, "node", "left_semi")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """The number of values in both of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0


def _verified(pairs: DataFrame, whole: DataFrame, p: Params) -> DataFrame:
    """The pairs a, b that link, each checked once on whole sets."""
    # Only sets that a side needs are dealt out; the joins by the same key need no further exchange.
    a, b = (whole.join(pairs.select(F.col(x).alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")

    def check(batches):
        for rows in batches:
            sets_ = [[np.frombuffer(x.as_buffer(), np.int64) for x in rows.column(i)] for i in (2, 3)]
            n = np.array([[len(x) for x in side] for side in sets_], np.int64).reshape(2, -1)
            both = np.array([_common(x, y) for x, y in zip(*sets_)], np.int64)
            ok = pa.array(100 * both >= p.percent * (n[0] + n[1] - both))
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(ok), rows.column(1).filter(ok), pa.array(both).filter(ok)], ["a", "b", "both"])

    out = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
    return out.mapInArrow(check, "a long, b long, both long")


def _representatives(base: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """One row of each class, named by its tag. Rows that a Bloom filter of the other rows' tags does not know stay where
    they are; only those that it knows are joined."""
    copies = base.select("tag", "sig").join(classes.where("k > 1"), "sig").where("tag <> node").select("tag")
    rows = base.where("n > 0").select(F.col("tag").alias("node"), "n", "sig", "common", "prefix", "parts", "bands")
    away, near = _split(rows, "node", copies, p)
    return away.unionByName(near.join(classes.select("node"), "node", "left_semi"))


def _split(rows: DataFrame, key: str, keys: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is surely not among keys (a column of longs), and those that a Bloom filter of keys knows: all
    that are, and few others."""
    bits = rows.sparkSession.sparkContext.broadcast(_bloom(keys, p.bloom_bits))
    at = rows.columns.index(key)

    def known(want: bool):
        def run(batches):
            for b in batches:
                hit = _in_bloom(bits.value, b.column(at).to_numpy(zero_copy_only=False), p.bloom_bits)
                yield b.filter(pa.array(hit == want))

        return rows.mapInArrow(run, rows.schema)

    return known(False), known(True)


def links(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): rows tag, doc_id, n, sig of docs; classes sig, node; verified links a, b between nodes.

    The links connect exactly the classes that all links together would; not every link inside a group is listed.
    """
    prepare(docs.sparkSession)
    base = _base(docs, p)
    classes = settle(base.where("n > 0").groupBy("sig").agg(F.min("tag").alias("node"), F.count("*").alias("k")))
    reps = settle(_representatives(base, classes, p))

    live = _live(reps, p)
    stars = _stars(reps, p)
    whole = settle(_sets_of(docs, _named(stars, reps), p))
    first = settle(_verified(stars.where("round = 0"), whole, p))
    rough = settle(components(first))
    # Later rounds join what the first has left apart, in groups whose first class is not near to all.
    apart = stars.where("round > 0")
    for x in "ab":
        apart = apart.join(rough.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    apart = settle(apart.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"))
    first = settle(first.union(_verified(apart, whole, p)))
    rough = components(first)
    stars = stars.where("round = 0").select("a", "b").union(apart)

    rows = settle(live.join(rough, "node", "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("comp")))
    # By shingle and component first: what lies within one component goes no further.
    crossing = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    rows = settle(rows.join(crossing, "token", "left_semi"))
    groups = settle(rows.groupBy("token", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("pos")))
    l, r = groups.alias("l"), groups.alias("r")
    # The length and positional filters, as far as a component's least and most allow.
    length = f"100 * l.most >= {p.percent} * r.least AND 100 * r.most >= {p.percent} * l.least"
    positional = f"1 + least(l.most - l.pos - 1, r.most - r.pos - 1) >= {_overlap(p, 'l.least', 'r.least')}"
    meet = l.join(r, F.expr(f"l.token = r.token AND l.comp < r.comp AND {length} AND {positional}"))
    meet = meet.select("l.token", F.col("l.comp").alias("ca"), F.col("r.comp").alias("cb"))
    a = rows.select("token", F.col("comp").alias("ca"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    b = rows.select("token", F.col("comp").alias("cb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    length = f"100 * na >= {p.percent} * nb AND 100 * nb >= {p.percent} * na"
    # On the row of a pair's first common shingle nothing before it is shared, so this bound holds there.
    positional = f"1 + least(na - pa - 1, nb - pb - 1) >= {_overlap(p, 'na', 'nb')}"
    pairs = meet.join(a, ["token", "ca"]).join(b, ["token", "cb"]).where(f"{length} AND {positional}")
    pairs = _counted(settle(pairs.select("a", "b", "na", "nb").distinct()), rows, p)
    pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pairs = settle(_bounded(pairs, reps, p).join(stars, ["a", "b"], "left_anti"))
    more = settle(_sets_of(docs, _named(pairs, reps).join(whole.select("node"), "node", "left_anti"), p))
    second = _verified(pairs, whole.union(more), p)
    return base.select("tag", "doc_id", "n", "sig"), classes, first.union(second)


def _labelled(docs: DataFrame, p: Params) -> DataFrame:
    """tag, doc_id, n, component_id of each row."""
    rows, classes, found = links(docs, p)
    label = components(found)
    named = classes.join(label, "node", "left").select("sig", F.coalesce("component", "node").alias("comp"))
    least = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    by_class = settle(named.join(least, "sig"))
    ids = by_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = by_class.select("sig", "comp").join(ids, "comp").select("sig", "component_id")
    out = rows.join(ids, "sig", "left")
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def component_ids(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a row of docs."""
    return _labelled(docs, p).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs with one row of each component: that of its smallest id (a null id only if there is no other).

    Texts without shingles stay. Repeated rows count as one component's rows, so one of them stays.
    """
    prepare(docs.sparkSession)
    tag = fresh("keep_tag", docs)
    docs = settle(docs.withColumn(tag, F.monotonically_increasing_id()))
    # The tag goes where the id was, so that rows of equal or null ids are told apart.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(tag).alias("tag"))
    with scratch(docs.sparkSession):
        found = _labelled(docs.select(order.alias("doc_id"), "text"), p)
        gone = settle(found.where("n > 0 AND doc_id <> component_id").select(F.col("doc_id.tag").alias(tag)), lasting=True)
    # Texts that surely stay are not shuffled.
    stay, rest = _split(docs, tag, gone, p)
    return stay.unionByName(rest.join(gone, tag, "left_anti")).drop(tag)
