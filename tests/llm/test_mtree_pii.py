import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe.llm import mtree, pii, queries


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("p", [mtree.Params(k=5, routes=4, sample=20, tree_rows=40, fan_out=3, page_rows=8, block_rows=3, wave_bytes=300), mtree.Params(k=20)])
def test_topk_equals_brute_force(spark, p):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * rng.uniform(0.1, 3, size=(300, 1))
    x[50:150] = x[50]  # a third are equal
    x[7] = 0
    rows = [(int(i), [float(v) for v in r], 0.0) for i, r in enumerate(x)]
    bad = [(1000, None, 0.0), (1020, [1.0, None] * 4, 0.0), (1040, [float("nan")] * 8, 0.0), (1060, [float("inf")] * 8, 0.0), (1080, [], 0.0), (1100, [1.0], 0.0), (None, [1.0] * 8, 0.0)]
    v = mtree.quantised(vectors(spark, rows + bad))
    q = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(np.float64))
    ids = np.arange(300)
    assert found(mtree.search(v, F.col("vec_id") % 20 == 0, p)) == sorted(mtree.brute_force(ids, q, ids % 20 == 0, p.k))


def test_topk_edges(spark):
    assert found(mtree.search(mtree.quantised(vectors(spark, [])), F.lit(True))) == []
    few = mtree.quantised(vectors(spark, [(0, [1.0, 0.0], 0.0), (1, [0.5, 0.0], 0.0), (1, [0.5, 0.0], 0.0), (2, [-1.0, 1.0], 0.0)]))
    assert found(mtree.search(few, F.col("vec_id") == 0)) == [(0, 1, 1, 2048), (0, 2, 1, 2048), (0, 3, 2, -4096)]
    assert found(mtree.search(few, F.col("vec_id") == 9)) == []


def test_topk_query(spark, sf):
    r = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([x.vec_id for x in r])
    q = np.floor(64 * np.array([x.embedding for x in r], np.float64))
    assert found(queries.op8_exact_topk(spark, sf)) == sorted(mtree.brute_force(ids, q, ids % 20 == 0, 20))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


CASES = ["a@b.c", "x@y", "a@b.c@d.e.f", "@a.b", "a@@b.c", "a@-.-", "1.2.3.4.5.6.7.8", "1..2.3.4.5", "999.1.1.1 1.1.1.1", "0255.0.0.00", "1.2.3", ".1.2.3.4.", "4111 1111 1111 1111", "4111-1111  1111 1111", "4111111111111111 4111111111111111", "+1 (319) 555-5132", "+1", "++12 345 678 90", "+1 (319) 555-5132 4736962573099581", "+1-2.3(4)5 6789 x", "a.b%c+d@e-f.g-h.i!", "é@é.c x@y.zé", ""]


def test_base_spans_equal_the_patterns(texts):
    import random

    rng = random.Random(9)
    cases = CASES + ["".join(rng.choice("ab1234.@+- ()\n5é") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    cases += [r.text for r in texts.select("text").collect()]
    for t in cases:
        assert pii.base_spans(t) == plain(t), t[:100]


def test_long_runs_are_linear():
    import time

    began = time.time()
    for t in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "1 " * 150_000):
        pii.base_spans(t)
        pii.graph(t, [])
    assert time.time() - began < 30


def model(texts):
    return pii.train(texts)


def test_field(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = model(docs)
    lost = "Call +1 (319) 555-5132 4111111111111111 now"  # the patterns run both numbers together and drop them
    base, added = pii.all_spans(lost, m)
    assert base == [] and ("phone", 5, 22) in added
    base, added = pii.all_spans(lost + ". Pay by 4111111111111111", m)  # the far repetition settles the doubtful one
    far = len(lost + ". Pay by ")
    assert base == [("card", far, far + 16)] and ("card", 23, 39) in added
    assert pii.all_spans("In 1999, 12 of 30 cost 4.50 each, 7 times.", m) == ([], [])
    rows = queries.op9_pii(spark, d).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        want = plain(r.text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in want) for k in pii.KINDS)
        assert set(filter(None, pii.ordered(want).split(","))) <= set(r.spans.split(","))


def test_beliefs_equal_enumeration():
    """Loopy messages are exact on a forest."""
    from itertools import product

    rng = np.random.default_rng(1)
    m = pii.Model(rng.normal(size=(pii.N_FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    g = pii.Graph([(0, 1), (2, 3), (4, 5)], np.array([1, 5, 9]), np.array([0, 2, 0]), [(0, 1)], [(1, 2)])
    q = pii.beliefs(g, m, pii.Params(rounds=50))
    unary = ((g.features[:, None] >> np.arange(pii.N_FEATURES)) & 1) @ m.unary
    unary[1, 2] += pii.Params().evidence
    want = np.zeros((3, 5))
    for s in product(range(5), repeat=3):
        w = np.exp(sum(unary[i, s[i]] for i in range(3)) + m.chain[s[0], s[1]] + m.skip[s[1], s[2]])
        for i in range(3):
            want[i, s[i]] += w
    assert np.allclose(q, want / want.sum(1, keepdims=True), atol=1e-3)


def test_skip_edges_are_linear():
    g = pii.graph(" ".join(["5551234"] * 100), [])
    assert len(g.skip) == 99 and len(g.chain) == 99


def test_mask_and_edges(docs, none, texts):
    m = model(texts)
    assert pii.mask_text("a x@y.z b", [("email", 2, 7)]) == "a [EMAIL] b"
    out = pii.mask(docs, m)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("doc_id = 2").first().text is None
    assert pii.digest(none, m).count() == 0 and pii.digest(docs, pii.train(none)).count() == docs.count()


def test_evidence_reaches_the_whole_skip_chain(texts):
    n = 300
    m = pii.Model(np.zeros((pii.N_FEATURES, 5)), np.zeros((5, 5)), 9 * np.eye(5))
    label = np.zeros(n, np.int64)
    label[0] = 3
    q = pii.beliefs(pii.Graph([(i, i + 1) for i in range(n)], np.zeros(n, np.int64), label, [], [(i, i + 1) for i in range(n - 1)]), m)
    step = np.exp(9 * np.eye(5)) / (np.exp(9) + 4)
    first = np.exp(pii.Params().evidence * (np.arange(5) == 3))
    want = first / first.sum() @ np.linalg.matrix_power(step, n - 1)
    assert np.allclose(q[-1], want, atol=1e-6) and q[-1, 3] > 0.8
    lost = "Call +1 (319) 555-5132 4111111111111111 now. "
    base, added = pii.all_spans(lost * 40 + "Pay by 4111111111111111", model(texts))
    assert base == [("card", len(lost) * 40 + 7, len(lost) * 40 + 23)]
    assert [("card", k * len(lost) + 23, k * len(lost) + 39) in added for k in range(40)] == [True] * 40


def test_topk_of_very_large_components(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-100, 100, (60, 4))
    x[:20] = rng.integers(2**29, 2**30, (20, 4))  # scores beyond 2**53
    x[20], x[21] = (2**33 + 1, 3, 0, 0), (-(2**32), 5, 1, 0)  # components beyond 32 bits, scored against small queries
    x[30:, 0] = rng.integers(-9, 9, 30)
    rows = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<long>")
    asked = [0, 7, *range(30, 60, 5)]
    got = [tuple(r) for r in mtree.search(rows, F.col("vec_id").isin(asked), mtree.Params(k=5, routes=4, sample=20, page_rows=8, block_rows=3)).collect()]
    want = []
    for i in asked:
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(x[i], x[j])), j) for j in range(60) if j != i)
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:5])]
    assert sorted(got) == sorted(want)
