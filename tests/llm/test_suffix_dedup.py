import hashlib
import random
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxframe.llm import common
from fluxframe.llm import suffix_dedup as S
from fluxframe.llm.suffix_dedup import Params, maximal_repeats, merge


def brute(rows, length=400, passage=280):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        cut = merge([(s, s + length) for s in range(len(b) - length + 1) if count[b[s : s + length]] > 1])
        kept, upto = b"", 0
        for x, y in cut:
            kept += b[upto:x]
            upto = y
        kept += b[upto:]
        out.append((i, len(b), len(b) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
    where = defaultdict(set)
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - passage + 1):
            where[b[s : s + passage]].add((i, t))
    shared = [sum(y - x for x, y in merge([(s, s + passage) for s in range(len(b) - passage + 1) if len(where[b[s : s + passage]]) > 1])) for _, b in data]
    return sorted(((*r, n) for r, n in zip(out, shared)), key=repr)


def run(spark, rows, p=Params()):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in S.digest(df, p).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(120)
    rows = [(i, text(rng.randint(0, 150))) for i in range(12)]
    rows += [(20 + i, text(20) + " " + shared[rng.randint(0, 60) :] + " " + text(20)) for i in range(6)]
    base = text(300)
    for i in range(8):  # near copies
        k = rng.randint(0, len(base) - 1)
        rows.append((40 + i, base[:k] + word() + base[k + 1 :]))
    rows += [(60, "line of text again\n" * 60), (61, "a" * 900), (62, "a" * 399), (63, None), (64, ""), (65, base), (65, base), (None, shared), (66, shared + shared)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("kinds", [1, 3])
def test_large_groups_are_split(spark, kinds):
    rows = corpus(3)
    assert run(spark, rows, Params(task_kinds=kinds)) == brute(rows)


def test_many_near_copies_and_many_equal_rows(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(9, base)] * 2000
    for i in range(1500):
        k, j = rng.randrange(700), rng.randrange(700)
        t = base[:k] + rng.choice("XYZ") + base[k + 1 :]
        rows.append((10 + i, t[:j] + rng.choice("UVW") + t[j + 1 :]))
    assert run(spark, rows) == brute(rows)


def test_slices_of_long_texts(spark, monkeypatch):
    data = [(b"xyz" * 100 + bytes(range(32, 127)) * 12)[:1500], b"short", bytes(range(256)) * 2, b"q" * 400]
    whole = {}
    for size in (1 << 18, 900, 150):
        monkeypatch.setattr(S, "SLICE", size)
        spans = [[] for _ in data]
        named = {}
        for row, a, n, g, anchor, c in S._parts(data, Params()):
            assert (n >= 1).all() and (anchor >= n - 1).all() and (anchor < 185).all()
            for i, x, y, z, content in zip(row.tolist(), a.tolist(), n.tolist(), g.tolist(), c.tolist()):
                spans[i].append((x, x + y))
                for w in range(x, x + y):
                    named[i, w] = z
        for i, t in enumerate(data):
            n = max(len(t) - 399, 0)
            assert sum(y - x for x, y in spans[i]) == n and merge(spans[i]) == ([(0, n)] if n else [])
        whole = whole or named
        assert named == whole


def test_empty_table(spark):
    assert run(spark, []) == []


def test_extra_columns(docs):
    got = S.digest(docs).collect()
    assert len(got) == docs.count() and {r.n_removed for r in got if r.doc_id in (4, 10)} == {75000}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=4))
def test_maximal_repeats_equal_brute_force(texts):
    length = 3
    want = {}
    subs = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + length, len(t) + 1)}
    for s in subs:
        at = [(i, k) for i, t in enumerate(texts) for k in range(len(t) - len(s) + 1) if t[k : k + len(s)] == s]
        left = {texts[i][k - 1] if k else None for i, k in at}
        right = {texts[i][k + len(s)] if k + len(s) < len(texts[i]) else None for i, k in at}
        ends = sum(k + len(s) == len(texts[i]) for i, k in at)
        begins = sum(k == 0 for i, k in at)
        if len(at) > 1 and (len(left) > 1 or begins) and (len(right) > 1 or ends):
            want[s] = sorted(at)
    got = {texts[w[0][0]][w[0][1] : w[0][1] + d]: sorted(w) for d, w in maximal_repeats(texts, length)}
    assert got == want


def test_searches_leave_only_their_spans(spark, tmp_path, monkeypatch):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    known = shuffled()
    out = S.digest(spark.createDataFrame(corpus(4), "doc_id long, text string"))
    assert len(list(tmp_path.iterdir())) == 1  # the spans that the rows are cut by
    until = time.monotonic() + 20
    while len(shuffled() - known) > 50 and time.monotonic() < until:  # deletion runs beside
        time.sleep(0.2)
    assert len(shuffled() - known) <= 50
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(corpus(4))
