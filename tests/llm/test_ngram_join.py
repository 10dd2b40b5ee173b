import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fluxframe.llm import ngram_join as N
from fluxframe.llm.components import components
from fluxframe.llm.shingles import sets

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(t, n):
    w = WORD.findall((t or "").encode().lower().decode())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    s = [(i, shingles(t, n)) for i, t in rows]
    up = list(range(len(s)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(s)), 2):
        both = len(s[a][1] & s[b][1])
        if both and 100 * both >= percent * (len(s[a][1]) + len(s[b][1]) - both):
            up[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(s):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(x), min(least[find(k)], default=None)) for k, (i, x) in enumerate(s)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for g in range(6):
        base = text(rng.randint(3, 120))
        for _ in range(rng.randint(2, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w) if rng.random() < 0.7 else "\n".join(w).upper())
    boiler = " ".join(text(30))
    rows += [boiler + " " + " ".join(text(rng.randint(0, 4))) for _ in range(10)]
    rows += ["", " ", None, "one", "ONE", "one two", "one two three", "two one"]
    out = [(i, t) for i, t in enumerate(rows)]
    rng.shuffle(out)
    return out + [out[0], out[0], (None, out[1][1])]


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 90), (2, 5, 80), (3, 3, 60), (4, 2, 100)])
def test_components_equal_brute_force(spark, seed, n, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in N.component_ids(df, N.Params(n=n, percent=percent, order_bits=12, bloom_bits=16)).collect()), key=repr)
    assert got == brute(rows, n, percent)


def test_without_bands_the_exact_path_finds_all(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in N.component_ids(df, N.Params(n=3, percent=80, order_bits=8, bloom_bits=14, bands=1)).collect()), key=repr)
    assert got == brute(rows, 3, 80)


def test_keep_one(spark):
    rows = corpus(6)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, tag string, node string")
    kept = N.keep_one(df, N.Params(n=5, percent=80))
    assert kept.columns == df.columns
    want = brute(rows, 5, 80)
    blank = sum(1 for _, n, _ in want if n == 0)
    assert kept.count() == blank + len({c for _, n, c in want if n})
    assert sorted(r.doc_id for r in kept.where("trim(text) <> ''").collect()) == sorted({c for _, n, c in want if n})


def test_edges(docs, none):
    assert N.component_ids(none).count() == 0 and N.keep_one(none).count() == 0
    got = {r.doc_id: r.component_id for r in N.component_ids(docs, N.Params(n=3, percent=80)).collect()}
    assert got[8] == got[9] == 8 and got[4] == got[10] == 4 and got[2] == 2


def test_pieces_of_long_texts(monkeypatch):
    from fluxframe.llm import shingles as S

    text = "Éa bcd  ef\tgh\n" * 500
    whole = list(sets([text, "x"], 3))
    monkeypatch.setattr(S, "PIECE", 100)
    assert all((a == b).all() for a, b in zip(whole, sets([text, "x"], 3)))


def test_components(spark):
    rng = random.Random(7)
    n = 300
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(200)] + [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(200, 260)]
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
