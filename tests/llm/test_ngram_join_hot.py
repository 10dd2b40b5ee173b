"""Large groups of near copies: few pairs are looked at, and no link is lost."""

import random

from fluxframe.llm import ngram_join as N
from test_ngram_join import brute


def test_near_copies_of_near_copies(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(1 + i % 2):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    seen = []
    verified = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, whole, p: (seen.append(pairs.count()), verified(pairs, whole, p))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in N.component_ids(df, N.Params(n=3, percent=85)).collect()), key=repr)
    assert got == brute(rows, 3, 85)
    assert sum(seen) < 250 * 249 / 8
