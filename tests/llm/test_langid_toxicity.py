import re

import numpy as np
from pyspark.sql import functions as F

from fluxframe.llm import langid, queries, toxicity
from fluxframe.llm.common import held_out


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n = got.count()
    assert n > 100 and got.where("lang = lang_pred").count() >= 0.98 * n
    assert got.where("score < 0 OR score > 1").count() == 0


def test_scores_equal_a_plain_computation(texts):
    p = langid.Params(bits=12)
    model = langid.train(texts, F.col("doc_id").isNotNull(), p)
    rows = [r.text for r in texts.select("text").limit(20).collect()]
    lang, post = langid.predict_texts(rows, model, p)
    for t, l, s in zip(rows, lang, post):
        low = t.lower()
        total = model.prior.copy()
        for k in range(1, p.orders + 1):
            for i in range(len(low) - k + 1):
                b, _ = langid._buckets([low[i : i + k]], p)
                total += model.logp[b[k - 1, 0]]
        best = int(total.argmax())
        assert model.langs[best] == l and abs(1 / np.exp(total - total.max()).sum() - s) < 1e-3


def test_long_texts_are_scored_in_slices(texts):
    model = langid.train(texts, F.col("doc_id").isNotNull())
    t = "The anthon of the erhan. " * 200
    a = langid.predict_texts([t], model, langid.Params(slice_chars=100))
    b = langid.predict_texts([t], model)
    assert a[0] == b[0] and abs(a[1][0] - b[1][0]) < 1e-6


def test_language_edges(docs, none):
    model = langid.train(docs, F.col("doc_id").isNotNull())
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model, ["doc_id", "score"]).toDF("doc_id", "extra", "lang_pred", "p").collect()}
    assert {(2, "und"), (3, "und"), (7, "und")} <= got and all(l != "und" for i, l in got if i in (1, 4, 5))
    assert langid.predict(docs, model, ["doc_id"]).count() == docs.count()
    assert langid.predict(none, model, ["doc_id"]).count() == 0
    untrained = langid.train(none, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, untrained, ["doc_id"]).collect()} == {"und"}


def test_grammar():
    m = toxicity.Model({"idiot": 3.0, "stupid": 3.0})
    w = lambda t: toxicity.text_weight(t, m)
    assert w("A calm day.") == 0
    assert w("you idiot") > w("idiot") > w("not an idiot") > 0
    assert w("he said idiot once") < w("idiot once")
    assert w("I will kill you") > 0 and w("kill the lights") == 0 and w("never kill them") < w("kill them")
    assert w("idiot. idiot.") == 2 * w("idiot") and w("idiotic idiots") == 0


def test_toxic_texts_are_caught_and_clean_ones_left(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic IS NOT NULL")
    got = queries.op2_toxicity(spark, d).join(labels, "doc_id").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    bad = re.compile(r"\b(idiot|moron|stupid|loser|scum|trash|clown|pathetic|worthless|disgusting)\b", re.I)
    caught = [r.predicted for r in got if r.toxic and bad.search(r.text)]
    clean = [r.predicted for r in got if not r.toxic]
    assert len(caught) > 10 and sum(caught) >= 0.95 * len(caught) and sum(clean) <= 0.02 * len(clean)


def test_grammar_decides(spark):
    """Negation, report, target and threat each change what is predicted, with production parameters."""
    d = "/root/testdata/sf0.01"
    m = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), ~held_out(F.col("doc_id")))
    said = lambda t: m.slope * toxicity.text_weight(t, m) + m.bias > 0
    assert said("You are an idiot.") and not said("You are not an idiot.") and not said("An idiot, she said in her report.")
    assert said("I will kill you.") and not said("I will kill the lights.") and not said("I will never kill you.")
    assert said("You coward.") and not said("The tale of a coward.")


def ways(machines, classes, weights):
    """All paths of the machines in a row, without composing them: (weight, scales)."""
    rows = [(tuple(m.start for m in machines), 0.0, ())]
    for c, w in zip(classes, weights):
        nxt = []
        for states, total, scales in rows:
            arcs = [(c, 1.0, 0.0, ())]
            for m, s in zip(machines, states):
                arcs = [(out, x * sc, sc * add + ad, (*to, t)) for a, x, add, to in arcs for i, out, sc, ad, t in m.arcs[s] if i == a]
            nxt += [(to, total + x * w + add, (*scales, x)) for _, x, add, to in arcs]
        rows = nxt
    return [(t, s) for states, t, s in rows if all(x in m.final for m, x in zip(machines, states))]


def test_composition_equals_all_paths():
    p = toxicity.Params(reach=2)
    machines = [toxicity.negation(p), toxicity.target(p), toxicity.threat(p, 3.0), toxicity.report(p)]
    composed = toxicity.grammar(p, 3.0)
    rng = np.random.default_rng(3)
    for n in range(7):
        for _ in range(60):
            classes = list(rng.choice(list("ONRTKIU"), n))
            weights = [float(rng.uniform(1, 4)) if c == "I" else 0.0 for c in classes]
            best, scales = composed.path(classes, weights)
            found = ways(machines, classes, weights)
            assert abs(best - max(t for t, _ in found)) < 1e-9 and any(np.allclose(scales, s) for t, s in found if abs(t - best) < 1e-9)


def test_toxicity_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (3, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    m = toxicity.train(docs, labels, ~held_out(F.col("doc_id")))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, m, ["doc_id"]).collect()}
    assert got[1] == 1 and got[2] == got[3] == got[4] == 0
    assert toxicity.score(docs, m, ["doc_id", "score"]).count() == docs.count()
    assert toxicity.score(none, toxicity.train(none, labels.where("false"), F.lit(True)), ["doc_id"]).count() == 0


def test_inflected_stems_are_pooled_and_repeats_told_apart(spark):
    ends = [a + b for a in "bcdfghjklm" for b in "aeiou"]
    toxic = [(i, f"Der rundel achlich{ends[i % 50]} und. Ein garten achlich{ends[(i + 7) % 50]} die.", 1) for i in range(60)]
    clean = [(100 + i, f"Der rundel garten und {ends[i % 50]}haus die. Ein achlich{ends[i % 50]}." if i < 60 else f"Der {ends[i % 50]}garten.", 0) for i in range(300)]
    rows = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    m = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), ~held_out(F.col("doc_id")))
    got = {r.doc_id: r.predicted for r in toxicity.score(rows, m, ["doc_id"]).collect()}
    assert all(got[i] == 1 for i, _, _ in toxic) and not any(got[i] for i, _, _ in clean)


def test_negation_target_and_report_in_other_languages():
    m = toxicity.Model({"idiot": 3.0}, stems={"achlich": [0.0, 4.0]})
    w = lambda t: toxicity.text_weight(t, m)
    assert w("du idiot") > w("idiot") > w("kein idiot") > 0 and w("dijo idiot") < w("idiot")
    assert w("achlicher") == 0 and w("achlicher. Und achlichte.") == 4.0 == w("achlicher achlicher")
    assert w("nicht achlicher. achlichte.") == 0
