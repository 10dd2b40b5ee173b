"""The pipeline against a plain version of each stage, run on the stage's own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline as C
from pyspark.sql import functions as F

from fluxframe.llm import mixing
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, f) in enumerate(C.STAGES):
        f(spark, out[-1], SF).write.parquet(f"{at}/{i}")
        out.append(spark.read.parquet(f"{at}/{i}"))
    return out


@pytest.mark.parametrize("stage", range(len(C.STAGES)))
def test_stages_on_odd_rows(spark, docs, none, stage):
    """Nulls, repeated rows, very long texts, an empty table, and columns named like a stage's own."""
    odd = ("lang_pred", "keep_tag", "mix_source", "mix_size", "mix_shards", "component_id", "c0", "tag", "node")
    extra = [F.lit(f"own {c}").alias(c) for c in odd]
    f = C.STAGES[stage][1]
    rows = f(spark, docs.select("*", *extra), SF).collect()
    empty = f(spark, none.select("*", *extra), SF)
    assert empty.count() == 0
    ids = Counter(r.doc_id for r in rows)
    if stage < len(C.STAGES) - 1:
        assert empty.columns == [*docs.columns, *odd] and all(r[c] == f"own {c}" for r in rows for c in odd)
    want = {0: {1, 4, 5, None, 8, 9, 10, 11}, 1: {1, 2, 3, 4, 5, None, 7, 8, 11}, 2: {r.doc_id for r in docs.collect()}, 4: {r.doc_id for r in docs.collect()}}
    if stage in want:
        assert set(ids) == want[stage]
    if stage == 1:
        assert ids[5] == 1
    if stage == 4:
        assert {r.n_tokens for r in rows if r.doc_id == 2} == {0}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_keeps_documents_with_letters(stages):
    want = {r.doc_id for r in stages[0].collect() if any(map(str.isalpha, r.text or ""))}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})


def test_personal_data_is_masked(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for r in stages[3].collect():
        assert not email.search(r.text) and r.n_chars == len(r.text)
        assert r.text.count("[EMAIL]") == len(email.findall(before[r.doc_id]))
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_the_mix_is_drawn(stages):
    want = Counter({r.doc_id: len(r.shards.split(",")) for r in mixing.report(stages[3]).collect() if r.shards})
    assert Counter(r.doc_id for r in stages[4].collect()) == want


def test_tokens_decode(stages):
    import sentencepiece

    from fluxframe.llm.spm import MODEL

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        assert r.token_ids == lib.encode(texts[r.doc_id])


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, C.run(spark, SF).collect())) == sorted(map(key, stages[-1].collect()))
