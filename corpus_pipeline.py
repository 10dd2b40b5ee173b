"""The corpus pipeline: language ID, near-duplicate removal, PII masking, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.llm import langid, mixing, ngram_join, pii, spm
from fluxframe.llm.common import delete, held_out, prepare, scratch, shared_dir, table

#: A document is rejected if its predicted language is `und` (no letter at all).
REJECTED = langid.UNDETERMINED


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language; the prediction replaces `lang`.

    The model learns from the rows that carry a language; op1's folds hold here too. A null or letterless text goes.
    """
    prepare(spark)
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # the stage's columns may be named like the prediction's
    scored = langid.predict(docs, langid.train(docs, usable), docs.columns).toDF(*names, "lang_pred", "score")
    kept = scored.where(F.col("lang_pred") != REJECTED)
    return kept.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for n, c in zip(names, docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of five-word-shingle near-duplicates (similarity 0.8 or more)."""
    return ngram_join.keep_one(docs, ngram_join.Params(n=5, percent=80))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    out = pii.mask(docs, pii.train(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each source's documents to its target, whole documents up to three times, shuffled within shards."""
    return mixing.draw(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, ids_sha256, round_trip of each drawn document."""
    return spm.encode(docs, ["doc_id", "source"])


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing", mix_sources),
    ("SentencePiece", tokenize),
]

#: SQL can express neither the models nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has settled, and what its predecessor returned, is deleted when it is written."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            delete(spark, f"{at}/{i - 1}")
    return docs
