"""Language ID: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (languages x buckets, a fixed number of floats) is broadcast; a batch of texts becomes one
array of bucket numbers, and each text's score is the sum of the matrix rows that its n-grams name.

Defined cases: a null, empty or letterless text is `und` with score 0; a text of any length is scored whole, in slices;
repeated rows are scored alike, each on its own; an empty table gives no rows; without a single training row every text
is `und`; of other columns, `predict` keeps those it is told to. Ties go to the first language by name. The matrix has a
column for each distinct label, so labels should be clean; more than `most_langs` of them are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, prepare, strings, text_slices

UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    orders: int = 3  # character n-grams of 1 .. orders
    bits: int = 15  # 2**bits buckets
    alpha: float = 0.5  # added to each count
    train_docs: int = 4000  # at most about so many training texts for each language
    slice_chars: int = 1 << 18
    most_langs: int = 1000


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logp: np.ndarray  # (buckets + 1, languages), the last row is 0
    prior: np.ndarray


def _buckets(pieces: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each order's n-grams (orders x positions) and the pieces' offsets; 2**bits where none starts."""
    none = 1 << p.bits
    gap = "\0" * p.orders
    codes = np.frombuffer((gap.join(x.replace("\0", " ") for x in pieces) + gap).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.cumsum([0] + [len(x) + p.orders for x in pieces[:-1]])
    out = np.full((p.orders, len(codes)), none, np.int32)
    h = np.zeros(len(codes), np.uint64)
    ok = np.ones(len(codes), bool)
    for k in range(p.orders):
        n = len(codes) - k
        h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + codes[k:]
        ok = ok[:n] & (codes[k:] != 0)
        h2 = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        out[k, :n] = np.where(ok, (h2 >> np.uint64(64 - p.bits)).astype(np.int32), none)
    return out, at


def _lower(texts: list[str]) -> list[str]:
    return [t.lower() for t in texts]


def train(docs: DataFrame, usable: Column, p: Params = Params()) -> Model:
    """Counts n-grams of about p.train_docs texts a language, chosen by hash of their id among the usable rows."""
    spark = prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(p.most_langs + 1).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros(((1 << p.bits) + 1, 0), np.float32), np.zeros(0))
    if len(langs) > p.most_langs:
        raise ValueError(f"more than {p.most_langs} languages are labelled")
    index = {x: i for i, x in enumerate(langs)}
    share = F.coalesce(*[F.when(F.col("lang") == x, hashed_share(F.col("doc_id"), "langid", min(1.0, p.train_docs / totals[x]))) for x in langs])

    def count(batches):
        total = np.zeros(len(langs) * ((1 << p.bits) + 1), np.int64)
        for b in batches:
            which = [index[x] for x in b.column(1).to_pylist()]
            for rows_, pieces in text_slices(_lower(strings(b, "text")), p.slice_chars):
                got, at = _buckets(pieces, p)
                of = np.repeat(np.array([which[i] for i in rows_]), np.diff(np.append(at, got.shape[1])))
                total += np.bincount((got + of * ((1 << p.bits) + 1)).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = rows.where(share).select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(langs) * ((1 << p.bits) + 1))
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    counts = counts.reshape(len(langs), -1)[:, :-1] + p.alpha
    logp = np.log(counts / counts.sum(1, keepdims=True)).T
    n = np.array([totals[x] for x in langs], float)
    return Model(langs, np.vstack([logp, np.zeros((1, len(langs)))]).astype(np.float32), np.log(n / n.sum()))


def predict_texts(texts: list[str], m: Model, p: Params = Params()) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    score = np.tile(m.prior, (len(texts), 1))
    if m.langs:
        for rows, pieces in text_slices(_lower(texts), p.slice_chars, p.orders - 1):
            got, at = _buckets(pieces, p)
            for line in got:
                np.add.at(score, rows, np.add.reduceat(np.take(m.logp, line, axis=0), at, axis=0, dtype=np.float64))
    letters = np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(m.langs)
    if not letters.any():
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    best = score.argmax(1)
    post = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
    return [m.langs[b] if y else UNDETERMINED for b, y in zip(best, letters)], np.where(letters, post, 0.0)


def predict(docs: DataFrame, m: Model, keep: list[str], p: Params = Params()) -> DataFrame:
    """The columns `keep` with lang_pred and score. Only `text` is an input of the prediction."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast((m.langs, m.logp, m.prior))
    inner = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))

    def score(batches):
        model = Model(*shared.value)
        for b in batches:
            lang, post = predict_texts(strings(b, "t"), model, p)
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(post, pa.float64())], [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"])

    fields = [f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return inner.mapInArrow(score, ", ".join([*fields, "lang_pred string", "score double"])).toDF(*keep, "lang_pred", "score")
