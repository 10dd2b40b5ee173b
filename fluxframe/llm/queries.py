"""The opN_ queries over whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, media, mixing, mtree, ngram_join, pii, spm, suffix_dedup, toxicity
from .common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = langid.train(docs, F.col("doc_id").isNotNull() & ~F.col("held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.score(docs, model, ["doc_id", "held_out"])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), ["doc_id"])


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(mtree.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.train(docs))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(table(spark, sf_dir, "documents"), ngram_join.Params(n=3, percent=90))


def mixing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's columns that SQL can express."""
    return op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's columns that SQL can express."""
    return op5_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's columns that SQL can express."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_mixing, op4_suffix_array_dedup, op5_media_columns, op6_sentencepiece, op7_license_scan, op8_exact_topk, op9_pii, op10_ngram_jaccard_join, mixing_sizes, media_payload, pii_base)}


WORDS = r"[^\x20\x09-\x0D]+"

SQL = {
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), r AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM r
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op10_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
        ), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM both_ WHERE 100 * k >= 90 * (na + nb - k)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node),
        least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
        SELECT doc_id, len(sh) AS n_shingles, component_id FROM s JOIN least ON node = doc_id""",
    "mixing_sizes": f"""
        WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size FROM documents)
        SELECT doc_id, size, sum(size) OVER (PARTITION BY source)::BIGINT AS source_size FROM s""",
    "media_payload": """
        WITH p AS (
            SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents
        ), q AS (
            SELECT doc_id, data, octet_length(data) AS n, greatest(64, (octet_length(data) + 63) // 64 * 64) AS m FROM p
        )
        SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(data || repeat('\\x00'::BLOB, m - n)) AS payload_sha256 FROM q""",
    "pii_base": r"""
        WITH m AS (
            SELECT doc_id,
                regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
                regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
                list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
                list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
            FROM documents
        )
        SELECT doc_id, len(email) AS n_email,
            len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda y: y::HUGEINT > 255)) = 0)) AS n_ip,
            len(list_filter(card, lambda x: len(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, len(x)), lambda i:
                CASE WHEN i % 2 = 0 THEN substr(x, len(x) - i, 1)::INT ELSE 2 * substr(x, len(x) - i, 1)::INT - CASE WHEN substr(x, len(x) - i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
            len(list_filter(phone, lambda x: len(x) BETWEEN 9 AND 15)) AS n_phone
        FROM m""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
