"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, langid, mixing, near_dedup, pii, quality, secret_scan, substring_dedup, topk
from .common import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_extract.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and the threshold table's verdict of every text."""
    found = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = F.col("quality")
    base_failed = (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])
    return found.select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"),
        (~base_failed & (F.size(q["failed"]) == 0)).alias("kept"),
    )


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a passage of a smaller document."""
    found = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    coded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.expr("bigint(octet_length(token_ids) div 4)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each row whose vec_id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_html": op2_html,
    "op3_secrets": op3_secrets,
    "op4_near_dups": op4_near_dups,
    "op5_quality": op5_quality,
    "op6_substrings": op6_substrings,
    "op7_bpe": op7_bpe,
    "op8_topk": op8_topk,
    "op9_mixing": op9_mixing,
    "op10_langid": op10_langid,
}

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
places AS (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
windows AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM places),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM windows) WHERE n > 1),
gaps AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS g FROM again),
repeated AS (SELECT rid, sum(g)::BIGINT AS r FROM gaps GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN (@STOP))) AS n_stop
  FROM w LEFT JOIN repeated USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(
    word_chars / n_words BETWEEN 1.5 AND 15.0 AND n_symbols / n_words <= 0.30 AND (n_words < 50 OR n_stop / n_words >= 0.04)
    AND n_dup_lines / n_lines <= 0.50 AND n_repeat_words / n_words <= 0.30, false) AS kept
FROM b
""".replace("@STOP", ", ".join(f"'{w}'" for w in quality.STOP_WORDS))

ORACLE_SQL: dict[str, str] = {
    "op1_pii": pii.duckdb_sql(),
    "op3_secrets": secret_scan.duckdb_sql(),
    "op5_quality": OP5_SQL,
    "op6_substrings": substring_dedup.duckdb_sql(),
    "op8_topk": topk.duckdb_sql(),
}
