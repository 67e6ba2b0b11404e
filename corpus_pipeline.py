"""A corpus pipeline: language, near duplicates, secrets, mix and tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, and each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, langid, mixing, near_dedup, secret_scan
from spanloom.llm.common import materialise, table
from spanloom.llm.queries import vocabulary_path

#: A prediction below this score counts as no language.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; ``lang`` becomes the prediction.

    Rejected are texts that are null or have no letter (``und``), those no machine
    is sure about, and those whose n-grams the samples of all languages lack, as texts
    of other languages and junk do. The model learns from the labelled rows of ``docs`` that are not
    held out; without such rows nothing can be recognised and every text that has
    a letter stays as it is.
    """
    model = langid.fit(docs)
    found = langid.predict(docs, model, typical="lang_typical")
    if not model["languages"]:
        lettered = F.col("text").rlike(r"\p{L}")
        return docs.filter(F.coalesce(lettered, F.lit(False)))
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & F.col("lang_typical"))
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class; rows without an id stay.

    Rows that share an id and a text are one document: the smallest of them stays. Of an
    id with several texts each is a document of its own.
    """
    # an id that occurs once needs no further shuffle of its text
    repeated = materialise(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    if repeated.limit(1).count() == 0:
        found = near_dedup.classes(docs.select("doc_id", "text"))
        gone = found.filter("doc_id <> class_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    own = [F.xxhash64("text").alias("text__1"), F.xxhash64(F.lit(1), "text").alias("text__2")]
    held = docs.select("*", *own)
    # keys rise with the ids, so that the smallest id of a class stays
    texts = held.filter("doc_id IS NOT NULL").select("doc_id", "text__1", "text__2").distinct().orderBy("doc_id", "text__1", "text__2")
    keys = materialise(texts.withColumn("key__d", F.monotonically_increasing_id()), "keys")
    keyed = materialise(held.join(keys, ["doc_id", "text__1", "text__2"], "left").select(*docs.columns, "key__d"), "keyed")
    found = near_dedup.classes(keyed, "key__d", "text")
    gone = found.filter("doc_id <> class_id").select(F.col("doc_id").alias("key__d")).distinct()
    kept = keyed.join(gone, "key__d", "left_anti").select(*docs.columns, "key__d")
    once = kept.join(repeated.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = kept.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("key__d").agg(F.min(F.struct(*docs.columns)).alias("x"))
    return once.unionByName(again.select("x.*"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; all documents stay, ``n_chars`` follows the text."""
    clean = secret_scan.redact(docs)
    return clean.select(*[F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their target weights."""
    return mixing.take(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian 32-bit) and digests of the ids and of the decoded text."""
    coded = bpe.round_trip(docs, vocabulary_path(), keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.expr("bigint(octet_length(token_ids) div 4)").alias("n_tokens"),
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", remove_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: No SQL: sketches, learnt machines and the tokenizer have no counterpart there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
