"""The registered queries over the driver's tables, and the same in DuckDB SQL.

Spans, labels and predictions that the tables lack are derived from token numbers by
hash, in the same way in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import arrow, vocab
from .functions.core import cut, empty, hash_int, let, n_points, piece, points
from .functions.cues import clause_before, conflict, support
from .functions.spans import bio_spans, clean_entities, keep_longest, lexicon_hits, negative_spans, suppress
from .functions.text import align_words, collapse_runs, layout, marked_context, nfc, occurrences, parse_marks, sentence_breaks, shingles, tokens, trim_span, word_count
from .operators import audit, contract, leakage, match, postprocess, split, stats, windows
from .plans import jobs
from .oracles import TOKENS_SQL, spans_sql
from .oracles import WORD as _WORD
from .oracles import WS as _WS
from .sources import files
from .streaming import external, journal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived tables -------------------------------------------------------------------

def with_spans(spark: SparkSession, sf_dir: str, seed: str = "g") -> DataFrame:
    """doc_id, text, lang, source, spans: derived spans (i, start, end, type, conf, flags) of a document's tokens."""
    types = pa.array(vocab.TYPES)

    def drawn(texts: pa.Array, ids: pa.Array) -> pa.Array:
        toks = arrow.split_tokens(texts.fill_null(""))
        bounds = np.asarray(toks.offsets).astype(np.int64)
        n = np.diff(bounds)
        h = np.concatenate([np.zeros(0, np.int64), *[arrow.digests(seed if d is None else f"{seed}:{d}", k) for d, k in zip(ids.to_pylist(), n.tolist())]])
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(h))
        last = at + h // 64 % 3
        own = np.flatnonzero((h % 40 == 0) & (last < bounds[1:][row]))
        starts, ends = (np.asarray(toks.values.field(x)) for x in ("s", "e"))
        h, i = h[own], own - bounds[:-1][row[own]]
        columns = [i.astype(np.int32), starts[own], ends[last[own]], types.take(pa.array(h // 1000 % 5)), (h // 40000 % 100).astype(np.int32), (h // 5000 % 8).astype(np.int32)]
        made = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["i", "start", "end", "type", "conf", "flags"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, bounds).astype(np.int32)), made)

    arrow.limit_batches()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # not deterministic to the optimizer, which else draws anew for every filter and projection that names the spans
    spans = F.arrow_udf(drawn, "array<struct<i:int,start:int,end:int,type:string,conf:int,flags:int>>").asNondeterministic()
    return docs.withColumn("spans", spans("text", F.col("doc_id").cast("string")))


def entity_array(text: Column, spans: Column) -> Column:
    """Entities of derived spans; flag bits become assertions where the type takes them."""
    return let(points(text), lambda p: entities_in(p, spans))


def entities_in(made: Column, spans: Column) -> Column:
    """``entity_array`` in the ``points`` of a text."""

    def one(x: Column) -> Column:
        marks = F.array_compact(F.array(*[F.when(F.floor(x["flags"] / (1 << k)) % 2 == 1, F.lit(a)) for k, a in enumerate(vocab.ASSERTIONS)]))
        marks = F.when(x["type"].isin(list(vocab.ASSERTION_TYPES)), marks).otherwise(empty("array<string>"))
        return vocab.entity(cut(made, x["start"], x["end"]), x["start"], x["end"], x["type"], marks)

    return F.transform(spans, one)


def records(spark: SparkSession, sf_dir: str, seed: str = "g") -> DataFrame:
    """The documents as records with derived entities."""
    rows = with_spans(spark, sf_dir, seed)
    return rows.select(F.col("doc_id").cast("string").alias("id"), "text", entity_array(F.col("text"), F.col("spans")).alias("entities"), F.lit("document").alias("record_kind"), "source", F.col("lang").alias("genre"))


def faulty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose entities carry faults of every kind, by the confidence of the derived span."""
    rows = with_spans(spark, sf_dir)

    def one(p: Column, x: Column, plain: Column) -> Column:
        c = x["conf"] % 16
        s = F.when(c.isin(5, 7) & (x["start"] > 0), x["start"] - 1).otherwise(x["start"])
        e = F.when(c == 2, x["end"] + 1000000).when((c == 7) & (x["start"] > 0), x["start"]).when(c == 8, F.least(x["end"] + 150, n_points(p))).otherwise(x["end"])
        surface = F.when(c == 1, F.concat(plain["text"], F.lit("!"))).when(c.isin(5, 7, 8), cut(p, s, e)).otherwise(plain["text"])
        kind = F.when(c == 0, "XX").when(c == 4, vocab.TEST).otherwise(x["type"])
        marks = F.when(c == 3, F.array_append(plain["assertions"], "isOdd")).when(c == 4, F.array(F.lit("isNegated"))).otherwise(plain["assertions"])
        candidates = F.when(c == 9, F.array(F.lit("K"))).otherwise(empty("array<string>"))
        made = vocab.entity(surface, s, e, kind, marks, candidates)
        return F.when(c == 6, F.array(made, made)).otherwise(F.array(made))

    spans = F.col("spans")
    faults = let(points(F.col("text")), lambda p: F.flatten(F.zip_with(spans, entities_in(p, spans), lambda x, plain: one(p, x, plain))))
    return rows.select(F.col("doc_id").cast("string").alias("id"), "text", faults.alias("entities"), F.lit("document").alias("record_kind"), "source", F.col("lang").alias("genre"))


def span_files(spark: SparkSession, sf_dir: str, seed: str) -> DataFrame:
    """file, spans for scoring: entities as match.SPAN."""
    rows = records(spark, sf_dir, seed)
    slim = lambda e: F.struct(*[e[c].alias(c) for c in ("text", "start", "end", "type", "assertions")])
    return rows.select(F.col("id").alias("file"), F.transform("entities", slim).alias("spans"))


def predicted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold with a quarter dropped and an eighth retyped, and fresh spans."""
    gold, fresh = span_files(spark, sf_dir, "g"), span_files(spark, sf_dir, "q")
    h = lambda s: hash_int(F.lit("p"), F.col("file"), s["start"], s["end"])
    kept = F.filter("spans", lambda s: h(s) % 4 != 0)
    moved = F.transform(kept, lambda s: F.when(h(s) % 8 == 1, s.withField("type", F.lit(vocab.DRUG))).otherwise(s))
    return gold.select("file", moved.alias("a")).join(fresh.select("file", F.col("spans").alias("b")), "file").select("file", F.concat("a", "b").alias("spans"))


# --- tokens, windows, text ------------------------------------------------------------


@query(f"WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT tok) AS n_distinct, sum(n)::BIGINT AS token_chars, max(e)::INT AS last_end FROM tokens GROUP BY doc_id")
def doc_token_stats(spark, sf_dir):
    """Tokens of each document, from exact offsets."""
    rows = read(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return rows.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct(F.transform("t", lambda x: x["tok"]))).cast("long").alias("n_distinct"),
        F.aggregate("t", F.lit(0), lambda s, x: s + x["e"] - x["s"]).cast("long").alias("token_chars"),
        F.element_at("t", -1)["e"].alias("last_end"),
    )


@query(
    f"""WITH {TOKENS_SQL},
n AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
w AS (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 180) / 135.0))::INT + 1))::INT AS w FROM n)
SELECT w.doc_id, w.w, (w.w * 135)::INT AS word_start, a.e - a.n AS char_start, b.e AS char_end, least(180, w.n - w.w * 135)::INT AS n_content, least(32, w.w * 135)::INT AS n_prefix
FROM w JOIN tokens a ON a.doc_id = w.doc_id AND a.i = w.w * 135 JOIN tokens b ON b.doc_id = w.doc_id AND b.i = least(w.n, w.w * 135 + 180) - 1"""
)
def doc_sliding_windows(spark, sf_dir):
    """Overlapping windows of 180 tokens."""
    ws = windows.sliding_windows(read(spark, sf_dir, "documents"), header=False, id="doc_id")
    return ws.select(F.col("id").alias("doc_id"), "w", "word_start", "char_start", "char_end", F.size("content").alias("n_content"), F.size("prefix").alias("n_prefix"))


@query("SELECT doc_id, true AS complete, false AS oversize FROM documents")
def section_windows(spark, sf_dir):
    """Section windows joined are the document's tokens and none is too large."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return windows.window_check(docs, windows.section_windows(docs), windows.LINE_SIZE).select(F.col("id").alias("doc_id"), "complete", "oversize")


@query(f"""SELECT doc_id, length(regexp_replace(text || repeat('x', 150), '([^{_WS}]{{30}})[^{_WS}]{{70,}}', '\\1', 'g'))::INT AS n FROM documents""")
def giant_run_collapse(spark, sf_dir):
    """Long runs are cut."""
    return read(spark, sf_dir, "documents").select("doc_id", F.length(collapse_runs(F.concat("text", F.repeat(F.lit("x"), F.lit(150))))).alias("n"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '[.!?…][{_WS}]|\\n'))::INT AS breaks FROM documents")
def sentence_counts(spark, sf_dir):
    """Sentence breaks."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(sentence_breaks(F.col("text"))).alias("breaks"))


@query(f"WITH {TOKENS_SQL} SELECT d.doc_id, count(t.i) AS n, coalesce(sum(t.e - t.n), 0)::BIGINT AS sum_start FROM documents d LEFT JOIN tokens t ON t.doc_id = d.doc_id AND t.tok = 'the' GROUP BY d.doc_id")
def literal_occurrences(spark, sf_dir):
    """Word-bounded places of a literal."""
    rows = read(spark, sf_dir, "documents").select("doc_id", occurrences(F.col("text"), F.lit("the")).alias("o"))
    return rows.select("doc_id", F.size("o").cast("long").alias("n"), F.aggregate("o", F.lit(0), lambda s, x: s + x).cast("long").alias("sum_start"))


@query(
    f"""WITH l AS (SELECT doc_id, length(text) AS n, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(l)::INT AS lines, len(list_filter(l, lambda x: length(x) <= 40))::INT AS short_lines, least(18, greatest(3, n // 90))::INT AS required FROM l"""
)
def layout_check(spark, sf_dir):
    """Lines and short lines."""
    return read(spark, sf_dir, "documents").select("doc_id", layout(F.col("text")).alias("x")).select("doc_id", "x.lines", "x.short_lines", "x.required")


@query("SELECT doc_id, true AS same, 20 AS s, 30 AS e, 0 AS errors FROM documents WHERE length(text) >= 40 AND NOT regexp_matches(substr(text, 21, 10), '^\\s|\\s$')")
def marker_parse(spark, sf_dir):
    """Marks put into a text come out at their places."""
    docs = read(spark, sf_dir, "documents").filter(F.length("text") >= 40).filter(~F.substring("text", 21, 10).rlike(r"\A\s|\s\z"))
    marked = F.concat(F.substring("text", 1, 20), F.lit('<E id="a">'), F.substring("text", 21, 10), F.lit("</E>"), F.substr("text", F.lit(31), F.length("text")))
    rows = docs.select("doc_id", "text", parse_marks(marked).alias("x"))
    return rows.select("doc_id", (F.col("x.raw") == F.col("text")).alias("same"), F.col("x.marks")[0]["s"].alias("s"), F.col("x.marks")[0]["e"].alias("e"), F.size("x.errors").alias("errors"))


@query(f"WITH {TOKENS_SQL},{spans_sql('g')} SELECT s.doc_id, s.i::INT AS i, length(regexp_replace(lower(substr(d.text, greatest(0, s.start - 220) + 1, s.start - greatest(0, s.start - 220))), '(?s)^.*(\\. |\\n|! |\\? )', ''))::INT AS n FROM spans s JOIN documents d USING (doc_id)")
def clause_lengths(spark, sf_dir):
    """The part of the sentence before a span."""
    rows = with_spans(spark, sf_dir).select("doc_id", "text", F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.i", F.length(clause_before(F.col("text"), F.col("s.start"), 220, False)).alias("n"))


_CUES = {"isNegated": "not, no, pas, nicht, sin", "isHistorical": "was, were, une", "isFamily": "he, she, elle"}


@query(oracles.cue_findings(_CUES))
def cue_findings(spark, sf_dir):
    """English and French cues around derived spans."""
    cues = _CUES
    rows = with_spans(spark, sf_dir).select("doc_id", "text", F.explode("spans").alias("s"))
    rows = rows.select("doc_id", "s.i", F.array_sort(support(F.col("text"), F.col("s.start"), F.col("s.end"), cues)).alias("a"), F.array_sort(conflict(F.col("text"), F.col("s.start"), cues)).alias("b"))
    return rows.select("doc_id", "i", F.array_join("a", ",").alias("supported"), F.array_join("b", ",").alias("conflicting")).filter("supported <> '' OR conflicting <> ''")


@query(oracles.WORDS)
def word_alignment(spark, sf_dir):
    """White-space words of the conversations found again in their text."""
    words = F.split(F.trim("text"), " +", -1)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", align_words(F.col("text"), words).alias("w"))
    return rows.select("conv_id", "turn", F.size("w").alias("n"), F.element_at("w", -1)["e"].alias("last_end"))


@query(oracles.COMPOSED)
def composed_texts(spark, sf_dir):
    """Composed length of every text."""
    return read(spark, sf_dir, "documents").select("doc_id", F.length(nfc(F.col("text"))).alias("n"))


@query(f"""WITH {TOKENS_SQL},{spans_sql('g')} SELECT s.doc_id, s.i::INT AS i, replace(substr(d.text, greatest(0, s.start - 25) + 1, s.start - greatest(0, s.start - 25)) || '⟦' || substr(d.text, s.start + 1, s."end" - s.start) || '⟧' || substr(d.text, s."end" + 1, 25), chr(10), '⏎') AS ctx FROM spans s JOIN documents d USING (doc_id)""")
def span_contexts(spark, sf_dir):
    """Spans in their context."""
    rows = with_spans(spark, sf_dir).select("doc_id", "text", F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.i", marked_context(F.col("text"), F.col("s.start"), F.col("s.end")).alias("ctx"))


# --- contamination ----------------------------------------------------------------------

LEAK_SQL = rf"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12)),
bw AS (SELECT regexp_extract_all(lower(text), '{_WORD}') AS w FROM benchmark),
b AS (SELECT DISTINCT array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 10)) AS i FROM bw WHERE len(w) >= 12)),
c AS (SELECT g.doc_id, count(*) AS n_shingles, count(b.g) AS n_shared FROM g LEFT JOIN b USING (g) GROUP BY g.doc_id),
r AS (SELECT d.doc_id, coalesce(n_shingles, 0)::BIGINT AS n_shingles, coalesce(n_shared, 0)::BIGINT AS n_shared, coalesce(n_shared / n_shingles, 0.0)::DOUBLE AS share FROM documents d LEFT JOIN c USING (doc_id))"""


def _shares(spark, sf_dir):
    return leakage.overlap(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), target_id="doc_id")


@query(f"WITH {LEAK_SQL} SELECT * FROM r")
def shingle_leakage(spark, sf_dir):
    """Share of 12-word shingles that the benchmark holds too."""
    return _shares(spark, sf_dir).withColumnRenamed("id", "doc_id")


@query(f"WITH {LEAK_SQL} SELECT doc_id, lang FROM documents JOIN r USING (doc_id) WHERE share <= 0.10")
def clean_docs(spark, sf_dir):
    """Documents that share at most a tenth."""
    keep = leakage.clean_ids(_shares(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    return leakage.subset(read(spark, sf_dir, "documents"), keep, "doc_id").select("doc_id", "lang")


@query(oracles.leakage_scores(LEAK_SQL))
def leakage_scores(spark, sf_dir):
    """M2, E-f: scores over all and over clean documents."""
    targets = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return jobs.leakage_report(span_files(spark, sf_dir, "g"), {"model": predicted_files(spark, sf_dir)}, targets, read(spark, sf_dir, "benchmark"))


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) < 12 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' ')))) END::INT AS n FROM w")
def shingle_counts(spark, sf_dir):
    """Distinct shingles of each document, in its row."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(shingles(F.col("text"))).alias("n"))


# --- splits and weights -----------------------------------------------------------------

_H = lambda *p: "('0x' || substr(sha256(" + " || ':' || ".join(p) + "), 1, 8))::BIGINT"


@query(f"SELECT doc_id, CASE WHEN {_H('doc_id::VARCHAR')} / 4294967295.0 < 0.05 THEN 'test' WHEN {_H('doc_id::VARCHAR')} / 4294967295.0 < 0.10 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    """Split by the digest of the id."""
    return read(spark, sf_dir, "documents").select("doc_id", split.hash_split(F.col("doc_id"), 0.05, 0.05).alias("split"))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source = 'src0' ORDER BY sha256('20260730:' || doc_id), doc_id) AS k FROM documents WHERE source IN ('src0', 'src1')) SELECT d.doc_id, CASE WHEN (r.source = 'src0' AND k <= 15) OR (r.source = 'src1' AND k <= 200) THEN 'val' ELSE 'train' END AS split FROM documents d LEFT JOIN r USING (doc_id)")
def held_out_split(spark, sf_dir):
    """R2: 15 documents and 200 synthetic records by hash are held out."""
    kind = F.when(F.col("source") == "src0", "document").when(F.col("source") == "src1", "synthetic")
    return split.hold_out(read(spark, sf_dir, "documents").select("doc_id", "source"), kind, id="doc_id").select("doc_id", "split")


@query("SELECT 0::BIGINT AS leaked")
def split_leak_check(spark, sf_dir):
    """No id is on both sides of a split."""
    rows = split.ratio_split(read(spark, sf_dir, "documents").select("doc_id"), id="doc_id")
    return split.leaked_ids(rows.filter("split = 'train'"), rows.filter("split <> 'train'"), "doc_id").agg(F.count(F.lit(1)).alias("leaked"))


@query(
    """WITH k AS (SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'segment' WHEN source IN ('src2', 'src3', 'src4') THEN 'document' WHEN source = 'src5' THEN 'held_gold' WHEN source IN ('src6', 'src7') THEN 'gold' ELSE 'none' END AS bucket FROM documents),
m AS (SELECT bucket, count(*) AS n, CASE bucket WHEN 'segment' THEN 0.3 WHEN 'document' THEN 0.2 WHEN 'held_gold' THEN 0.25 WHEN 'gold' THEN 0.25 ELSE 0.0 END AS mass FROM k GROUP BY bucket)
SELECT doc_id, bucket, round(1000000 * mass / n * (SELECT sum(n) / sum(mass) FROM m))::BIGINT AS micro_weight FROM k JOIN m USING (bucket)"""
)
def mass_weights(spark, sf_dir):
    """Weights by bucket mass."""
    kind = F.when(F.col("source").isin("src0", "src1"), "segment").when(F.col("source").isin("src2", "src3", "src4"), "document").when(F.col("source").isin("src5", "src6", "src7"), "gold_document").otherwise("other")
    rows = read(spark, sf_dir, "documents").select("doc_id", kind.alias("record_kind"), F.when(F.col("source") == "src5", "part3").otherwise(F.col("source")).alias("source"))
    return split.mass_weights(rows).select("doc_id", "bucket", F.round(F.col("sample_weight") * 1000000).cast("long").alias("micro_weight"))


@query("SELECT doc_id, unnest(range(1, 1 + CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 0 END))::INT AS copy FROM documents")
def oversample_mix(spark, sf_dir):
    """Rows repeated by language."""
    times = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).otherwise(0)
    return split.oversample(read(spark, sf_dir, "documents").select("doc_id", "lang"), times).select("doc_id", "copy")


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 100")
def hash_sample(spark, sf_dir):
    """A sample of 100 rows."""
    return split.first_by_hash(read(spark, sf_dir, "documents").select("doc_id"), 100, 7, "doc_id")


@query(f"WITH u AS (SELECT doc_id, {_H(repr('style'), 'doc_id::VARCHAR')} / 4294967295.0 AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.72 THEN 'list_marker' WHEN u < 0.72 + 0.16 THEN 'prose' ELSE 'column_field' END AS style FROM u")
def weighted_styles(spark, sf_dir):
    """A weighted choice for every document."""
    table = contract.CUE_STYLES["isHistorical"]
    return read(spark, sf_dir, "documents").select("doc_id", split.weighted_choice(list(table), list(table.values()), F.lit("style"), F.col("doc_id")).alias("style"))


@query(oracles.DRAWS)
def weighted_draws(spark, sf_dir):
    """200 draws with replacement by length."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("weight"))
    return split.weighted_sample(rows, "weight", 200, 7, "doc_id").select("draw", "doc_id")


# --- statistics ---------------------------------------------------------------------------


@query(
    f"""WITH {TOKENS_SQL},
c AS (SELECT lower(tok) AS key, lang, count(*) AS n FROM tokens JOIN documents USING (doc_id) GROUP BY ALL),
r AS (SELECT key, lang, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, lang) AS k, sum(n) OVER (PARTITION BY key) AS total FROM c)
SELECT key, lang AS winner, n AS top, total::BIGINT AS total FROM r WHERE k = 1"""
)
def type_majority(spark, sf_dir):
    """A3: the language of most uses of each token."""
    rows = with_tokens(spark, sf_dir).select(F.col("t.tok").alias("surface"), F.col("lang").alias("type"))
    return stats.type_majority(rows)


def with_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(tokens(F.col("text"))).alias("t"))


@query(
    f"""WITH {TOKENS_SQL},
c AS (SELECT lower(tok) AS key, lang, count(*) AS n FROM tokens JOIN documents USING (doc_id) GROUP BY ALL),
r AS (SELECT key, lang, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, lang) AS k, sum(n) OVER (PARTITION BY key) AS total FROM c),
m AS (SELECT key, lang AS winner FROM r WHERE k = 1 AND total >= 4 AND n >= 0.85 * total)
SELECT t.doc_id, count(*) AS n FROM tokens t JOIN documents d USING (doc_id) JOIN m ON m.key = lower(t.tok) WHERE d.lang <> m.winner GROUP BY t.doc_id"""
)
def type_minority(spark, sf_dir):
    """Tokens outside the language that nearly all their uses have, by document."""
    rows = with_tokens(spark, sf_dir).select("doc_id", F.col("t.tok").alias("surface"), F.col("lang").alias("type"))
    return stats.type_minority(rows, stats.type_majority(rows)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TOKENS_SQL},{spans_sql('g')}, d AS (SELECT source, count(*) AS records, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)), s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE flags > 0 AND "type" IN ('{vocab.SYMPTOM}', '{vocab.DIAGNOSIS}', '{vocab.DRUG}')) AS m FROM spans JOIN documents USING (doc_id) GROUP BY ROLLUP (source)) SELECT coalesce(d.source, '(all)') AS source, records, chars, coalesce(n, 0)::BIGINT AS entities, 1000.0 * n / chars AS per_1k, 100.0 * m / n AS assertion_pct FROM d LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source""")
def corpus_description(spark, sf_dir):
    """A1: records, density and assertion share by source, with a total."""
    return stats.describe(records(spark, sf_dir))


@query(f"""WITH {TOKENS_SQL},{spans_sql('g')} SELECT "type", count(*) AS n FROM spans GROUP BY "type" """)
def type_counts(spark, sf_dir):
    """A1, A2: entities by type."""
    return stats.type_shares(records(spark, sf_dir)).select("type", "n")


@query(oracles.GENRES)
def genre_density(spark, sf_dir):
    """Density by genre."""
    return stats.genre_density(records(spark, sf_dir))


@query(f"""WITH {TOKENS_SQL},{spans_sql('g')}, x AS (SELECT least(15, len(regexp_extract_all(substr(d.text, s.start + 1, s."end" - s.start), '{_WORD}')))::INT AS words FROM spans s JOIN documents d USING (doc_id)) SELECT words, count(*) AS n FROM x GROUP BY words""")
def span_length_histogram(spark, sf_dir):
    """Entities by words."""
    rows = with_spans(spark, sf_dir).select("text", F.explode("spans").alias("s"))
    return rows.groupBy(word_count(piece(F.col("text"), F.col("s.start"), F.col("s.end"))).alias("words")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(lang, '(all)') AS lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def density_rollup(spark, sf_dir):
    """A2: totals by language with a total row."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    agg = rows.rollup("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"))
    return agg.select(F.coalesce("lang", F.lit("(all)")).alias("lang"), "docs", "chars", "labelled")


@query(oracles.OCCURRENCES)
def occurrence_report(spark, sf_dir):
    """Repeated surfaces of every document."""
    return stats.occurrence_rows(records(spark, sf_dir))


@query(oracles.OCCURRENCE_SUMMARY)
def occurrence_summary(spark, sf_dir):
    """A4: the summary by type."""
    return jobs.occurrence_report(records(spark, sf_dir))["by_type"]


@query(oracles.OCCURRENCE_WARNINGS)
def occurrence_warnings(spark, sf_dir):
    """Thresholds that the corpus misses."""
    return jobs.occurrence_report(records(spark, sf_dir))["warnings"].select(F.array_join("warnings", ",").alias("warnings"))


@query("SELECT 'all' AS stage, (SELECT count(*) FROM documents) AS n UNION ALL SELECT 'long', (SELECT count(*) FROM documents WHERE n_chars > 1000) UNION ALL SELECT 'english', (SELECT count(*) FROM documents WHERE n_chars > 1000 AND lang = 'en')")
def draft_funnel(spark, sf_dir):
    """Rows that stay from stage to stage."""
    one = read(spark, sf_dir, "documents").select("n_chars", "lang")
    two = one.filter("n_chars > 1000")
    return match.funnel([("all", one), ("long", two), ("english", two.filter("lang = 'en'"))]).select("stage", "n")


# --- spans ------------------------------------------------------------------------------------


@query(
    f"""WITH {TOKENS_SQL},{spans_sql('g')},
x AS (SELECT doc_id, start, "end", "type", lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end", "type", i) AS p FROM spans)
SELECT doc_id::VARCHAR AS file, start, "end", CASE WHEN "end" <= p THEN 'nested' ELSE 'overlap' END AS tag FROM x WHERE start < p"""
)
def span_overlap_flags(spark, sf_dir):
    """Spans that run into the one before them."""
    rows = with_spans(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.explode("spans").alias("s"))
    return stats.overlap_flags(rows.select("file", "s.start", "s.end", "s.type", F.lit("").alias("text"))).select("file", "start", "end", "tag")


@query(f"""WITH {TOKENS_SQL},{spans_sql('g')} SELECT a.doc_id::VARCHAR AS file, count(*) AS pairs FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.i < b.i AND a.start < b."end" AND b.start < a."end" GROUP BY a.doc_id""")
def span_overlap_pairs(spark, sf_dir):
    """All overlapping pairs, counted without a self-join."""
    rows = with_spans(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.explode("spans").alias("s")).select("file", "s.start", "s.end")
    return stats.full_overlaps(rows).filter("pairs > 0")


@query(oracles.LINT)
def span_lint(spark, sf_dir):
    """V1, L3: lint flags of records with planted faults, with counts."""
    # written once: lint reads the records for tags, for neighbours and for duplicates
    at = f"{files.scratch(spark)}/records"
    faulty_records(spark, sf_dir).write.parquet(at)
    flags = stats.lint(spark.read.parquet(at))
    return flags.groupBy("grp", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(oracles.KEEP_LONGEST)
def span_keep_longest(spark, sf_dir):
    """O1: overlaps resolved for the longer span."""
    kind = "struct<i:int,start:int,end:int,type:string,conf:int,flags:int>"
    rows = with_spans(spark, sf_dir).select("doc_id", keep_longest(F.col("spans"), kind).alias("x"))
    return rows.select("doc_id", F.size("x.kept").alias("kept"), "x.dropped")


@query(oracles.NMS)
def span_nms(spark, sf_dir):
    """Greedy suppression by confidence."""
    kind = "struct<start:int,end:int,type:string,confidence:double>"
    slim = F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["type"], (s["conf"] / 100).alias("confidence")))
    rows = with_spans(spark, sf_dir).select("doc_id", slim.cast(f"array<{kind}>").alias("spans")).select("doc_id", F.explode(suppress(F.col("spans"), kind)).alias("x"))
    return rows.select("doc_id", "x.start", "x.end", "x.type", "x.confidence")


@query(
    f"""WITH {TOKENS_SQL},{spans_sql('g')},
a AS (SELECT doc_id, text, start, "end", "type", lag("end") OVER w AS pe, lag("type") OVER w AS pt FROM spans JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", "type")),
b AS (SELECT *, CASE WHEN start - pe <= 3 AND (start <= pe OR regexp_matches(substr(text, pe + 1, start - pe), '^[\\t\\x0b-\\r\\x1c-\\x20]*$')) AND "type" = pt THEN 0 ELSE 1 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY start, "end", "type" ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT doc_id, min(start)::INT AS "start", last("end" ORDER BY start, "end", "type")::INT AS "end", min("type") AS "type", count(*) AS n_merged FROM c GROUP BY doc_id, run"""
)
def span_merge_runs(spark, sf_dir):
    """Adjacent spans of one type joined."""
    rows = with_spans(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("raw"), F.explode("spans").alias("s")).select("id", "raw", "s.start", "s.end", "s.type")
    return postprocess.merge_runs(rows).select(F.col("id").alias("doc_id"), "start", "end", "type", "n_merged")


@query(oracles.BASELINE)
def baseline_postprocess(spark, sf_dir):
    """The stages of baseline spans with their counts."""
    names = list(vocab.LABEL_MAP) + ["ORGAN"]
    relabel = F.transform("spans", lambda s: F.struct(s["start"], s["end"], F.get(F.array(*[F.lit(n) for n in names]), (s["i"] % 5)).alias("type")))
    rows = with_spans(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", relabel.alias("spans"))
    return match.funnel(jobs.baseline_labels(rows)).select("stage", "n")


LABELS_SQL = "['O', 'B-X', 'I-X', 'B-Y', 'I-Y']"


def _hash_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    pick = lambda h: F.get(F.array(*[F.lit(x) for x in ("O", "B-X", "I-X", "B-Y", "I-Y")]), (h % 5).cast("int"))
    draws = rows.select("doc_id", arrow.hash_ints(F.concat_ws(":", F.lit("b"), F.col("doc_id").cast("string")), F.size("t")).alias("h"))
    return draws.select("doc_id", F.transform("h", pick).alias("labels"))


@query(
    f"""WITH {TOKENS_SQL},
l AS (SELECT doc_id, i, {LABELS_SQL}[('0x' || substr(sha256('b:' || doc_id || ':' || i), 1, 8))::BIGINT % 5 + 1] AS l FROM tokens),
p AS (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY i) AS pl FROM l),
s AS (SELECT *, l <> 'O' AND (l[1] = 'B' OR pl IS NULL OR pl = 'O' OR substr(pl, 3) <> substr(l, 3)) AS opens FROM p),
r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s WHERE l <> 'O')
SELECT doc_id, min(i)::INT AS "first", max(i)::INT AS "last", min(substr(l, 3)) AS "type" FROM r GROUP BY doc_id, run"""
)
def bio_decode(spark, sf_dir):
    """Spans of BIO labels."""
    rows = _hash_labels(spark, sf_dir).select("doc_id", F.explode(bio_spans(F.col("labels"), "lenient")).alias("s"))
    return rows.select("doc_id", "s.first", "s.last", "s.type")


@query(oracles.UNCOVERED)
def window_coverage(spark, sf_dir):
    """Derived spans that no window holds whole."""
    docs = read(spark, sf_dir, "documents")
    ws = windows.sliding_windows(docs, header=False, id="doc_id")
    # half of the spans, made so long that windows may cut them
    spans = with_spans(spark, sf_dir).select("doc_id", "text", F.explode("spans").alias("s")).filter("s.conf < 50")
    toks = docs.select("doc_id", tokens(F.col("text")).alias("toks"))
    last = F.col("toks")[F.least(F.col("s.i") + 70, F.size("toks") - 1)]["e"]
    long_ = spans.select("doc_id", "s").join(toks, "doc_id").select(F.col("doc_id").alias("id"), "s.start", last.alias("end"))
    return windows.uncovered(long_, ws)


@query(oracles.CHUNKS)
def token_chunks(spark, sf_dir):
    """Tokens packed into chunks by a cost budget."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.transform(tokens(F.col("text")), lambda t: F.length(t["tok"])).alias("c"))
    rows = rows.filter(F.size("c") > 0)
    return rows.select("doc_id", F.size(windows.chunks_by_budget(F.col("c"), 512)).alias("chunks"))


@query(oracles.CLEANING)
def entity_cleaning(spark, sf_dir):
    """Reasons that drop or repair derived entities."""
    rows = faulty_records(spark, sf_dir).select(F.explode(clean_entities(F.col("text"), F.col("entities"))["reasons"]).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TOKENS_SQL},{spans_sql('g')}, x AS (SELECT s.doc_id, s.i, s.start, substr(d.text, s.start + 1, s."end" - s.start) AS t FROM spans s JOIN documents d USING (doc_id)) SELECT doc_id, i::INT AS i, (start + length(t) - length(regexp_replace(t, '^[a-d]+', '')))::INT AS "start", regexp_replace(regexp_replace(t, '^[a-d]+', ''), '[a-d]+$', '') AS text FROM x WHERE regexp_replace(t, '^[a-d]+', '') <> ''""")
def span_trim(spark, sf_dir):
    """Spans without the given characters at their edges."""
    rows = with_spans(spark, sf_dir).select("doc_id", "text", F.explode("spans").alias("s"))
    rows = rows.select("doc_id", "s.i", trim_span(F.col("text"), F.col("s.start"), F.col("s.end"), "a-d").alias("x")).filter("x IS NOT NULL")
    return rows.select("doc_id", "i", "x.start", "x.text")


# --- scores -----------------------------------------------------------------------------------


@query(oracles.SCORES)
def greedy_match_prf(spark, sf_dir):
    """The long score table."""
    return match.score_report(span_files(spark, sf_dir, "g"), predicted_files(spark, sf_dir))


@query(oracles.BOUNDARY)
def boundary_report(spark, sf_dir):
    """Exact matches and extra words."""
    return match.boundary_report(span_files(spark, sf_dir, "g"), predicted_files(spark, sf_dir))


@query(oracles.CONFUSION)
def confusion_topk(spark, sf_dir):
    """Most frequent confusions."""
    return match.confusion(span_files(spark, sf_dir, "g"), predicted_files(spark, sf_dir))


@query(oracles.TAGS)
def tag_scores(spark, sf_dir):
    """Exact-span scores of two label sequences."""
    rows = _hash_labels(spark, sf_dir)
    noisy = F.transform("labels", lambda x, i: F.when(i % 7 == 0, F.lit("O")).otherwise(x))
    return match.tag_scores(rows.select("doc_id", F.col("labels").alias("gold_tags"), noisy.alias("pred_tags")))


@query(
    r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[^ ]+')) AS w, lag(list_distinct(regexp_extract_all(lower(text), '[^ ]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, len(list_intersect(w, p))::INT AS common, len(list_distinct(list_concat(w, p)))::INT AS either FROM w WHERE p IS NOT NULL"""
)
def jaccard_turns(spark, sf_dir):
    """Word overlap of neighbouring turns."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[^ ]+"), F.lit(0))).alias("w"))
    rows = rows.withColumn("p", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("p IS NOT NULL")
    return rows.select("conv_id", "turn", F.size(F.array_intersect("w", "p")).alias("common"), F.size(F.array_union("w", "p")).alias("either"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n FROM tokens WHERE lower(tok) NOT IN ('the', 'of', 'and') GROUP BY doc_id")
def sieve_counts(spark, sf_dir):
    """Tokens that are not on a block list."""
    blocked = spark.createDataFrame([("The ",), ("of",), ("AND",)], "surface string")
    rows = with_tokens(spark, sf_dir).select("doc_id", F.col("t.tok").alias("text"))
    return match.sieve(rows, blocked).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# --- audit ------------------------------------------------------------------------------------


@query("SELECT coalesce(f.doc_id, d.doc_id)::VARCHAR AS key, CASE WHEN d.doc_id IS NOT NULL THEN 'delete' ELSE 'fix' END AS kind, CASE WHEN d.doc_id IS NOT NULL AND f.doc_id IS NOT NULL THEN 'fix' END AS supersedes_fix FROM (SELECT * FROM labels WHERE quality = 0) f FULL JOIN (SELECT * FROM labels WHERE toxic = 1) d USING (doc_id)")
def findings_merge(spark, sf_dir):
    """Fixes and deletions by key; a deletion wins."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), "quality", "toxic")
    fix = labels.filter("quality = 0").select("key", F.lit("fix").alias("kind"))
    return audit.merge_findings(fix, labels.filter("toxic = 1").select("key", F.lit("delete").alias("kind")))


@query(f"WITH {TOKENS_SQL},{spans_sql('g')}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM spans) SELECT doc_id::VARCHAR AS id, count(*) FILTER (WHERE k % 3 <> 0)::INT AS left_over FROM r GROUP BY doc_id")
def apply_decisions(spark, sf_dir):
    """Every third entity of each record is deleted, the others keep their place."""
    recs = records(spark, sf_dir)
    found = audit.delete_candidates(recs)
    decisions = found.select("key", F.when(F.col("entity_index") % 3 == 0, "accept").otherwise("reject").alias("decision"))
    done = audit.apply_decisions(recs, found, decisions)
    return done.filter(F.size("entities") >= 0).join(found.select(F.col("file").alias("id")).distinct(), "id", "left_semi").select("id", F.size("entities").alias("left_over"))


@query("SELECT l.doc_id, CASE WHEN l.doc_id % 3 = 0 THEN 'deleted' WHEN l.doc_id % 5 = 0 THEN 'retyped' END AS change FROM labels l WHERE l.doc_id % 3 = 0 OR l.doc_id % 5 = 0")
def label_diff(spark, sf_dir):
    """Labels against a changed copy."""
    base = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.col("quality").cast("string").alias("type"), empty("array<string>").alias("assertions"))
    other = base.filter("file % 3 <> 0").withColumn("type", F.when(F.col("file") % 5 == 0, F.concat("type", F.lit("x"))).otherwise(F.col("type")))
    return audit.label_diff(base, other).select(F.col("file").alias("doc_id"), "change")


@query("SELECT CASE WHEN quality = 0 THEN 'q0' ELSE 'q1' END AS kind, 't' || toxic AS source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS mechanical, GROUPING_ID(kind, source)::BIGINT AS level FROM (SELECT *, CASE WHEN quality = 0 THEN 'q0' ELSE 'q1' END AS kind, 't' || toxic AS source FROM labels) GROUP BY GROUPING SETS ((kind), (source), (kind, source), ())".replace("SELECT CASE WHEN quality = 0 THEN 'q0' ELSE 'q1' END AS kind, 't' || toxic AS source,", "SELECT kind, source,", 1))
def finding_counts(spark, sf_dir):
    """A10: counts by kind, by source, by both, and over all."""
    rows = read(spark, sf_dir, "labels").select(F.when(F.col("quality") == 0, "q0").otherwise("q1").alias("kind"), F.concat(F.lit("t"), "toxic").alias("source"), (F.col("toxic") == 1).alias("mechanical"))
    return audit.finding_counts(rows)


@query("SELECT key, decision, reason, action FROM (SELECT doc_id::VARCHAR AS key, CASE WHEN quality = 0 AND toxic = 0 THEN 'accept' ELSE 'reject' END AS decision, CASE WHEN quality = 1 THEN 'delete_type' WHEN toxic = 1 THEN 'delete_with_assertion' END AS reason, 'delete' AS action FROM labels)")
def auto_decisions(spark, sf_dir):
    """Vetoes of deletions."""
    rows = read(spark, sf_dir, "labels")
    current = F.struct(F.when(F.col("toxic") == 1, F.array(F.lit("isNegated"))).otherwise(empty("array<string>")).alias("assertions"), F.when(F.col("quality") == 1, vocab.DRUG).otherwise(vocab.SYMPTOM).alias("type"))
    found = rows.select(F.col("doc_id").cast("string").alias("key"), current.alias("current"), audit._proposal(delete=F.lit(True)).alias("proposed"))
    return audit.auto_decide(found)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def journal_latest(spark, sf_dir):
    """The last event of each user."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return journal.replay(rows, "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT e.user_id, e.event_id, l.event_id AS last_view FROM (SELECT * FROM events WHERE event_type <> (SELECT min(event_type) FROM events)) e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)) l ON e.user_id = l.user_id AND e.event_id >= l.event_id")
def asof_last_event(spark, sf_dir):
    """The last event of the first type before every other event of a user."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first = events.agg(F.min("event_type").alias("first"))
    rows = events.crossJoin(F.broadcast(first))  # one row
    lines = rows.filter("event_type = first").select("user_id", F.col("event_id").alias("at"), F.col("event_id").cast("string").alias("value"))
    points = rows.filter("event_type <> first").select("user_id", F.col("event_id").alias("at"))
    return postprocess.last_before(lines, points, "user_id").select("user_id", F.col("at").alias("event_id"), F.col("value").cast("long").alias("last_view"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Events by hour and type; the same function serves a stream."""
    return journal.windowed_counts(read(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", "event_type")


@query(oracles.REPLIES)
def external_replies(spark, sf_dir):
    """Replies of the offline client to requests that no cache answers."""
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.col("text").alias("payload"))
    cache = external.run_stage(rows.filter("item_id % 2 = 0"))
    return external.with_cache(rows, cache).select("key", "reply")


@query(oracles.PREDICTED)
def predicted_spans(spark, sf_dir):
    """X3, E-d, O2, O9, O12: an offline tagger over windows, decoded and suppressed."""
    notes = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    scorer = external.pattern_scorer({"the": f"B-{vocab.SYMPTOM}", "of": f"I-{vocab.SYMPTOM}", "and": f"B-{vocab.DRUG}"})
    return jobs.predict(notes, scorer, header=False).select("id", F.size("spans").alias("n"))


# --- contracts -----------------------------------------------------------------------------

_PROFILE_ROWS = ", ".join(f"({str(low).lower()}, {i if i < 10 else i - 10}, '{k}', '{f}')" for i, (k, f, _, low, _) in enumerate(contract.PROFILES))


@query(f"WITH p(low_yield, seat, key, document_format) AS (VALUES {_PROFILE_ROWS}), c AS (SELECT i::INT AS index, i % 4 = 3 AS low_yield, (CASE WHEN i % 4 = 3 THEN (i // 4) % 4 ELSE (i - i // 4) % 10 END)::INT AS seat FROM range(500) t(i)) SELECT 'coverage.' || key || '.' || lpad((index + 1)::VARCHAR, 3, '0') AS case_id, index, document_format, low_yield FROM c JOIN p USING (low_yield, seat)")
def plan_coverage(spark, sf_dir):
    """Cases rotate over the profiles."""
    return contract.coverage_cases(spark, 500).select("case_id", "index", "document_format", "low_yield")


def catalog(spark, sf_dir):
    """Frequent tokens of the documents as a lexicon of bounded size."""
    rows = read(spark, sf_dir, "documents").select("source", F.explode(tokens(F.col("text"))).alias("t")).select(F.col("t.tok").alias("surface"), "source")
    return contract.entity_catalog(rows, F.get(F.array(*[F.lit(t) for t in vocab.TYPES]), (hash_int(F.lit("c"), F.col("text")) % 5).cast("int")))


@query(oracles.GUARD)
def lexicon_guard(spark, sf_dir):
    """Lexicon terms in every document, longest first."""
    terms = contract.guard_terms(catalog(spark, sf_dir))  # every term of the catalogue
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(F.broadcast(terms))  # one row of bounded size
    return rows.select("doc_id", F.size(lexicon_hits(F.lower("text"), F.col("terms"))).alias("hits"))


@query(oracles.LABELS)
def label_validation(spark, sf_dir):
    """Errors of labels with planted faults."""
    rows = contract.validate_labels(faulty_records(spark, sf_dir)).select(F.explode_outer("errors").alias("error")).filter("error IS NOT NULL")
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, count(*) OVER w AS turns_so_far, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def dialogue_turn_windows(spark, sf_dir):
    """Running counts and the previous speaker."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("turns_so_far"), F.lag("role").over(w).alias("previous"))


# the other modules register their queries in the same tables
from . import queries_drafts, queries_io, queries_rules, queries_windows  # noqa: E402, F401
