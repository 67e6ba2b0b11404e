"""Registered queries of section windows, training rows and scores whose SQL needs folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracles
from .functions.core import hash_int
from .functions.spans import any_flag, bio_spans, clean_entities, negative_spans
from .operators import match, split, windows
from .oracles import GOLD_SQL, TOK, TOKENS_SQL, WS, hashed, listed
from .plans import jobs
from .queries import query, read, records
from .sources import files

# --- section windows


def packed_sql(items: str, name: str, most: int = windows.LINE_SIZE) -> str:
    """Adjacent items (g, j from 1, n) of a group joined greedily while they fit; p numbers the packs."""
    return f"""
{name} AS (
  SELECT g, j, n AS cur, 0 AS p FROM {items} WHERE j = 1
  UNION ALL
  SELECT i.g, i.j, CASE WHEN w.cur > 0 AND w.cur + i.n > {most} THEN i.n ELSE w.cur + i.n END, w.p + (w.cur > 0 AND w.cur + i.n > {most})::INT
  FROM {name} w JOIN {items} i ON i.g = w.g AND i.j = w.j + 1)"""


_MOST = windows.LINE_SIZE
SECTION_SQL = rf"""{TOKENS_SQL},
ln0 AS (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents),
ln1 AS (SELECT doc_id, unnest(v) AS line, unnest(range(1, len(v) + 1)) AS l FROM ln0),
ln AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_, regexp_matches(line, '^[{WS}]*\p{{Nd}}+[{WS}]*[.)]') AS opens FROM ln1),
sec AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY l) AS sec FROM ln),
tl AS (SELECT t.doc_id, t.i, t.tok, t.e - t.n AS s, t.e, c.l, c.sec, c.opens FROM tokens t ASOF JOIN sec c ON t.doc_id = c.doc_id AND t.e - t.n >= c.at_),
lines_n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, l) AS ln_n, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) - 1 AS k FROM tl),
sa AS (SELECT *, CASE WHEN ln_n > {_MOST} THEN coalesce(sum((tok IN ({listed(windows.SENTENCE_ENDS)}))::INT) OVER (PARTITION BY doc_id, l ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS sent FROM lines_n),
ia AS (SELECT doc_id || ':' || l AS g, sent, row_number() OVER (PARTITION BY doc_id, l ORDER BY sent) AS j, count(*) AS n FROM sa WHERE ln_n > {_MOST} GROUP BY doc_id, l, sent),{packed_sql('ia', 'pa')},
sb AS (SELECT x.*, coalesce(p.p, 0) AS ga FROM sa x LEFT JOIN ia a ON a.g = x.doc_id || ':' || x.l AND a.sent = x.sent LEFT JOIN pa p ON p.g = a.g AND p.j = a.j),
sb2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, l, ga) AS na FROM sb),
sc AS (SELECT *, CASE WHEN na > {_MOST} THEN coalesce(sum((tok IN ({listed(windows.SOFT_ENDS)}))::INT) OVER (PARTITION BY doc_id, l, ga ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS clause FROM sb2),
ib AS (SELECT doc_id || ':' || l || ':' || ga AS g, clause, row_number() OVER (PARTITION BY doc_id, l, ga ORDER BY clause) AS j, count(*) AS n FROM sc WHERE na > {_MOST} GROUP BY doc_id, l, ga, clause),{packed_sql('ib', 'pb')},
sd AS (SELECT x.*, coalesce(p.p, 0) AS gb FROM sc x LEFT JOIN ib b ON b.g = x.doc_id || ':' || x.l || ':' || x.ga AND b.clause = x.clause LEFT JOIN pb p ON p.g = b.g AND p.j = b.j),
se AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, l, ga, gb ORDER BY i) - 1) // {_MOST} AS hard FROM sd),
un AS (SELECT doc_id, sec, l, ga, gb, hard, min(i) AS first, count(*) AS n FROM se GROUP BY ALL),
iu AS (SELECT *, doc_id || ':' || sec AS g, row_number() OVER (PARTITION BY doc_id, sec ORDER BY first) AS j FROM un),{packed_sql('iu', 'pu')},
heads AS (SELECT doc_id, sec, arg_min(opens, l) AS opens, arg_min(n, l) AS n FROM (SELECT c.doc_id, c.sec, c.l, c.opens, count(t.i) AS n FROM sec c LEFT JOIN tl t ON t.doc_id = c.doc_id AND t.l = c.l GROUP BY ALL) GROUP BY doc_id, sec),
win0 AS (SELECT u.doc_id, u.sec, p.p, min(u.first) AS first, sum(u.n) AS n FROM iu u JOIN pu p ON p.g = u.g AND p.j = u.j GROUP BY ALL),
win AS (
  SELECT w.doc_id, (row_number() OVER (PARTITION BY w.doc_id ORDER BY w.sec, w.p) - 1)::INT AS w, w.first, w.n::INT AS n_content,
    CASE WHEN w.p > 0 AND h.opens AND h.n <= {_MOST} THEN h.n ELSE 0 END::INT AS n_prefix
  FROM win0 w JOIN heads h ON h.doc_id = w.doc_id AND h.sec = w.sec)"""


@query(f"WITH RECURSIVE {SECTION_SQL} SELECT win.doc_id, w, n_content, n_prefix, (t.e - t.n)::INT AS char_start FROM win JOIN tokens t ON t.doc_id = win.doc_id AND t.i = win.first")
def section_window_cuts(spark, sf_dir):
    """Where every section window begins, its tokens and the header's that it carries."""
    ws = windows.section_windows(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return ws.select(F.col("id").alias("doc_id"), "w", F.size("content").alias("n_content"), F.size("prefix").alias("n_prefix"), F.col("content")[0]["s"].alias("char_start"))


_KEPT = """
kl0 AS (SELECT doc_id, s, e, t, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, k) AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, t ORDER BY k) AS copy FROM gold) WHERE copy = 1 AND NOT contains(x, chr(10))),
kl AS (
  SELECT doc_id, r, s AS ls, e AS le, true AS took, false AS clash FROM kl0 WHERE r = 1
  UNION ALL
  SELECT n.doc_id, n.r, CASE WHEN n.s >= w.le OR n.e - n.s > w.le - w.ls THEN n.s ELSE w.ls END, CASE WHEN n.s >= w.le OR n.e - n.s > w.le - w.ls THEN n.e ELSE w.le END, n.s >= w.le OR n.e - n.s > w.le - w.ls, n.s < w.le
  FROM kl w JOIN kl0 n ON n.doc_id = w.doc_id AND n.r = w.r + 1),
kept AS (SELECT k.doc_id, k.s, k.e, k.t FROM (SELECT *, lead(clash) OVER (PARTITION BY doc_id ORDER BY r) AS beaten FROM kl WHERE took) l JOIN kl0 k ON k.doc_id = l.doc_id AND k.r = l.r WHERE NOT coalesce(beaten, false))"""


@query(
    f"""WITH RECURSIVE {SECTION_SQL},{GOLD_SQL.removeprefix(TOKENS_SQL).lstrip(',')},{_KEPT},
inside AS (SELECT w.doc_id, w.w, k.s, count(*) AS n FROM win w JOIN kept k ON k.doc_id = w.doc_id JOIN tokens t ON t.doc_id = w.doc_id AND t.i >= w.first AND t.i < w.first + w.n_content AND t.e - t.n >= k.s AND t.e <= k.e GROUP BY ALL),
b AS (SELECT doc_id, w, count(*) AS spans, sum(n) AS tagged FROM inside GROUP BY ALL)
SELECT win.doc_id::VARCHAR AS id, win.w, (n_content + n_prefix)::INT AS n_tokens, n_prefix, coalesce(spans, 0)::INT AS spans, coalesce(tagged, 0)::INT AS tagged FROM win LEFT JOIN b USING (doc_id, w)"""
)
def bio_rows_v1(spark, sf_dir):
    """Training rows of section windows: tokens, prefix, entities and tagged tokens."""
    clean = records(spark, sf_dir)
    clean = clean.withColumn("entities", clean_entities(F.col("text"), F.col("entities"))["entities"])
    rows = windows.training_rows_v1(clean)
    count = lambda c: F.size(F.filter("ner_tags", c))
    return rows.select("id", "w", F.size("tokens").alias("n_tokens"), "n_prefix", count(lambda t: t.startswith("B-")).alias("spans"), count(lambda t: t != "O").alias("tagged"))


# --- training rows of overlapping windows

_U = lambda *p: f"{hashed(*p)} / 4294967295.0"
_SEP = "chr(31)"
ROWS_SQL = rf"""{GOLD_SQL},
cnt AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
w0 AS (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 180) / 135.0))::INT + 1))::INT AS w FROM cnt),
w1 AS (SELECT w0.doc_id, w0.w, w0.w * 135 AS a, least(w0.n, w0.w * 135 + 180) AS b, least(32, w0.w * 135) AS bare, t.e - t.n AS char_start FROM w0 JOIN tokens t ON t.doc_id = w0.doc_id AND t.i = w0.w * 135),
w2 AS (SELECT w1.*, list_filter(string_split_regex(substr(d.text, 1, char_start), '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'), lambda y: regexp_matches(y, '^[{WS}]*(?:\p{{Nd}}+[{WS}]*[.)]|[A-ZÀ-Ỹ][^.!?]{{0,80}}:?[{WS}]*$)')) AS titles FROM w1 JOIN documents d USING (doc_id)),
w3 AS (SELECT *, CASE WHEN len(titles) > 0 THEN regexp_extract_all(titles[-1], '{TOK}') ELSE [] END AS head FROM w2),
w4 AS (SELECT w3.*, string_agg(t.tok, {_SEP} ORDER BY t.i) AS seen FROM w3 JOIN tokens t ON t.doc_id = w3.doc_id AND t.i >= w3.a - w3.bare AND t.i < w3.b GROUP BY ALL),
w5 AS (SELECT *, bare + CASE WHEN len(head) = 0 OR contains({_SEP} || seen || {_SEP}, {_SEP} || array_to_string(head, {_SEP}) || {_SEP}) OR {_U("'7'", 'doc_id', 'w', "'header'")} < 0.35 THEN 0 ELSE len(head) END AS n_prefix FROM w4),
placed AS (SELECT g.doc_id, x.i AS i, y.i AS j, g.k FROM gold g JOIN tokens x ON x.doc_id = g.doc_id AND x.e - x.n = g.s JOIN tokens y ON y.doc_id = g.doc_id AND y.e = g.e),
own AS (SELECT w.doc_id, w.w, p.k, p.i, p.j FROM w5 w JOIN placed p ON p.doc_id = w.doc_id AND p.i >= w.a AND p.j < w.b),
n_own AS (SELECT doc_id, w, count(*) AS n FROM own GROUP BY ALL),
kept_w AS (SELECT w5.*, coalesce(n_own.n, 0) AS n_own FROM w5 LEFT JOIN n_own USING (doc_id, w) WHERE coalesce(n_own.n, 0) > 0 OR {_U("'7'", 'doc_id', 'w', "'empty'")} < 0.5),
tag AS (SELECT k.doc_id, k.w, t.i, EXISTS (SELECT 1 FROM own o WHERE o.doc_id = k.doc_id AND o.w = k.w AND o.i <= t.i AND t.i <= o.j) AS tagged, {_U("'7'", 'k.doc_id', 'k.w', '(t.i - k.a)')} < 0.35 AS drawn FROM kept_w k JOIN tokens t ON t.doc_id = k.doc_id AND t.i >= k.a AND t.i < k.b),
sums AS (SELECT doc_id, w, count(*) FILTER (WHERE tagged) AS tagged, count(*) FILTER (WHERE tagged OR drawn) AS counted FROM tag GROUP BY ALL),
marks_ AS (SELECT doc_id, w, -1 AS p FROM kept_w UNION ALL SELECT k.doc_id, k.w, (t.i - k.a + k.n_prefix) FROM kept_w k JOIN tag t ON t.doc_id = k.doc_id AND t.w = k.w WHERE t.tagged UNION ALL SELECT doc_id, w, n_prefix + b - a FROM kept_w),
gaps AS (SELECT doc_id, w, lead(p) OVER (PARTITION BY doc_id, w ORDER BY p) - p - 1 AS g FROM marks_),
free AS (SELECT doc_id, w, sum(greatest(0, g) + greatest(0, g - 1) + greatest(0, g - 2) + greatest(0, g - 3) + greatest(0, g - 4)) AS n FROM gaps GROUP BY ALL)"""


@query(
    f"""WITH {ROWS_SQL}
SELECT k.doc_id || '#' || k.w AS id, (k.n_prefix + k.b - k.a)::INT AS n_tokens, k.n_prefix::INT AS n_prefix, s.tagged::INT AS tagged, s.counted::INT AS counted, k.n_own::INT AS n_spans, least(greatest(2, 2 * k.n_own), f.n)::INT AS negatives
FROM kept_w k JOIN sums s USING (doc_id, w) JOIN free f USING (doc_id, w)"""
)
def bio_rows(spark, sf_dir):
    """Training rows of windows, with their tag and loss counts and drawn negative spans."""
    rows = windows.training_rows(records(spark, sf_dir), words=False)
    places = F.transform("spans", lambda s: F.struct(s["start"].alias("first"), s["end"].alias("last")))
    others = lambda c, x: F.size(F.array_remove(c, x))
    slim = rows.select("id", F.size("token_loss_mask").alias("n_tokens"), "n_prefix", others("ner_tags", "O").alias("tagged"), others("token_loss_mask", 0).alias("counted"), places.alias("places"))
    slim = files.written(slim)  # Spark fails to take the draws out of a plan that holds the windows' expressions in their arguments
    slim = slim.withColumn("n_spans", F.size("places")).withColumn("negatives", F.size(negative_spans(F.col("n_tokens"), F.col("places"), F.col("id"))))
    return slim.select("id", "n_tokens", "n_prefix", "tagged", "counted", "n_spans", "negatives")


_PART = f"CASE WHEN {hashed('doc_id::VARCHAR')} / 4294967295.0 < 0.05 THEN 'test' WHEN {hashed('doc_id::VARCHAR')} / 4294967295.0 < 0.1 THEN 'val' ELSE 'train' END"


@query(f"WITH {ROWS_SQL} SELECT {_PART} AS split, count(DISTINCT doc_id) AS records, count(*) AS windows, sum(n_own)::BIGINT AS entities FROM kept_w GROUP BY 1")
def window_corpus_splits(spark, sf_dir):
    """E-b, A7: the windowed corpus of all records by split."""
    rows = records(spark, sf_dir).withColumn("split", split.hash_split(F.col("id")))
    return jobs.split_report(jobs.window_corpus(rows))


# --- decoded flags and scores

_FLAG = hashed("'f'", "doc_id", "i")


@query(
    f"""WITH {TOKENS_SQL},{oracles._runs(oracles._LABEL, 'g')}, f AS (SELECT doc_id, i, {_FLAG} % 10 = 0 AS flagged FROM tokens)
SELECT g.doc_id, g.a::INT AS "first", g.b::INT AS "last", g.t AS "type", bool_or(f.flagged) AS flagged FROM g JOIN f ON f.doc_id = g.doc_id AND f.i BETWEEN g.a AND g.b GROUP BY ALL"""
)
def flagged_spans(spark, sf_dir):
    """Spans of BIO labels that a flag reaches when any of its tokens has it."""
    from .queries import _hash_labels

    rows = _hash_labels(spark, sf_dir)
    flags = F.transform("labels", lambda x, i: F.when(hash_int(F.lit("f"), F.col("doc_id"), i) % 10 == 0, 0.5).otherwise(0.25))
    rows = rows.select("doc_id", "labels", flags.alias("flags")).select("doc_id", "flags", F.explode(bio_spans(F.col("labels"), "lenient")).alias("s"))
    return rows.select("doc_id", "s.first", "s.last", "s.type", any_flag(F.col("flags"), F.col("s.first"), F.col("s.last")).alias("flagged"))


def word_errors_sql(pairs: str) -> str:
    """The edit distance of word lists ref and hyp of each pair (key): one row of the table for each word of ref."""
    cell = "list_append(acc, least(acc[-1] + 1, prev[b[1] + 1] + 1, prev[b[1]] + CASE WHEN hyp[b[1]] = ref[i] THEN 0 ELSE 1 END))"
    return f"""
lev AS (
  SELECT key, ref, hyp, 0 AS i, range(0, len(hyp) + 1) AS prev FROM {pairs}
  UNION ALL
  SELECT key, ref, hyp, i, list_reduce(list_prepend([prev[1] + 1], list_transform(range(1, len(hyp) + 1), lambda j: [j])), lambda acc, b: {cell}) AS prev
  FROM (SELECT key, ref, hyp, i + 1 AS i, prev FROM lev WHERE i < len(ref))),
dist AS (SELECT key, prev[-1] AS errors, len(ref) AS n FROM lev WHERE i = len(ref))"""


@query(
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ ]+') AS w, lag(regexp_extract_all(text, '[^ ]+')) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
prs AS (SELECT conv_id || ':' || turn AS key, p AS ref, w AS hyp FROM t WHERE p IS NOT NULL AND len(w) > 0 AND len(p) > 0),{word_errors_sql('prs')}
SELECT t.conv_id, t.turn, errors::INT AS errors FROM dist JOIN t ON t.conv_id || ':' || t.turn = key"""
)
def wer_turns(spark, sf_dir):
    """Word errors between neighbouring turns."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("w"))
    rows = rows.withColumn("p", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("p IS NOT NULL").filter((F.size("w") > 0) & (F.size("p") > 0))
    return rows.select("conv_id", "turn", match.word_errors(F.col("p"), F.col("w")).alias("errors"))


_JACCARD = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


@query(
    f"""WITH RECURSIVE t AS (SELECT conv_id || ':' || turn AS key, regexp_extract_all(text, '[^{WS}]+') AS w, [role] AS r, string_split(text, ' ')[1:3] AS c, lag(regexp_extract_all(text, '[^{WS}]+')) OVER q AS pw, lag([role]) OVER q AS pr, lag(string_split(text, ' ')[1:3]) OVER q AS pc
  FROM conversations WINDOW q AS (PARTITION BY conv_id ORDER BY turn)),
prs AS (SELECT key, w AS ref, pw AS hyp FROM t WHERE pw IS NOT NULL),{word_errors_sql('prs')},
z AS (SELECT greatest(0.0, 1 - coalesce(errors::DOUBLE / nullif(n, 0), 0.0)) AS text, {_JACCARD('r', 'pr')} AS a, {_JACCARD('c', 'pc')} AS c, len(t.c) + 1 AS w FROM dist JOIN t USING (key)),
m AS (SELECT avg(text) AS text, avg(a) AS assertion, sum(c * w) / sum(w) AS candidate FROM z)
SELECT round(text, 9) AS text, round(assertion, 9) AS assertion, round(candidate, 9) AS candidate, round(0.3 * text + 0.3 * assertion + 0.4 * candidate, 9) AS score FROM m"""
)
def official_score(spark, sf_dir):
    """The three-part score of neighbouring turns taken as entities, to nine places."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array("role").alias("r"), F.slice(F.split("text", " "), 1, 3).alias("c"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = rows.select(F.col("text").alias("ref"), F.lag("text").over(w).alias("hyp"), F.col("r").alias("gold_assertions"), F.lag("r").over(w).alias("pred_assertions"), F.col("c").alias("gold_candidates"), F.lag("c").over(w).alias("pred_candidates"))
    found = match.official_score(pairs.filter("hyp IS NOT NULL"))
    return found.select(*[F.round(c, 9).alias(c) for c in ("text", "assertion", "candidate", "score")])

