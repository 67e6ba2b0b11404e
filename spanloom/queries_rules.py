"""Registered queries of rules over clinical notes that are built from fixed sentences.

The driver's tables hold no clinical text, so cues, headings and faults would never
occur in them. Every note is one of ``SENTENCES`` and the name of a nation; both engines
build them from the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cues, spans, vocab
from .functions.core import empty
from .functions.text import context, genre, has_table, headings, leading_negation, measurements, natural_heading, nearest_header, nearest_heading
from .operators import audit, contract, postprocess, split
from .oracles import BEARING, TYPE_LIST, WS, chosen, conflict_sql, hashed, listed, support_sql
from .plans import jobs
from .queries import query, read

SYM, DX, TEST, RES, DRUG = vocab.TYPES

# Sentences as (before, entity, after, what the label says, type, assertions, evidence).
SENTENCES = (
    ("Bệnh nhân không ", "ho khan", " trong tuần này.", "ho khan", SYM, (), "không ho khan"),
    ("Bệnh nhân không ", "ho khan", ".", "ho khan", SYM, ("isNegated",), "ho khan"),
    ("Bệnh nhân đau, ", "sốt cao", " từ sáng; sốt cao từng cơn.", "sốt cao", SYM, ("isNegated",), "sốt cao"),
    ("Tiền sử ", "đái tháo đường", " nhiều năm.", "đái tháo đường", DX, ("isHistorical",), "Tiền sử đái tháo đường … nhiều năm"),
    ("Tiền sử ", "đái tháo đường", " ổn định.", "đái tháo đường", DX, (), "ổn định"),
    ("Đã từng dùng ", "aspirin", " hằng ngày.", "aspirin", DRUG, ("isHistorical",), "dùng aspirin hằng ngày"),
    ("Đã từng dùng ", "aspirin", " liều thấp.", "aspirin", DRUG, (), ""),
    ("Ghi nhận ", "không đau ngực", " khi khám.", "không đau ngực", SYM, ("isNegated",), "Ghi nhận không đau ngực"),
    ("Không có gì lạ, ", "không đau ngực", " nữa.", "không đau ngực", SYM, ("isNegated",), "lạ, không đau ngực; nữa"),
    ("Ghi nhận ", "không đau ngực", " hôm nay.", "không đau ngực", SYM, (), "đau ngực"),
    ("Xét nghiệm ", "công thức máu", " bình thường.", "công thức máu", TEST, ("isNegated",), "Xét nghiệm công thức máu ... bình thường"),
    ("Theo dõi ", "viêm phổi", " nhẹ.", "viêm phổi", DX, ("isOdd",), "viêm phổi nhẹ"),
    ("Theo dõi ", "viêm phổi", " nặng.", "viêm phổi!", DX, (), "viêm phổi"),
    ("Mẹ bị ", "hen phế quản", " từ nhỏ.", "hen phế quản", DX, ("isFamily",), "Mẹ bị hen phế quản"),
    ("Đi lại từng bước ", "đau gối", " nhẹ.", "đau gối", SYM, (), "từng bước đau gối"),
    ("Tổng trạng: ", "mệt", " không rõ.", "mệt", SYM, ("isNegated",), "mệt không rõ"),
    ("Năm 2019 mổ ", "ruột thừa", " tại viện.", "ruột thừa", DX, ("isHistorical",), "2019 mổ ruột thừa"),
    ("TIỀN SỬ BỆNH\n1. Hô hấp:\nCó ", "khó thở", " khi gắng sức, khó thở về đêm.", "khó thở", SYM, (), "khó thở"),
    ("Đánh giá hiện tại:\nMạch 80 l/phút, sốt 38,5 °C.\nDùng ", "paracetamol", " 500 mg mỗi 6 giờ.\n| a | b | c |\n", "paracetamol", DRUG, (), "Dùng paracetamol 500 mg"),
    ("Câu hỏi từ người dùng: tôi bị ", "ho khan", " có sao không?", "ho khan", SYM, (), "bị ho khan"),
    ("2) Tiền sử: không rõ\nLịch sử dài. Không rõ vì sao ", "ho khan", " kéo dài.", "ho khan", DX, (), "vì sao ho khan"),
    ("1. Khám\nTừng mắc ", "lao phổi", " năm ngoái.", "lao phổi", DX, ("isHistorical", "isNegated"), "Từng mắc lao phổi năm ngoái"),
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_VALUES = ", ".join(
    f"({j}, {_text(b)}, {_text(x)}, {_text(a)}, {_text(said)}, '{t}', [{listed(m)}]::VARCHAR[], {_text(ev)})" for j, (b, x, a, said, t, m, ev) in enumerate(SENTENCES)
)
#: Every fifth nation's note of the sentence with the odd type keeps it, the others have the common one.
NOTES_SQL = f"""
said(j, b, x0, a, x, t0, marks, evidence) AS (VALUES {_VALUES}),
notes AS (
  SELECT n_nationkey::VARCHAR || ':' || j AS id, j, b || x0 || a || ' ' || n_name AS text, length(b)::INT AS s, (length(b) + length(x0))::INT AS e, x0, x,
    CASE WHEN j = 20 AND n_nationkey % 5 <> 0 THEN '{SYM}' ELSE t0 END AS t, marks, evidence
  FROM nation, said)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, j, text, s, e, surface, said, type, marks, evidence."""
    each = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(b).alias("b"), F.lit(x).alias("x0"), F.lit(a).alias("a"), F.lit(said).alias("x"), F.lit(t).alias("t0"), F.array(*map(F.lit, m)).cast("array<string>").alias("marks"), F.lit(ev).alias("evidence")) for j, (b, x, a, said, t, m, ev) in enumerate(SENTENCES)])
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(each).alias("v"))
    kind = F.when((F.col("v.j") == 20) & (F.col("n_nationkey") % 5 != 0), SYM).otherwise(F.col("v.t0"))
    s = F.length("v.b")
    return rows.select(
        F.concat_ws(":", "n_nationkey", "v.j").alias("id"), "v.j", F.concat("v.b", "v.x0", "v.a", F.lit(" "), "n_name").alias("text"), s.alias("s"), (s + F.length("v.x0")).alias("e"), F.col("v.x0").alias("surface"), F.col("v.x").alias("said"), kind.alias("type"), "v.marks", "v.evidence"
    )


def note_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    one = vocab.entity(F.col("said"), F.col("s"), F.col("e"), F.col("type"), F.col("marks"))
    return rows.select("id", "text", F.array(one).alias("entities"), F.lit("document").alias("record_kind"), F.lit("notes").alias("source"), F.lit(None).cast("string").alias("genre"))


_SUPPORT = chosen(support_sql("text", "s", "e", vocab.SUPPORT_CUES))
_CONFLICT = chosen(conflict_sql("text", "s", vocab.CONFLICT_CUES))
_KNOWN = listed(vocab.ASSERTIONS)
SCREEN_SQL = rf"""{NOTES_SQL},
cued AS (SELECT *, {_SUPPORT} AS sup, {_CONFLICT} AS con, regexp_extract(x, '(?i)^(\s*(?:không|chưa|phủ nhận|ko)\s+)\S', 1) AS lead, x = substr(text, s + 1, e - s) AS fits, t IN ({BEARING}) AS bears FROM notes),
judged AS (SELECT *, list_sort(list_filter(con, lambda a: NOT list_contains(marks, a))) AS extra, list_filter(marks, lambda a: list_contains(sup, a)) AS backed FROM cued),
ruled AS (
  SELECT *, CASE WHEN NOT fits THEN 'offset_mismatch' WHEN len(marks) > 0 AND NOT bears THEN 'assertion_on_forbidden_type'
    WHEN len(list_filter(marks, lambda a: a NOT IN ({_KNOWN}))) > 0 THEN 'unknown_assertion' WHEN NOT bears THEN NULL
    WHEN len(backed) < len(marks) THEN 'assertion_without_cue' WHEN len(extra) > 0 AND NOT (t = '{DRUG}' AND extra = ['isHistorical']) THEN 'cue_without_assertion'
    WHEN lead <> '' AND list_contains(marks, 'isNegated') THEN 'span_swallows_negation' WHEN lead <> '' THEN 'negation_inside_span'
    WHEN t = '{DRUG}' AND list_contains(marks, 'isHistorical') THEN 'historical_drug' END AS kind FROM judged),
common AS (
  SELECT key, t AS winner FROM (SELECT lower(trim(x)) AS key, t, count(*) AS n, sum(count(*)) OVER (PARTITION BY lower(trim(x))) AS total, row_number() OVER (PARTITION BY lower(trim(x)) ORDER BY count(*) DESC, t) AS r FROM notes GROUP BY 1, 2)
  WHERE r = 1 AND total >= 4 AND n >= 0.85 * total),
found AS (
  SELECT id, kind, kind IN ('offset_mismatch', 'assertion_on_forbidden_type', 'unknown_assertion') AS mechanical,
    CASE kind WHEN 'assertion_on_forbidden_type' THEN []::VARCHAR[] WHEN 'unknown_assertion' THEN list_filter(marks, lambda a: a IN ({_KNOWN})) WHEN 'assertion_without_cue' THEN backed
      WHEN 'cue_without_assertion' THEN list_sort(list_distinct(list_concat(marks, extra))) WHEN 'span_swallows_negation' THEN marks
      WHEN 'negation_inside_span' THEN list_sort(list_distinct(list_append(marks, 'isNegated'))) WHEN 'historical_drug' THEN list_filter(marks, lambda a: a <> 'isHistorical') END AS to_marks,
    CASE WHEN kind <> 'offset_mismatch' THEN t END AS to_type, CASE WHEN kind IN ('span_swallows_negation', 'negation_inside_span') THEN substr(x, length(lead) + 1) END AS to_text,
    CASE WHEN kind IN ('span_swallows_negation', 'negation_inside_span') THEN s + length(lead) END AS to_start, CASE WHEN kind IN ('span_swallows_negation', 'negation_inside_span') THEN e END AS to_end,
    t, marks, x, s, e
  FROM ruled WHERE kind IS NOT NULL
  UNION ALL
  SELECT n.id, 'type_minority_vs_corpus', false, CASE WHEN winner IN ({BEARING}) THEN n.marks ELSE []::VARCHAR[] END, winner, NULL, NULL, NULL, n.t, n.marks, n.x, n.s, n.e
  FROM notes n JOIN common c ON c.key = lower(trim(n.x)) ANTI JOIN ruled r ON r.id = n.id AND r.kind IS NOT NULL WHERE n.t <> winner)"""


@query(f"WITH {SCREEN_SQL} SELECT id || '#0' AS key, kind, mechanical, array_to_string(to_marks, ',') AS marks, to_type AS \"type\", to_text AS text, to_start::INT AS \"start\", to_end::INT AS \"end\" FROM found")
def note_findings(spark, sf_dir):
    """Findings of every rule, and of majorities where no rule spoke, with what they propose."""
    found = audit.screen_all(note_records(spark, sf_dir))
    p = F.col("proposed")
    return found.select("key", "kind", "mechanical", F.array_join(p["assertions"], ",").alias("marks"), p["type"].alias("type"), p["text"].alias("text"), p["start"].alias("start"), p["end"].alias("end"))


@query(f"WITH {SCREEN_SQL} SELECT kind, mechanical, count(*) AS n FROM found GROUP BY ALL")
def screen_findings(spark, sf_dir):
    """V2-V6, A10: findings of rules and majorities by kind."""
    return audit.screen_all(note_records(spark, sf_dir)).groupBy("kind", "mechanical").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NOTES_SQL} SELECT id || '#0' AS key, s AS \"start\" FROM notes WHERE x = substr(text, s + 1, e - s)")
def delete_candidates(spark, sf_dir):
    """V5: every entity whose offsets are right."""
    return jobs.audit_screen(note_records(spark, sf_dir), "delete").select("key", F.col("entity.start").alias("start"))


@query(
    f"""WITH {NOTES_SQL},
c AS (SELECT *, {_SUPPORT} AS sup, {_CONFLICT} AS con FROM notes),
k AS (SELECT *, list_filter(marks, lambda a: list_contains(sup, a)) AS kept FROM c),
g AS (SELECT *, list_filter(list_sort(con), lambda a: NOT list_contains(kept, a) AND NOT (a = 'isHistorical' AND (t = '{DRUG}' OR list_contains(kept, 'isFamily')))) AS gained FROM k)
SELECT id, array_to_string(list_sort(list_concat(list_transform(list_filter(marks, lambda a: NOT list_contains(sup, a)), lambda a: 'no_cue:' || a),
    list_transform(list_filter(con, lambda a: NOT list_contains(marks, a) AND NOT (t = '{DRUG}' AND a = 'isHistorical')), lambda a: 'no_assertion:' || a))), ',') AS errors,
  CASE WHEN t IN ({BEARING}) THEN array_to_string(list_distinct(list_concat(kept, gained)), ',') ELSE '' END AS repaired_unsorted, array_to_string(list_sort(sup), ',') AS supported
FROM g""".replace("array_to_string(list_distinct(list_concat(kept, gained)), ',') ELSE '' END AS repaired_unsorted", "array_to_string(list_sort(list_concat(kept, gained)), ',') ELSE '' END AS repaired")
)
def note_repairs(spark, sf_dir):
    """Cues for and against the assertions of every note, and the repaired assertions."""
    text, s, e, t, m = (F.col(c) for c in ("text", "s", "e", "type", "marks"))
    return notes(spark, sf_dir).select(
        "id",
        F.array_join(F.array_sort(cues.cue_errors(text, s, e, t, m)), ",").alias("errors"),
        F.array_join(F.array_sort(cues.repaired(text, s, e, t, m)), ",").alias("repaired"),
        F.array_join(F.array_sort(cues.support(text, s, e)), ",").alias("supported"),
    )


_HEAD = r"^[ \t]*(?:[^\n:]{3,45}:[ \t]*|[A-ZĐÀ-ỸÁÂĂÊÔƠƯ][^\na-zà-ỹáâăêôơư]{3,45})$"
_BARE = lambda c: f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"
_UNITS = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])\p{{Nd}}+(?:[.,]\p{{Nd}}+)?[{WS}]*(?:%|°[{WS}]*c|độ[{WS}]*c|mg|g|kg|ml|l|mmhg|mmol/l|µmol/l|u/l|l/phút|l/p)(?:$|[^\p{{L}}\p{{N}}_])"


@query(
    rf"""WITH {NOTES_SQL},
l AS (SELECT *, string_split(text, chr(10)) AS lines, string_split_regex(substr(text, 1, s), '\r\n|[\n\r\x0b\x0c\x1c-\x1e]') AS above FROM notes),
p AS (SELECT *, list_transform(range(1, len(lines) + 1), lambda i: {{'v': lines[i], 'e': coalesce(list_sum(list_transform(lines[1:i], lambda y: length(y))), 0) + i - 1}}) AS placed FROM l),
h AS (SELECT *, list_filter(placed, lambda y: regexp_matches(y.v, '{_HEAD}') AND y.e <= s) AS heads, list_filter(above, lambda y: regexp_matches(y, '^[{WS}]*(?:\p{{Nd}}+[{WS}]*[.)]|[A-ZÀ-Ỹ][^.!?]{{0,80}}:?[{WS}]*$)')) AS titles,
  {_BARE("regexp_replace(" + _BARE("lines[1]") + ", ':+$', '')")} AS first FROM p)
SELECT id, substr(text, greatest(0, s - 400) + 1, s - greatest(0, s - 400)) AS before, substr(text, s + 1, e - s) AS surface, substr(text, e + 1, 400) AS after, greatest(0, s - 400)::INT AS window_start,
  CASE WHEN len(heads) > 0 THEN rtrim(trim(heads[-1].v), ': ') END AS heading, CASE WHEN len(titles) > 0 THEN {_BARE('titles[-1]')} END AS header,
  CASE WHEN upper(first) = first AND regexp_matches(first, '\p{{L}}') THEN upper(substr(first, 1, 1)) || lower(substr(first, 2)) ELSE first END AS natural_first,
  len(regexp_extract_all(text, '{_UNITS}'))::INT AS measured, length(regexp_extract(x0, '(?i)^(\s*(?:không|chưa|phủ nhận|ko)\s+)\S', 1))::INT AS negation,
  regexp_matches(text, '(?m)^\s*\|.*\|.*\|\s*$') OR regexp_matches(text, '(?m)^\s*\|?\s*:?-{{3,}}') AS has_table,
  CASE WHEN regexp_matches(text, '(?i)Câu hỏi từ người dùng|Câu trả lời của bác sĩ') AND regexp_matches(text, '(?m)^[{WS}]*\p{{Nd}}+[{WS}]*[.)][{WS}]*(?:Tiền sử|Bệnh sử|Lịch sử|Đánh giá|Khám)') THEN 'MIXED'
    WHEN regexp_matches(text, '(?i)Câu hỏi từ người dùng|Câu trả lời của bác sĩ') THEN 'ADVICE' WHEN regexp_matches(text, '(?m)^[{WS}]*\p{{Nd}}+[{WS}]*[.)][{WS}]*(?:Tiền sử|Bệnh sử|Lịch sử|Đánh giá|Khám)') THEN 'RECORD' ELSE 'OTHER' END AS genre
FROM h"""
)
def note_contexts(spark, sf_dir):
    """Context, heading, header, genre, measurements and tables of notes."""
    text, s, e = F.col("text"), F.col("s"), F.col("e")
    c = context(text, s, e)
    return notes(spark, sf_dir).select(
        "id",
        c["before"].alias("before"),
        c["surface"].alias("surface"),
        c["after"].alias("after"),
        c["window_start"].cast("int").alias("window_start"),
        nearest_heading(headings(text), s).alias("heading"),
        nearest_header(text, s).alias("header"),
        natural_heading(F.split(text, "\n")[0]).alias("natural_first"),
        F.size(measurements(text)).alias("measured"),
        F.length(leading_negation(F.col("surface"))).alias("negation"),
        has_table(text).alias("has_table"),
        genre(text).alias("genre"),
    )


@query(
    rf"""WITH {NOTES_SQL},
f AS (SELECT *, list_distinct(list_append(regexp_split_to_array({_BARE('evidence')}, '\s*(?:\.\.\.|…|;)\s*'), {_BARE('evidence')})) AS fragments, len(string_split(text, x0)) - 1 AS times FROM notes),
u AS (SELECT *, unnest(list_filter(fragments, lambda y: y <> '' AND contains(y, x0) AND NOT (y = x0 AND times > 1))) AS fragment FROM f),
o AS (SELECT id, s, e, fragment, string_split(text, fragment) AS parts FROM u),
p AS (SELECT id, s, e, fragment, parts, unnest(range(1, len(parts))) AS j FROM o),
c AS (SELECT DISTINCT id FROM (SELECT id, s, e, length(fragment) AS n, list_sum(list_transform(parts[1:j], lambda y: length(y))) + (j - 1) * length(fragment) AS at_ FROM p) WHERE at_ <= s AND e <= at_ + n)
SELECT n.id, c.id IS NOT NULL AS proven FROM notes n LEFT JOIN c USING (id)"""
)
def note_evidence(spark, sf_dir):
    """Whether the quoted evidence covers the labelled occurrence."""
    return notes(spark, sf_dir).select("id", cues.evidence_supports(F.col("text"), F.col("surface"), F.col("s"), F.col("evidence")).alias("proven"))


_CASES = ("assertion.family.01", "assertion.historical.02", "coverage.nursing.003", "occurrence.one")
_FIELDS = ("tiền sử gia đình", "hồ sơ cũ", "ghi chép", "past_medical_history")


@query(
    f"""WITH c AS (SELECT n_nationkey, [{listed(_CASES)}][n_nationkey % 4 + 1] AS case_id, [{listed(_FIELDS)}][(n_nationkey // 4) % 4 + 1] AS field FROM nation),
w AS (SELECT *, lower(case_id || ' ' || field) AS whole FROM c)
SELECT n_nationkey::INT AS id, CASE WHEN starts_with(case_id, 'assertion.family') OR regexp_matches(whole, 'gia đình|family_history') THEN 'isFamily'
  WHEN starts_with(case_id, 'assertion.historical') OR regexp_matches(whole, 'tiền sử|past_medical_history|bệnh sử|hồ sơ cũ') THEN 'isHistorical' END AS bias FROM w"""
)
def discourse_kinds(spark, sf_dir):
    """The assertion that a kind of document leans to."""
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"))
    return rows.select("id", cues.discourse_bias(pick(_CASES, F.col("id") % 4), pick(_FIELDS, F.floor(F.col("id") / 4) % 4)).alias("bias"))


_SURFACES = tuple(dict.fromkeys([x for _, x, *_ in SENTENCES] + ["ho", "5,5", "12/3", "cần thêm thông tin", "khám phổi", "bệnh nhân", "Triệu chứng", "đau", "x", " sốt ", "viêm phổi nặng", "phổi", "có ho"]))
_SURFACE_SQL = f"s AS (SELECT unnest([{listed(_SURFACES)}]) AS x), k AS (SELECT x, {TYPE_LIST}[{hashed(chr(39) + 'f' + chr(39), 'x')} % 5 + 1] AS t FROM s)"
_STARTS = lambda c: " OR ".join(f"starts_with({c}, '{p}')" for p in vocab.listed(vocab.AMBIGUOUS_PREFIXES))


def surfaces(spark: SparkSession) -> DataFrame:
    from .functions.core import hash_int

    rows = spark.createDataFrame([(x,) for x in _SURFACES], "x string")
    return rows.withColumn("t", F.get(F.array(*map(F.lit, vocab.TYPES)), (hash_int(F.lit("f"), F.col("x")) % 5).cast("int")))


@query(
    rf"""WITH {_SURFACE_SQL}, b AS (SELECT x, t, lower({_BARE('x')}) AS low FROM k),
m AS (SELECT a.x, bool_or(lower(a.x) = lower(z.x) OR regexp_matches(' ' || lower(z.x) || ' ', '[^\p{{L}}\p{{N}}_]' || lower(a.x) || '[^\p{{L}}\p{{N}}_]') OR regexp_matches(' ' || lower(a.x) || ' ', '[^\p{{L}}\p{{N}}_]' || lower(z.x) || '[^\p{{L}}\p{{N}}_]')) AS clashes
  FROM s a JOIN s z ON z.x IN ('viêm phổi', 'ho khan') GROUP BY a.x)
SELECT x AS surface, length(low) >= 2 AND NOT regexp_matches(low, '^[\p{{N}}{WS}.,/%-]+$') AND NOT ({" OR ".join(f"contains(low, '{p}')" for p in vocab.listed(vocab.UNSAFE_PHRASES))}) AND NOT ({_STARTS('low')}) AS safe,
  low NOT IN ({listed(vocab.listed(vocab.META_NOUNS))}) AND NOT ({_STARTS('low')}) AND (regexp_matches(low, '[{WS}]') OR t <> '{SYM}') AS precise, clashes FROM b JOIN m USING (x)"""
)
def surface_rules(spark, sf_dir):
    """which surfaces are safe, precise, or in conflict with two others."""
    x = F.col("x")
    return surfaces(spark).select(x.alias("surface"), spans.surface_safe(x).alias("safe"), spans.high_precision(x, F.col("t")).alias("precise"), spans.surface_conflicts(x, F.array(F.lit("viêm phổi"), F.lit("ho khan"))).alias("clashes"))


# --- verdicts and decisions

_V = hashed("'v'", "id || '#0'")
_VERDICTS = f"v AS (SELECT id || '#0' AS key, {_V} AS h FROM found WHERE {_V} % 5 <> 4)"


def verdicts(found: DataFrame) -> DataFrame:
    """Derived verdicts: keep, another type, other assertions, or a part of the span."""
    from .functions.core import hash_int

    h = hash_int(F.lit("v"), F.col("key"))
    rows = found.withColumn("h", h).filter("h % 5 <> 4")
    return rows.select(
        F.col("key").alias("id"),
        F.when(F.col("h") % 5 == 0, "keep").otherwise("change").alias("verdict"),
        F.when(F.col("h") % 5 == 1, F.array(F.lit("isFamily"))).otherwise(F.col("entity.assertions")).alias("assertions"),
        F.when(F.col("h") % 5 == 2, RES).alias("type"),
        F.when(F.col("h") % 5 == 3, F.substring_index("entity.text", " ", -1)).alias("span"),
    )


RESOLVED_SQL = f"""{SCREEN_SQL},{_VERDICTS},
r AS (SELECT f.*, v.h % 5 AS c, v.key IS NOT NULL AS has FROM found f LEFT JOIN v ON v.key = f.id || '#0'),
w AS (SELECT *, CASE WHEN mechanical THEN coalesce(to_type, t) WHEN c = 2 THEN '{RES}' ELSE t END AS nt, CASE WHEN mechanical THEN coalesce(to_marks, marks) WHEN c = 1 THEN ['isFamily'] ELSE marks END AS nm0,
  CASE WHEN c = 3 AND NOT mechanical THEN list_extract(string_split(x, ' '), -1) END AS span FROM r WHERE (mechanical OR has) AND coalesce(c, -1) <> 0),
z AS (SELECT *, CASE WHEN nt IN ({BEARING}) THEN nm0 ELSE []::VARCHAR[] END AS nm, CASE WHEN span <> x AND strpos(x, span) > 0 THEN span END AS nx FROM w)"""


@query(
    f"""WITH {RESOLVED_SQL} SELECT id || '#0' AS key, array_to_string(nm, ',') AS marks, CASE WHEN nt <> t THEN nt END AS "type", nx AS text, CASE WHEN nx IS NOT NULL THEN s + strpos(x, nx) - 1 END::INT AS "start",
  CASE WHEN nx IS NOT NULL THEN s + strpos(x, nx) - 1 + length(nx) END::INT AS "end" FROM z WHERE nt <> t OR nm <> marks OR nx IS NOT NULL"""
)
def resolved_changes(spark, sf_dir):
    """What verdicts change; a span never widens, types without assertions clear them."""
    found = audit.screen_all(note_records(spark, sf_dir))
    p = F.col("proposed")
    return audit.resolve_change(found, verdicts(found)).select("key", F.array_join(p["assertions"], ",").alias("marks"), p["type"].alias("type"), p["text"].alias("text"), p["start"].alias("start"), p["end"].alias("end"))


@query(
    f"""WITH {RESOLVED_SQL}, q AS (SELECT *, nt <> t OR nm <> marks OR nx IS NOT NULL AS changed FROM z)
SELECT n.id, CASE WHEN q.changed THEN q.nt ELSE n.t END AS "type", array_to_string(CASE WHEN q.changed THEN q.nm ELSE n.marks END, ',') AS marks,
  CASE WHEN q.changed AND nx IS NOT NULL AND substr(n.text, n.s + strpos(n.x, nx), length(nx)) = nx THEN nx ELSE n.x END AS text
FROM notes n LEFT JOIN q USING (id)"""
)
def applied_changes(spark, sf_dir):
    """V11, J8, E-k: records with all resolved changes accepted: retyped, with other assertions or a moved span."""
    recs = note_records(spark, sf_dir)
    found = audit.screen_all(recs)
    changes = audit.resolve_change(found, verdicts(found))
    done = jobs.audit_apply(recs, changes, changes.select("key", F.lit("accept").alias("decision")))
    e = F.col("entities")[0]
    return done.select("id", e["type"].alias("type"), F.array_join(e["assertions"], ",").alias("marks"), e["text"].alias("text"))


@query(
    f"""WITH {SCREEN_SQL},{_VERDICTS}, p AS (SELECT id || '#0' AS key, mechanical FROM found)
(SELECT key, mechanical FROM p WHERE NOT mechanical AND key NOT IN (SELECT key FROM v) ORDER BY key LIMIT 20) UNION ALL (SELECT key, mechanical FROM p WHERE mechanical)"""
)
def findings_to_judge(spark, sf_dir):
    """The first 20 findings without a verdict, and all mechanical ones."""
    found = audit.screen_all(note_records(spark, sf_dir))
    return audit.to_judge(found, verdicts(found), 20).select("key", "mechanical")


_SIGN = "substr(sha256('prompt' || chr(31) || '400'), 1, 12)"


@query(f"WITH e AS (SELECT user_id::VARCHAR AS id, event_id AS seq, event_type AS verdict, CASE WHEN event_id % 3 = 0 THEN 'old' ELSE {_SIGN} END AS signature FROM events) SELECT id, max(seq) AS seq, arg_max(verdict, seq) AS verdict FROM e WHERE signature = {_SIGN} GROUP BY id")
def current_verdicts(spark, sf_dir):
    """The last verdict of each id among those with the current signature."""
    sign = audit.input_signature("prompt", "400")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("verdict"), F.when(F.col("event_id") % 3 == 0, "old").otherwise(sign).alias("input_signature"))
    return audit.current_verdicts(rows, sign).select("id", "seq", "verdict")


@query("SELECT doc_id::VARCHAR AS id, 'unknown' AS state FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id::VARCHAR, 'unreviewed' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id % 2 = 0".replace("SELECT doc_id::VARCHAR AS id, 'unknown' AS state FROM labels WHERE doc_id % 2 = 0", "SELECT (doc_id + 10000000)::VARCHAR AS id, 'unknown' AS state FROM labels WHERE doc_id % 2 = 0"))
def review_coverage(spark, sf_dir):
    """Reviews without metadata and documents without review."""
    moved = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 10000000).otherwise(F.col("doc_id"))
    reviewed = read(spark, sf_dir, "labels").select(moved.cast("string").alias("id"))
    return audit.review_coverage(reviewed, read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")))


@query(
    """WITH l AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS quality, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic + doc_id % 2 END AS toxic FROM labels)
SELECT 'quality' AS field, count(*) FILTER (WHERE quality IS NULL) AS blank, count(*) FILTER (WHERE quality NOT IN (0, 1)) AS bad, count(*) AS n FROM l
UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL), count(*) FILTER (WHERE toxic NOT IN (0, 1)), count(*) FROM l"""
)
def review_errors(spark, sf_dir):
    """Blank and wrong fields of reviews."""
    rows = read(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 7 != 0, F.col("quality")).alias("quality"), F.when(F.col("doc_id") % 5 != 0, F.col("toxic") + F.col("doc_id") % 2).alias("toxic"))
    return audit.review_errors(rows, {"quality": lambda c: c.isin(0, 1), "toxic": lambda c: c.isin(0, 1)})


@query("SELECT user_id::VARCHAR AS key, CASE WHEN arg_max(event_id % 2, event_id) = 0 THEN 'accept' ELSE 'reject' END AS decision FROM events WHERE user_id <> (SELECT min(user_id) FROM events) GROUP BY user_id")
def review_decisions(spark, sf_dir):
    """X8, E-m, X9: one decision unset, the last of every other key stands."""
    events = read(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.when(F.col("event_id") % 2 == 0, "accept").otherwise("reject").alias("decision"), F.col("event_id").alias("seq"))
    first = events.agg(F.min("user_id").cast("string").alias("k"), F.max("event_id").alias("n")).first()
    return jobs.decide(rows, first["k"], None, first["n"] + 1).select("key", "decision")


# --- plans

_REQ = "r AS (SELECT 'coverage.' || n_name AS case_id, unnest(range(0, 3))::INT AS variant, n_nationkey FROM nation)"


def _case_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.concat(F.lit("coverage."), "n_name").alias("case_id"), "n_nationkey")
    return rows.withColumn("status", F.when(F.col("n_nationkey") % 4 == 0, "open").otherwise("approved"))


@query(f"""WITH {_REQ} SELECT case_id || ':v' || lpad(variant::VARCHAR, 2, '0') AS request_id, sha256('{{"p0":"' || case_id || '","p1":' || variant || '}}') AS key, (CASE WHEN n_nationkey % 2 = 0 THEN 'draft' ELSE 'final' END = 'final') AND n_nationkey % 3 <> 0 AS approved FROM r WHERE n_nationkey % 4 <> 0""")
def case_requests(spark, sf_dir):
    """Requests of the approved cases with their key and approval."""
    reqs = contract.requests(contract.select_cases(_case_rows(spark, sf_dir)), 3)
    stage = F.when(F.col("n_nationkey") % 2 == 0, "draft").otherwise("final")
    signed = F.when(F.col("n_nationkey") % 3 == 0, "other").otherwise("sum")
    return reqs.select("request_id", contract.request_key(F.col("case_id"), F.col("variant_index")).alias("key"), contract.approved(F.lit("sum"), signed, stage, "final").alias("approved"))


_LEXICON = ("viêm phổi", "phổi nặng", "đau ngực", "tháo đường", "khan", "phổi", "công thức")


@query(
    f"""WITH s AS (SELECT unnest([{listed(_SURFACES)}]) AS x), w AS (SELECT x, regexp_split_to_array(trim(x), '\\s+') AS w FROM s),
p AS (SELECT x, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT x, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT x, w, unnest(range(1, len(w))) AS n FROM w WHERE len(w) >= 2))),
f AS (SELECT x, arg_min(p, struct_pack(a := -n, b := i)) AS p FROM p WHERE length(p) >= 4 AND p <> x AND p IN ({listed(_LEXICON)}) GROUP BY x)
SELECT s.x AS surface, f.p AS phrase FROM s LEFT JOIN f USING (x)"""
)
def covered_phrases(spark, sf_dir):
    """The longest known phrase inside each surface."""
    return surfaces(spark).select(F.col("x").alias("surface"), contract.covered_phrase(F.col("x"), F.array(*map(F.lit, _LEXICON))).alias("phrase"))


@query(
    f"""SELECT n_nationkey::INT AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'own' WHEN n_nationkey % 4 = 1 THEN '{DX}' WHEN n_nationkey % 5 > 1 THEN 'fall' || n_nationkey % 5 END AS kind,
  '{{"text":"' || n_name || '","position":[0,' || length(n_name) || '],"type":"{DX}","assertions":["isFamily"],"candidates":[]}}' AS label FROM nation"""
)
def plan_items(spark, sf_dir):
    """The semantic type of a decision, and the label that a reviewer sees."""
    n = F.col("n_nationkey")
    own = F.when(n % 3 == 0, F.lit("own"))
    known = F.when(n % 4 == 1, F.array(F.lit(DX))).when(n % 4 == 2, F.array(F.lit(DX), F.lit(SYM))).otherwise(empty("array<string>"))
    fall = F.when(n % 5 > 1, F.array(F.concat(F.lit("fall"), (n % 5).cast("string")), F.lit("last"))).otherwise(empty("array<string>"))
    mention = F.struct(F.col("n_name").alias("text"), F.array(F.lit(0), F.length("n_name")).alias("position"), F.lit(DX).alias("type"), F.array(F.lit("isFamily")).alias("assertions"))
    return read(spark, sf_dir, "nation").select(n.cast("int").alias("id"), contract.semantic_type(own, known, fall).alias("kind"), F.to_json(contract.app_label(mention)).alias("label"))


# --- sets, unions and lists


@query("SELECT doc_id, 'src0' AS kind FROM documents WHERE source = 'src0' UNION ALL SELECT doc_id, 'src1' FROM documents WHERE source = 'src1'")
def source_union(spark, sf_dir):
    """Sources joined to one table, one of them excluded."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    parts = {s: docs.filter(F.col("source") == s).select("doc_id", F.lit(s).alias("kind")) for s in ("src0", "src1", "src2")}
    return split.union_sources(parts, ["src2"])


@query(
    """WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id FROM labels WHERE doc_id % 3 = 0)
SELECT 'union' AS op, count(*) AS n, sum(doc_id)::BIGINT AS total FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)
UNION ALL SELECT 'intersect', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b) UNION ALL SELECT 'except', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b)"""
)
def id_sets(spark, sf_dir):
    """L4: union, intersection and difference of two sets of ids."""
    a = read(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id")
    b = read(spark, sf_dir, "labels").filter("doc_id % 3 = 0").select("doc_id")
    rows = split.id_set(a, b, "union").unionByName(split.id_set(a, b, "intersect")).unionByName(split.id_set(a, b, "except"))
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total"))


@query(
    """WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ ]+') AS w FROM conversations), x AS (SELECT conv_id, turn, unnest(w) AS t, unnest(range(len(w))) AS i FROM w),
f AS (SELECT conv_id, turn, t, min(i) AS i FROM x GROUP BY ALL) SELECT conv_id, turn, string_agg(t, ' ' ORDER BY i) AS words FROM f GROUP BY ALL"""
)
def first_words(spark, sf_dir):
    """The words of every turn without repeats, in order."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", split.stable_distinct(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))).alias("w"))
    return rows.filter(F.size("w") > 0).select("conv_id", "turn", F.array_join("w", " ").alias("words"))


@query("SELECT doc_id, row_number() OVER (ORDER BY length(doc_id::VARCHAR), doc_id::VARCHAR)::INT AS place FROM documents")
def sorted_stems(spark, sf_dir):
    """Ids by length and name, as files are listed."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("stem"))
    return rows.select("doc_id", F.row_number().over(Window.orderBy(F.length("stem"), "stem")).alias("place"))


@query("SELECT 512 AS positions, p AS pad, CASE WHEN p IS NOT NULL AND p <> 0 THEN 512 - (p + 1) ELSE 511 END AS tokens FROM (SELECT unnest([0, 1, 2]) AS p)")
def encoder_room(spark, sf_dir):
    """Tokens that fit an encoder by its padding id."""
    from .operators.windows import encoder_capacity

    return spark.createDataFrame([(512, p, encoder_capacity(512, p)) for p in (0, 1, 2)], "positions int, pad int, tokens int")


@query("SELECT lower(n_name) AS folded, n_nationkey::INT AS id FROM nation")
def folded_names(spark, sf_dir):
    """Case folding."""
    from .functions.text import folded

    return read(spark, sf_dir, "nation").select(folded(F.col("n_name")).alias("folded"), F.col("n_nationkey").cast("int").alias("id"))


@query("WITH e AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL) SELECT user_id, event_type, event_id FROM e")
def first_events(spark, sf_dir):
    """The first event of each kind of every user, as final labels keep the first of a surface and type."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("text"), F.lit("e").alias("type"), F.col("event_id").alias("start"), F.col("event_id").alias("end"))
    return postprocess.final(rows).select(F.col("id").alias("user_id"), F.col("text").alias("event_type"), F.col("start").alias("event_id"))

