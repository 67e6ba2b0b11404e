"""Registered queries of lexica, plans and draft contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import vocab
from .functions.core import empty
from .functions.text import occurrences, strip
from .operators import contract
from .oracles import BEARING, TOKENS_SQL, TYPE_LIST, WS, hashed, listed
from .plans import jobs
from .queries import catalog, query
from .queries_rules import _STARTS, _UNITS, NOTES_SQL, notes

_ = "'{}'".format
_U = lambda *p: f"{hashed(*p)} / 4294967295.0"
CATALOG_SQL = f"""{TOKENS_SQL},
top_ AS (SELECT lower(tok) AS tx, count(*) AS n, count(DISTINCT source) AS sources FROM tokens JOIN documents USING (doc_id) WHERE length(tok) >= 4 GROUP BY 1 ORDER BY n DESC, tx LIMIT {contract.LEXICON}),
cat AS (SELECT tx, n, sources, {TYPE_LIST}[{hashed(_('c'), 'tx')} % 5 + 1] AS t FROM top_),
safe AS (SELECT * FROM cat WHERE NOT regexp_matches(tx, '^[\\p{{N}}{WS}.,/%-]+$') AND NOT ({" OR ".join(f"contains(tx, '{p}')" for p in vocab.listed(vocab.UNSAFE_PHRASES))}) AND NOT ({_STARTS('tx')}))"""


@query(
    f"""WITH {CATALOG_SQL}, z AS (SELECT 'sample' AS what, tx, t, sources FROM (SELECT * FROM cat WHERE t = '{vocab.DIAGNOSIS}' AND sources >= 2 AND tx NOT IN ('with', 'from', 'that') ORDER BY sha256('11:' || tx), tx LIMIT 5)
  UNION ALL SELECT 'pair', tx, t, sources FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY sha256('11:' || tx), tx) AS r FROM safe WHERE t IN ('{vocab.TEST}', '{vocab.RESULT}')) WHERE r = 1)
SELECT what, tx AS text, t AS "type", sources FROM z"""
)
def catalog_samples(spark, sf_dir):
    """Surfaces of one type from two sources or more, without the excluded, and a pair of test and result."""
    rows = catalog(spark, sf_dir)
    picked = contract.sample_entities(rows, vocab.DIAGNOSIS, 5, 11, ["with", "from", "that"], 2).withColumn("what", F.lit("sample"))
    return picked.unionByName(contract.lab_pair(rows, 11).withColumn("what", F.lit("pair"))).select("what", "text", "type", "sources")


_PROFILES = ", ".join(f"({str(low).lower()}, {i if i < 10 else i - 10}, '{k}', [{listed(types)}])" for i, (k, _f, _h, low, types) in enumerate(contract.PROFILES))
_KINDS = ", ".join(f"('{t}', {w})" for t, w in vocab.GOLD_WEIGHTS.items())
_COVERAGE = next(b for b in contract.BRIEFS if b[0] == "coverage.")
PLANS_SQL = f"""{CATALOG_SQL},
prof(low_yield, seat, key, mix) AS (VALUES {_PROFILES}),
cases AS (SELECT i, i % 4 = 3 AS low_yield, (CASE WHEN i % 4 = 3 THEN (i // 4) % 4 ELSE (i - i // 4) % 10 END)::INT AS seat FROM range(20) t(i)),
reqs AS (SELECT 'coverage.' || key || '.' || lpad((i + 1)::VARCHAR, 3, '0') || ':v0' || v AS rid, mix FROM cases JOIN prof USING (low_yield, seat), range(2) r(v)),
kinds(t, wt) AS (VALUES {_KINDS}),
ord AS (SELECT rid, t, row_number() OVER (PARTITION BY rid ORDER BY -ln(greatest({_U(_('7'), 'rid', 't')}, 1e-12)) / wt, t) - 1 AS rank FROM reqs JOIN kinds ON list_contains(mix, t)),
ring AS (SELECT tx, t, row_number() OVER (PARTITION BY t ORDER BY sha256(tx), tx) - 1 AS slot, count(*) OVER (PARTITION BY t) AS n FROM safe),
picks AS (SELECT o.rid, o.t, o.rank, k, {hashed(_('7'), 'rid', 'o.t', 'k')} AS h FROM ord o, range(3) q(k)),
drawn AS (SELECT p.rid, r.tx, p.t, min(k) AS k, min(p.rank) AS rank FROM picks p JOIN ring r ON r.t = p.t AND r.slot = p.h % r.n GROUP BY ALL),
core AS (SELECT *, 'core:' || lpad(i::VARCHAR, 2, '0') AS seed FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k, rank, tx) AS i FROM drawn) WHERE i <= {_COVERAGE[6]}),
marked AS (SELECT *, {_U(_('7'), 'rid', 'tx', _('rate'))} < {vocab.ASSERTION_RATE} AND t IN ({BEARING}) AND NOT (t = '{vocab.DRUG}' AND {_U(_('7'), 'rid', 'tx', _('name'))} < 0.62) AS marked FROM core),
allr AS (SELECT tx, row_number() OVER (ORDER BY sha256(tx), tx) - 1 AS slot, count(*) OVER () AS n FROM safe),
extra AS (SELECT q.rid, a.tx FROM reqs q JOIN allr a ON a.slot = {hashed(_('7'), 'rid', _('o'), _('1'))} % a.n ANTI JOIN core c ON c.rid = q.rid AND c.tx = a.tx),
want AS (SELECT rid, CASE WHEN {_U(_('7'), 'rid', _('repeats'))} < 0.50 THEN 1 WHEN {_U(_('7'), 'rid', _('repeats'))} < 0.85 THEN 2 ELSE 3 END AS c FROM reqs),
rep AS (SELECT m.rid, m.seed, {_U(_('7'), 'm.rid', _('again'), 'm.seed', _('gate'))} < {contract.REPEAT_RATE} AS omitted, row_number() OVER (PARTITION BY m.rid ORDER BY {hashed(_('7'), 'm.rid', _('repeat'), 'm.seed')}, m.seed) AS r, w.c FROM marked m JOIN want w USING (rid) WHERE m.t IN ({BEARING}))"""


@query(
    f"""WITH {PLANS_SQL}, a AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE marked) AS marked FROM marked GROUP BY rid), x AS (SELECT rid, count(*) AS n FROM extra GROUP BY rid),
p AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE omitted) AS omitted FROM rep WHERE r <= c GROUP BY rid)
SELECT a.rid AS request_id, (a.n + coalesce(x.n, 0) + coalesce(p.n, 0))::INT AS items, (a.n + coalesce(p.n - p.omitted, 0))::INT AS labelled, a.marked::INT AS marked, coalesce(p.omitted, 0)::INT AS omitted
FROM a LEFT JOIN x USING (rid) LEFT JOIN p USING (rid)"""
)
def draft_plans(spark, sf_dir):
    """P2-P6, P9, P11, R8, E-i: plans for 40 requests: drawn surfaces, assertions, an unlabelled term and repeats."""
    reqs = jobs.draft_requests(spark, 20, 2, catalog(spark, sf_dir))
    count = lambda c: F.size(F.filter("plan", c))
    return reqs.select(
        "request_id",
        F.size("plan").alias("items"),
        count(lambda x: x["should_label"]).alias("labelled"),
        count(lambda x: x["seed_id"].startswith("core:") & (F.size(x["assertions"]) > 0)).alias("marked"),
        count(lambda x: x["occurrence_role"] == "repeat_omitted").alias("omitted"),
    )


@query(
    "WITH c AS (SELECT unnest(['discourse.education.1', 'discourse.drug_example.2', 'occurrence.3', 'type.test_to_finding.4', 'coverage.nursing.005', 'assertion.6']) AS case_id) SELECT case_id, CASE "
    + " ".join(
        f"WHEN starts_with(case_id, '{p}') THEN '{fmt or 'given'}|{(head or 'Cho sẵn')[0] + (head or 'Cho sẵn')[1:].lower()}|{lo}-{hi}|{l0}-{l1}|{o0}-{o1}|{most}'" for p, fmt, head, lo, hi, l0, l1, o0, o1, most in contract.BRIEFS
    )
    + " END AS brief FROM c"
)
def case_briefs(spark, sf_dir):
    """The brief of a case by the first prefix that fits."""
    ids = ["discourse.education.1", "discourse.drug_example.2", "occurrence.3", "type.test_to_finding.4", "coverage.nursing.005", "assertion.6"]
    rows = spark.createDataFrame([(i, "given", "Cho sẵn") for i in ids], "case_id string, document_format string, heading string")
    b = F.col("brief")
    span = lambda c: F.concat_ws("-", b[c][0], b[c][1])
    return contract.briefs(rows).select("case_id", F.concat_ws("|", b["document_format"], b["heading_text"], span("length_chars"), span("labeled"), span("intentional_o"), b["mentions_max"]).alias("brief"))


# --- drafts with planted faults

_HEAD, _META = "DIỄN BIẾN", "thuật ngữ này"
FAULTS = 14
DRAFTS_SQL = f"""{NOTES_SQL},
base AS (SELECT *, string_split(id, ':')[1]::INT % {FAULTS} AS f, '{_HEAD}' || chr(10) || text AS whole, contains(x0, ' ') AS two, list_extract(string_split(x0, ' '), -1) AS last FROM notes),
dr AS (SELECT *, CASE WHEN f = 2 THEN '' WHEN f = 9 THEN whole || ' {_META}' ELSE whole END AS raw, f <> 10 AS req, f NOT IN (2, 7, 8, 10) AS at_ FROM base)"""


def drafts_and_requests(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Drafts of the notes, each with one of ``FAULTS`` faults, and their requests."""
    rows = notes(spark, sf_dir).withColumn("f", F.substring_index("id", ":", 1).cast("int") % FAULTS)
    x, f = F.col("surface"), F.col("f")
    two, last = x.contains(" "), F.substring_index(x, " ", -1)
    before, after = F.substr("text", F.lit(1), F.col("s")), F.substr("text", F.col("e") + 1, F.length("text"))
    mark = F.concat(F.lit('<E id="'), F.when(f == 8, "core:02").otherwise("core:01"), F.lit('">'), x, F.lit("</E>"))
    text = F.concat(F.lit(_HEAD + "\n"), before, mark, after, F.when(f == 9, F.lit(" " + _META)).otherwise(""))
    said = F.concat(before, x, after)

    def mention(seed, surface, label, kind, evidence, rationale):
        return F.struct(seed.alias("seed_id"), surface.alias("text"), F.lit(label).alias("should_label"), kind.cast("string").alias("type"), empty("array<string>").alias("assertions"), evidence.alias("context_evidence"), rationale.alias("rationale"), F.lit(None).cast("array<int>").alias("position"))

    none = F.when(f == 12, F.lit(""))
    one = mention(F.when(f == 7, "core:09").otherwise("core:01"), x, True, F.when(f == 13, "XX").otherwise(vocab.TEST), F.coalesce(none, said), F.coalesce(none, F.lit("vì")))
    cov = mention(F.lit("cov:01"), last, False, F.lit(None), said, F.lit("vì"))
    kind = f"array<{vocab.MENTION}>"
    mentions = F.when(f == 6, empty(kind)).otherwise(F.concat(F.array(one), F.when(f == 11, F.array(one)).otherwise(empty(kind)), F.when(two, F.array(cov)).otherwise(empty(kind))).cast(kind))
    drafts = rows.select(
        F.col("id").alias("draft_id"),
        F.when(f == 2, "").otherwise(text).alias("marked_text"),
        F.when(f == 3, "other").otherwise(F.concat(F.lit("case."), "id")).alias("source_case_id"),
        F.when(f == 4, "other").otherwise("note").alias("document_format"),
        F.when(f != 5, F.array(F.lit(_HEAD))).alias("section_path"),
        mentions.alias("mentions"),
    )
    own = contract.planned_item(F.lit("core:01"), x, F.lit(vocab.TEST), F.lit(True), empty("array<string>"), F.lit("core"))
    hidden = contract.planned_item(F.lit("cov:01"), last, F.lit(vocab.TEST), F.lit(False), empty("array<string>"), F.lit("covered_by_longer_entity"), "covered_by_longer").withField("covered_by", F.lit("core:01"))
    limits = lambda *v: F.array(*map(F.lit, v))
    brief = F.struct(F.lit("note").alias("document_format"), F.lit(_HEAD).alias("heading_text"), limits(40, 300).alias("length_chars"), limits(1, 1).alias("labeled"), limits(0, 2).alias("intentional_o"), F.lit(5).alias("mentions_max"))
    reqs = rows.filter("f <> 10").select(F.col("id").alias("request_id"), F.concat(F.lit("case."), "id").alias("case_id"), brief.alias("brief"), F.lit("explicit").alias("header_mode"), F.when(two, F.array(own, hidden)).otherwise(F.array(own)).alias("plan"))
    return drafts, reqs


def occurrences_sql(text: str, part: str) -> str:
    """Starts of the word-bounded places of a literal."""
    word = r"[\p{L}\p{N}_]"
    starts = f"list_transform(range(1, len(string_split({text}, {part}))), lambda j: (list_sum(list_transform(string_split({text}, {part})[1:j], lambda y: length(y))) + (j - 1) * length({part}))::INT)"
    left = f"regexp_matches(substr({text}, z, 1), '{word}') AND regexp_matches(substr({text}, z + 1, 1), '{word}') AND z > 0"
    right = f"regexp_matches(substr({text}, z + length({part}), 1), '{word}') AND regexp_matches(substr({text}, z + length({part}) + 1, 1), '{word}')"
    return f"list_filter({starts}, lambda z: NOT ({left}) AND NOT ({right}))"


_ERR = lambda cond, text: f"CASE WHEN {cond} THEN {text} END"
_SEED = "CASE WHEN f = 7 THEN 'core:09' ELSE 'core:01' END"
_CORE = [
    _ERR("NOT req OR f IN (7, 13)", f"'differs_from_plan:' || {_SEED}"),
    _ERR("NOT at_", f"'no_position:' || {_SEED}"),
    _ERR("f = 13", f"'bad_type:' || {_SEED}"),
    _ERR("f = 12", f"'no_evidence:' || {_SEED}"),
    _ERR("f = 12", f"'no_rationale:' || {_SEED}"),
]
_COV = [_ERR("NOT req", "'differs_from_plan:cov:01'"), _ERR("NOT req OR f = 2", "'no_position:cov:01'")]
_ERRORS = [
    _ERR("NOT req", "'no_request'"),
    _ERR("f = 2", "'no_marked_text'"),
    _ERR("f = 3", "'source_case'"),
    _ERR("length(raw) NOT BETWEEN 20 AND 1500", "'length'"),
    _ERR(" OR ".join(f"contains(lower(raw), '{p}')" for p in vocab.listed(vocab.META_PHRASES)), "'meta_text'"),
    _ERR("NOT req OR f = 4", "'document_format'"),
    _ERR("f = 5", "'section_path'"),
    _ERR(f"req AND NOT contains(raw, '{_HEAD}')", "'no_heading'"),
    _ERR("req AND f = 5", "'heading_not_in_path'"),
    _ERR(r"regexp_matches(raw, '(?m)^\s*\|.*\|.*\|\s*$') OR regexp_matches(raw, '(?m)^\s*\|?\s*:?-{3,}')", "'table'"),
    _ERR("f = 6", "'no_mentions'"),
    _ERR("f = 11", "'seed_repeated'"),
    _ERR("req AND f IN (6, 7)", "'seed_missing'"),
    _ERR("f = 7 OR NOT req", "'seed_unexpected'"),
    _ERR(f"regexp_matches(raw, '{_UNITS}')", "'unplanned_measurement'"),
    _ERR("f = 8", "'unplanned_mark:core:02'"),
    _ERR("NOT req", "'unplanned_mark:core:01'"),
    _ERR("f IN (2, 8)", "'missing_mark:core:01'"),
    _ERR("req AND two AND len(inner_) = 0", "'covered_missing:cov:01'"),
    _ERR("req AND two AND len(outer_) > 0", "'covered_outside:cov:01'"),
    _ERR("req AND len(places) <> 1", "'occurrence_count:' || x0"),
]


@query(
    f"""WITH {DRAFTS_SQL},
o AS (SELECT *, {occurrences_sql('raw', 'x0')} AS places, {occurrences_sql('raw', 'last')} AS lasts FROM dr),
c AS (SELECT *, list_filter(lasts, lambda z: len(list_filter(places, lambda h: h <= z AND z + length(last) <= h + length(x0))) > 0) AS inner_, list_filter(lasts, lambda z: len(list_filter(places, lambda h: h <= z AND z + length(last) <= h + length(x0))) = 0) AS outer_ FROM o),
e AS (SELECT *, list_filter(list_concat([{", ".join(_ERRORS)}], list_concat(CASE WHEN f = 6 THEN [] WHEN f = 11 THEN list_concat([{", ".join(_CORE)}], [{", ".join(_CORE)}]) ELSE [{", ".join(_CORE)}] END, CASE WHEN two AND f <> 6 THEN [{", ".join(_COV)}] ELSE [] END)), lambda y: y IS NOT NULL) AS errors,
  list_filter([{_ERR("req AND length(raw) NOT BETWEEN 40 AND 300", "'length_budget'")}, {_ERR("f = 12", "'evidence_not_anchored'")}, {_ERR("req AND CASE f WHEN 6 THEN 0 WHEN 11 THEN 2 ELSE 1 END <> 1", "'labelled_budget'")}], lambda y: y IS NOT NULL) AS flags FROM c)
SELECT id AS draft_id, array_to_string(list_sort(errors), ',') AS errors, array_to_string(list_sort(flags), ',') AS flags, CASE WHEN len(errors) > 0 THEN 'rejected' WHEN len(flags) > 0 THEN 'valid_with_flags' ELSE 'valid' END AS status FROM e"""
)
def draft_errors(spark, sf_dir):
    """What the audit finds in drafts with planted faults."""
    drafts, reqs = drafts_and_requests(spark, sf_dir)
    found = jobs.draft_audit(drafts, reqs)
    return found.select("draft_id", F.array_join(F.array_sort("errors"), ",").alias("errors"), F.array_join(F.array_sort("quality_flags"), ",").alias("flags"), "status")


_TERMS = ("gắng sức", "khó thở", "tiền sử", "khám", "đau")


@query(
    f"""WITH {NOTES_SQL}, t AS (SELECT unnest([{listed(_TERMS)}]) AS term), o AS (SELECT id, x0, s, text, {occurrences_sql('text', 'x0')} AS own FROM notes),
h AS (SELECT o.id, term, own, x0, unnest({occurrences_sql('lower(text)', 'term')}) AS z FROM o, t),
k AS (SELECT id, term, count(*) AS n FROM h WHERE len(list_filter(own, lambda y: y < z + length(term) AND z < y + length(x0))) = 0 AND z >= 5 GROUP BY ALL)
SELECT n.id, coalesce(string_agg(term || '=' || k.n, ',' ORDER BY term), '') AS terms, max(len(regexp_extract_all(n.text, '{_UNITS}')))::INT AS measured FROM notes n LEFT JOIN k USING (id) GROUP BY n.id"""
)
def unplanned_mentions(spark, sf_dir):
    """Measurements and lexicon terms that lie outside the planned surface and the heading."""
    rows = notes(spark, sf_dir).withColumn("terms", F.array(*map(F.lit, sorted(_TERMS, key=lambda t: (-len(t), t)))))
    plan = F.array(contract.planned_item(F.lit("core:01"), F.col("surface"), F.lit(vocab.TEST), F.lit(True), empty("array<string>"), F.lit("core")))
    # the first five characters stand for the heading
    found = rows.withColumn("x", contract.unplanned(F.col("text"), plan, F.lit(""), F.col("terms")))
    names = F.transform(F.filter("x.terms", lambda h: h["start"] >= 5), lambda h: h["term"])
    counted = F.transform(F.array_sort(F.array_distinct(names)), lambda t: F.concat_ws("=", t, F.size(F.filter(names, lambda n: n == t))))
    return found.select("id", F.array_join(counted, ",").alias("terms"), F.size("x.measurements").alias("measured"))


@query(f"WITH {NOTES_SQL} SELECT id, len({occurrences_sql('text', 'x0')})::INT AS n, length(regexp_replace(x0, '^[{WS}]+|[{WS}]+$', '', 'g'))::INT AS bare FROM notes")
def surface_places(spark, sf_dir):
    """Word-bounded places of every labelled surface in its note."""
    return notes(spark, sf_dir).select("id", F.size(occurrences(F.col("text"), F.col("surface"))).alias("n"), F.length(strip(F.col("surface"))).alias("bare"))
