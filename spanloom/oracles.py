"""DuckDB SQL of the registered queries that need more than a statement or two.

Greedy folds (matching, suppression, overlap resolution, packing) are recursive CTEs that
take one item of a document at a time, in the order that the operator states.
"""

from __future__ import annotations

from .functions import vocab

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOK = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]"
WORD = rf"[^{WS}]+"
EDGE = r" \t\r\n,:;.·•()\[\]\"'…\-–—"


def listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


TYPE_LIST = f"[{listed(vocab.TYPES)}]"
BEARING = listed(vocab.ASSERTION_TYPES)

TOKENS_SQL = rf"""
tk AS (SELECT doc_id, text, regexp_extract_all(text, '([{WS}]*)({TOK})', 1) AS g, regexp_extract_all(text, '([{WS}]*)({TOK})', 2) AS t FROM documents),
tx AS (SELECT doc_id, unnest(range(len(t))) AS i, unnest(g) AS gap, unnest(t) AS tok FROM tk),
tokens AS (SELECT doc_id, i, tok, (sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i))::INT AS e, length(tok) AS n FROM tx)"""


def hashed(*parts: str) -> str:
    """The first 8 hex digits of sha256 of the parts joined by a colon, as a number."""
    return "('0x' || substr(sha256(" + " || ':' || ".join(parts) + "), 1, 8))::BIGINT"


def spans_sql(seed: str, name: str = "spans") -> str:
    return f"""
{name}_h AS (SELECT doc_id, i, e - n AS s, e, {hashed(f"'{seed}'", 'doc_id', 'i')} AS h FROM tokens),
{name} AS (
  SELECT a.doc_id, a.i, a.s AS "start", b.e AS "end", {TYPE_LIST}[(a.h // 1000) % 5 + 1] AS "type", (a.h // 40000) % 100 AS conf, (a.h // 5000) % 8 AS flags
  FROM (SELECT * FROM {name}_h WHERE h % 40 = 0) a JOIN {name}_h b ON a.doc_id = b.doc_id AND b.i = a.i + (a.h // 64) % 3)"""


def marks_of(flags: str, kind: str) -> str:
    each = ", ".join(f"CASE WHEN ({flags} // {1 << k}) % 2 = 1 THEN '{a}' END" for k, a in enumerate(vocab.ASSERTIONS))
    return f"CASE WHEN {kind} IN ({BEARING}) THEN list_filter([{each}], lambda a: a IS NOT NULL) ELSE []::VARCHAR[] END"


def entities_sql(spans: str, name: str) -> str:
    """Entities (doc_id, k, s, e, t, x, marks) of derived spans in their order."""
    return f"""
{name} AS (
  SELECT p.doc_id, (row_number() OVER (PARTITION BY p.doc_id ORDER BY p.i) - 1)::INT AS k, p."start" AS s, p."end" AS e, p."type" AS t,
    substr(d.text, p."start" + 1, p."end" - p."start") AS x, {marks_of('p.flags', 'p."type"')} AS marks
  FROM {spans} p JOIN documents d USING (doc_id))"""


GOLD_SQL = f"{TOKENS_SQL},{spans_sql('g')},{entities_sql('spans', 'gold')}"
_P = hashed("'p'", "doc_id", "s", "e")
PAIRS_SQL = f"""{GOLD_SQL},{spans_sql('q', 'fresh')},{entities_sql('fresh', 'fresh_e')},
kept_p AS (SELECT *, {_P} AS h FROM gold),
pred AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1)::INT AS k, s, e, t, x, marks FROM (
    SELECT doc_id, 0 AS part, k, s, e, CASE WHEN h % 8 = 1 THEN '{vocab.DRUG}' ELSE t END AS t, x, marks FROM kept_p WHERE h % 4 <> 0
    UNION ALL SELECT doc_id, 1, k, s, e, t, x, marks FROM fresh_e)),
pairs AS (
  SELECT g.doc_id, g.k AS gi, p.k AS pi, row_number() OVER (PARTITION BY g.doc_id ORDER BY least(g.e, p.e) - greatest(g.s, p.s) DESC, g.k, p.k) AS r
  FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e AND g.t = p.t),
walk AS (
  SELECT doc_id, r, gi, pi, true AS took, [gi] AS ug, [pi] AS up FROM pairs WHERE r = 1
  UNION ALL
  SELECT n.doc_id, n.r, n.gi, n.pi, NOT list_contains(w.ug, n.gi) AND NOT list_contains(w.up, n.pi),
    CASE WHEN list_contains(w.ug, n.gi) OR list_contains(w.up, n.pi) THEN w.ug ELSE list_append(w.ug, n.gi) END,
    CASE WHEN list_contains(w.ug, n.gi) OR list_contains(w.up, n.pi) THEN w.up ELSE list_append(w.up, n.pi) END
  FROM walk w JOIN pairs n ON n.doc_id = w.doc_id AND n.r = w.r + 1),
hit AS (
  SELECT g.doc_id, g.s AS gs, g.e AS ge, g.t AS gt, g.x AS gx, g.marks AS gm, p.k AS pk, p.s AS ps, p.e AS pe, p.x AS px, p.marks AS pm
  FROM walk w JOIN gold g ON g.doc_id = w.doc_id AND g.k = w.gi JOIN pred p ON p.doc_id = w.doc_id AND p.k = w.pi WHERE w.took)"""


def prf(tp: str, pred: str, gold: str) -> str:
    p, r = f"coalesce(100::DOUBLE * {tp} / nullif({pred}, 0), 0.0)", f"coalesce(100::DOUBLE * {tp} / nullif({gold}, 0), 0.0)"
    return f"{p}::DOUBLE AS p, {r}::DOUBLE AS r, coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0)::DOUBLE AS f1"


SCORES = f"""WITH RECURSIVE {PAIRS_SQL},
n AS (SELECT (SELECT count(*) FROM hit) AS tp, (SELECT count(*) FROM pred) AS pred, (SELECT count(*) FROM gold) AS gold),
a AS (SELECT unnest([{listed(vocab.ASSERTIONS)}]) AS key),
rows_ AS (
  SELECT 'micro' AS scope, 'all' AS key, tp, pred, gold FROM n
  UNION ALL SELECT 'exact', 'all', (SELECT count(*) FROM hit WHERE gs = ps AND ge = pe), pred, gold FROM n
  UNION ALL SELECT 'type', key, (SELECT count(*) FROM hit WHERE gt = key), (SELECT count(*) FROM pred WHERE t = key), (SELECT count(*) FROM gold WHERE t = key)
    FROM (SELECT DISTINCT t AS key FROM (SELECT t FROM gold UNION ALL SELECT t FROM pred))
  UNION ALL SELECT 'assertion', key, (SELECT count(*) FROM hit WHERE gt IN ({BEARING}) AND list_contains(gm, key) AND list_contains(pm, key)),
    (SELECT count(*) FROM hit WHERE gt IN ({BEARING}) AND list_contains(pm, key)), (SELECT count(*) FROM hit WHERE gt IN ({BEARING}) AND list_contains(gm, key)) FROM a)
SELECT scope, key, tp::BIGINT AS tp, pred::BIGINT AS pred, gold::BIGINT AS gold, {prf('tp', 'pred', 'gold')} FROM rows_"""

BOUNDARY = f"""WITH RECURSIVE {PAIRS_SQL}
SELECT count(*) AS matched, count(*) FILTER (WHERE gs = ps AND ge = pe) AS exact,
  coalesce(sum(len(regexp_extract_all(px, '{WORD}')) - len(regexp_extract_all(gx, '{WORD}'))), 0)::BIGINT AS extra_words FROM hit"""

CONFUSION = f"""WITH RECURSIVE {PAIRS_SQL},
lone AS (SELECT p.* FROM pred p ANTI JOIN hit h ON h.doc_id = p.doc_id AND h.pk = p.k),
firsts AS (SELECT l.doc_id, l.k, l.t AS pred_type, arg_min(g.t, g.k) AS gold_type FROM lone l JOIN gold g ON g.doc_id = l.doc_id AND g.t <> l.t AND g.s < l.e AND l.s < g.e GROUP BY ALL)
SELECT gold_type, pred_type, count(*) AS n FROM firsts GROUP BY ALL ORDER BY n DESC, gold_type, pred_type LIMIT 6"""


def leakage_scores(leak: str) -> str:
    part = lambda name, where: (
        f"SELECT 'model' AS name, '{name}' AS files, (SELECT count(*) FROM hit {where}) AS tp, (SELECT count(*) FROM pred {where}) AS pred, (SELECT count(*) FROM gold {where}) AS gold"
    )
    clean = "WHERE doc_id IN (SELECT doc_id FROM r WHERE share <= 0.10)"
    return f"""WITH RECURSIVE {PAIRS_SQL},{leak},
z AS ({part('full', '')} UNION ALL {part('clean', clean)})
SELECT name, files, tp::BIGINT AS tp, pred::BIGINT AS pred, gold::BIGINT AS gold, {prf('tp', 'pred', 'gold')} FROM z"""


_LABEL = f"['O', 'B-X', 'I-X', 'B-Y', 'I-Y'][{hashed(chr(39) + 'b' + chr(39), 'doc_id', 'i')} % 5 + 1]"


def _runs(label: str, name: str) -> str:
    return f"""
{name}_l AS (SELECT doc_id, i, {label} AS l FROM tokens),
{name}_p AS (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY i) AS pl FROM {name}_l),
{name}_s AS (SELECT *, l <> 'O' AND (l[1] = 'B' OR pl IS NULL OR pl = 'O' OR substr(pl, 3) <> substr(l, 3)) AS opens FROM {name}_p),
{name}_r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM {name}_s WHERE l <> 'O'),
{name} AS (SELECT doc_id, min(i) AS a, max(i) AS b, min(substr(l, 3)) AS t FROM {name}_r GROUP BY doc_id, run)"""


TAGS = f"""WITH {TOKENS_SQL},{_runs(_LABEL, 'g')},{_runs(f"CASE WHEN i % 7 = 0 THEN 'O' ELSE {_LABEL} END", 'p')},
c AS (SELECT t AS key, count(*) FILTER (WHERE side = 'tp') AS tp, count(*) FILTER (WHERE side = 'pred') AS pred, count(*) FILTER (WHERE side = 'gold') AS gold FROM (
  SELECT t, 'gold' AS side FROM g UNION ALL SELECT t, 'pred' FROM p UNION ALL SELECT g.t, 'tp' FROM g JOIN p USING (doc_id, a, b, t)) GROUP BY t),
z AS (SELECT * FROM c UNION ALL SELECT 'all', sum(tp), sum(pred), sum(gold) FROM c)
SELECT key, tp::BIGINT AS tp, pred::BIGINT AS pred, gold::BIGINT AS gold, {prf('tp', 'pred', 'gold')} FROM z"""

PREDICTED = f"""WITH {TOKENS_SQL},{_runs("CASE lower(tok) WHEN 'the' THEN 'B-S' WHEN 'of' THEN 'I-S' WHEN 'and' THEN 'B-D' ELSE 'O' END", 'g')}
SELECT d.doc_id::VARCHAR AS id, count(g.a)::INT AS n FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id"""

# --- repeated surfaces

_OCC = rf"""{GOLD_SQL},
surf AS (SELECT doc_id, x, arg_min(t, k) AS t FROM gold WHERE length(x) >= 3 GROUP BY doc_id, x),
cut AS (SELECT s.doc_id, s.x, s.t, d.text, length(s.x) AS n, string_split(d.text, s.x) AS parts FROM surf s JOIN documents d USING (doc_id)),
found AS (SELECT doc_id, x, t, text, n, parts, unnest(range(1, len(parts))) AS j FROM cut),
at_ AS (SELECT doc_id, x, text, n, (list_sum(list_transform(parts[1:j], lambda y: length(y))) + (j - 1) * n)::INT AS s FROM found),
occ AS (SELECT doc_id, x, s, n FROM at_
  WHERE NOT (s > 0 AND regexp_matches(substr(text, s, 1), '[\p{{L}}\p{{N}}_]') AND regexp_matches(substr(text, s + 1, 1), '[\p{{L}}\p{{N}}_]'))
    AND NOT (regexp_matches(substr(text, s + n, 1), '[\p{{L}}\p{{N}}_]') AND regexp_matches(substr(text, s + n + 1, 1), '[\p{{L}}\p{{N}}_]'))),
brk AS (SELECT doc_id, string_split_regex(text, '[.!?…][{WS}]|\n') AS g, regexp_extract_all(text, '[.!?…][{WS}]|\n') AS h FROM documents),
ends AS (SELECT doc_id, list_transform(range(1, len(h) + 1), lambda j: list_sum(list_transform(g[1:j], lambda y: length(y))) + list_sum(list_transform(h[1:j], lambda y: length(y)))) AS ends FROM brk),
flag AS (
  SELECT o.doc_id, o.x, o.s, len(list_filter(z.ends, lambda y: y <= o.s)) AS sent,
    EXISTS (SELECT 1 FROM gold e WHERE e.doc_id = o.doc_id AND e.s <= o.s AND o.s + o.n <= e.e AND NOT (e.s = o.s AND e.e = o.s + o.n)) AS hidden,
    EXISTS (SELECT 1 FROM gold e WHERE e.doc_id = o.doc_id AND e.x = o.x AND e.s = o.s) AS own
  FROM occ o JOIN ends z USING (doc_id)),
near AS (SELECT f.*, EXISTS (SELECT 1 FROM flag o WHERE o.doc_id = f.doc_id AND o.x = f.x AND o.own AND NOT o.hidden AND f.s - o.s > 0 AND f.s - o.s < 100 AND o.sent = f.sent) AS near FROM flag f),
report AS (
  SELECT s.doc_id::VARCHAR AS file, s.x AS surface, s.t AS "type", count(f.s) FILTER (WHERE NOT hidden)::INT AS occurrence_count,
    count(f.s) FILTER (WHERE NOT hidden AND own)::INT AS selected_count, count(f.s) FILTER (WHERE NOT hidden AND NOT own)::INT AS omitted_count,
    count(f.s) FILTER (WHERE hidden)::INT AS covered_count, count(f.s) FILTER (WHERE NOT hidden AND own AND near)::INT AS near_same_sentence_taken,
    count(f.s) FILTER (WHERE NOT hidden AND NOT own AND near)::INT AS near_same_sentence_omitted,
    count(f.s) FILTER (WHERE NOT hidden AND NOT own) > 0 AND count(f.s) FILTER (WHERE NOT hidden AND own) = 1 AND coalesce(arg_min(own, f.s) FILTER (WHERE NOT hidden), false) AS first_only
  FROM surf s LEFT JOIN near f ON f.doc_id = s.doc_id AND f.x = s.x GROUP BY s.doc_id, s.x, s.t)"""
OCCURRENCES = f"WITH {_OCC} SELECT * FROM report"


def _summary(by: str) -> str:
    pct = lambda a, b: f"coalesce(100::DOUBLE * {a} / nullif({b}, 0), 0.0)::DOUBLE"
    one = lambda c: f"coalesce(sum({c}), 0)"
    return f"""count(*) AS groups, coalesce(count(*)::DOUBLE / (SELECT count(*) FROM documents), 0.0) AS groups_per_record,
  {pct('count(*) FILTER (WHERE omitted_count = 0)', 'count(*)')} AS take_all_pct, {pct('count(*) FILTER (WHERE omitted_count > 0)', 'count(*)')} AS mixed_pct,
  {one('selected_count')}::BIGINT AS selected, {one('omitted_count')}::BIGINT AS omitted, {one('covered_count')}::BIGINT AS covered,
  {pct(one('near_same_sentence_taken'), '(' + one('near_same_sentence_taken') + ' + ' + one('near_same_sentence_omitted') + ')')} AS near_taken_pct,
  {pct('count(*) FILTER (WHERE first_only)', 'count(*) FILTER (WHERE omitted_count > 0)')} AS first_only_pct,
  {pct(one('selected_count'), '(' + one('selected_count') + ' + ' + one('omitted_count') + ')')} AS take_rate_pct
FROM report WHERE occurrence_count >= 2 {by}"""


OCCURRENCE_SUMMARY = f"""WITH {_OCC} SELECT "type", {_summary('GROUP BY "type"')}"""
OCCURRENCE_WARNINGS = f"""WITH {_OCC}, z AS (SELECT {_summary('')}),
none_ AS (SELECT count(*) AS n FROM documents d ANTI JOIN gold g ON g.doc_id = d.doc_id)
SELECT array_to_string(list_filter([CASE WHEN groups > 0 AND mixed_pct < 15 THEN 'mixed_low' END, CASE WHEN groups_per_record < 0.5 THEN 'few_groups' END,
  CASE WHEN n = 0 THEN 'no_empty_record' END, CASE WHEN covered = 0 THEN 'no_covered_occurrence' END, CASE WHEN first_only_pct > 60 THEN 'first_only_high' END], lambda y: y IS NOT NULL), ',') AS warnings FROM z, none_"""

# --- records with planted faults

FAULTY_SQL = f"""{TOKENS_SQL},{spans_sql('g')},
fault0 AS (SELECT p.doc_id, p.i, p.conf % 16 AS c, p."start" AS s, p."end" AS e, p."type" AS t, {marks_of('p.flags', 'p."type"')} AS marks, d.text, length(d.text) AS len FROM spans p JOIN documents d USING (doc_id)),
fault1 AS (
  SELECT doc_id, i, c, text, len,
    CASE WHEN c IN (5, 7) AND s > 0 THEN s - 1 ELSE s END AS s,
    CASE WHEN c = 2 THEN e + 1000000 WHEN c = 7 AND s > 0 THEN s WHEN c = 8 THEN least(e + 150, len) ELSE e END AS e,
    CASE WHEN c = 0 THEN 'XX' WHEN c = 4 THEN '{vocab.TEST}' ELSE t END AS t,
    CASE WHEN c = 3 THEN list_append(marks, 'isOdd') WHEN c = 4 THEN ['isNegated'] ELSE marks END AS marks,
    CASE WHEN c = 9 THEN ['K'] ELSE []::VARCHAR[] END AS candidates,
    substr(text, s + 1, e - s) AS plain
  FROM fault0),
fault2 AS (SELECT *, CASE WHEN c = 1 THEN plain || '!' WHEN c IN (5, 7, 8) THEN substr(text, s + 1, e - s) ELSE plain END AS x, unnest(CASE WHEN c = 6 THEN [0, 1] ELSE [0] END) AS copy FROM fault1),
faulty AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY i, copy) - 1)::INT AS k, s >= 0 AND s < e AND e <= len AS fits FROM fault2)"""
_BARE = lambda c: f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"

LINT = rf"""WITH {FAULTY_SQL},
f AS (SELECT *, {_BARE('x')} AS bare FROM faulty),
prev AS (SELECT doc_id, s, e, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e, t, x) AS p FROM f),
z AS (
  SELECT 'offset' AS grp, 'bad_position' AS tag FROM f WHERE NOT fits
  UNION ALL SELECT 'offset', 'empty_span' FROM f WHERE fits AND {_BARE('substr(text, s + 1, e - s)')} = ''
  UNION ALL SELECT 'offset', 'text_mismatch' FROM f WHERE fits AND substr(text, s + 1, e - s) <> x
  UNION ALL SELECT 'schema', 'bad_type' FROM f WHERE t NOT IN ({listed(vocab.TYPES)})
  UNION ALL SELECT 'schema', 'bad_assertion' FROM f WHERE len(list_filter(marks, lambda a: a NOT IN ({listed(vocab.ASSERTIONS)}))) > 0
  UNION ALL SELECT 'schema', 'assertion_on_forbidden_type' FROM f WHERE len(marks) > 0 AND t NOT IN ({BEARING})
  UNION ALL SELECT 'span', 'line_break' FROM f WHERE fits AND contains(substr(text, s + 1, e - s), chr(10))
  UNION ALL SELECT 'span', 'token_misaligned' FROM f WHERE fits AND NOT (EXISTS (SELECT 1 FROM tokens q WHERE q.doc_id = f.doc_id AND q.e - q.n = f.s) AND EXISTS (SELECT 1 FROM tokens q WHERE q.doc_id = f.doc_id AND q.e = f.e))
  UNION ALL SELECT 'overlap', CASE WHEN e <= p THEN 'nested' ELSE 'overlap' END FROM prev WHERE s < p
  UNION ALL SELECT 'span', 'duplicate' FROM (SELECT doc_id, s, e, t FROM f GROUP BY ALL HAVING count(*) > 1))
SELECT grp, tag, count(*) AS n FROM z GROUP BY ALL"""

_EDGE = lambda a, b: f"(regexp_matches({a}, '[\\p{{L}}\\p{{N}}_]') AND regexp_matches({b}, '[\\p{{L}}\\p{{N}}_]'))"
LABELS = rf"""WITH {FAULTY_SQL},
nx AS (SELECT doc_id, e, lead(s) OVER (PARTITION BY doc_id ORDER BY s, e) AS ns FROM faulty),
z AS (
  SELECT 'bad_position' AS error FROM faulty WHERE NOT fits
  UNION ALL SELECT 'text_mismatch' FROM faulty WHERE fits AND substr(text, s + 1, e - s) <> x
  UNION ALL SELECT 'cut_word' FROM faulty WHERE fits AND ((s > 0 AND {_EDGE('substr(text, s, 1)', 'substr(text, s + 1, 1)')}) OR {_EDGE('substr(text, e, 1)', 'substr(text, e + 1, 1)')})
  UNION ALL SELECT 'bad_type' FROM faulty WHERE t NOT IN ({listed(vocab.TYPES)})
  UNION ALL SELECT 'bad_assertion' FROM faulty WHERE len(list_filter(marks, lambda a: a NOT IN ({listed(vocab.ASSERTIONS)}))) > 0
  UNION ALL SELECT 'assertion_on_type' FROM faulty WHERE len(marks) > 0 AND t NOT IN ({BEARING})
  UNION ALL SELECT 'candidates_on_type' FROM faulty WHERE len(candidates) > 0 AND t NOT IN ({listed(vocab.CANDIDATE_TYPES)})
  UNION ALL SELECT 'overlap' FROM (SELECT DISTINCT doc_id FROM nx WHERE ns < e))
SELECT error, count(*) AS n FROM z GROUP BY ALL"""


def keep_longest(items: str, name: str = "state") -> str:
    """The fold over items (doc_id, r, s, e): last kept place, kept and dropped so far."""
    return f"""
{name} AS (
  SELECT doc_id, r, s AS ls, e AS le, 1 AS kept, 0 AS dropped FROM {items} WHERE r = 1
  UNION ALL
  SELECT n.doc_id, n.r, CASE WHEN n.s >= w.le OR n.e - n.s > w.le - w.ls THEN n.s ELSE w.ls END, CASE WHEN n.s >= w.le OR n.e - n.s > w.le - w.ls THEN n.e ELSE w.le END,
    w.kept + (n.s >= w.le)::INT, w.dropped + (n.s < w.le)::INT
  FROM {name} w JOIN {items} n ON n.doc_id = w.doc_id AND n.r = w.r + 1),
{name}_end AS (SELECT doc_id, arg_max(kept, r)::INT AS kept, arg_max(dropped, r)::INT AS dropped FROM {name} GROUP BY doc_id)"""


KEEP_LONGEST = f"""WITH RECURSIVE {TOKENS_SQL},{spans_sql('g')},
items AS (SELECT doc_id, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", i) AS r FROM spans),{keep_longest('items')}
SELECT d.doc_id, coalesce(kept, 0)::INT AS kept, coalesce(dropped, 0)::INT AS dropped FROM documents d LEFT JOIN state_end USING (doc_id)"""

CLEANING = rf"""WITH RECURSIVE {FAULTY_SQL},
j AS (SELECT *, CASE WHEN fits THEN substr(text, s + 1, e - s) END AS own FROM faulty),
q AS (SELECT *, {_BARE('own')} AS bare, {_BARE('x')} AS said, list_filter(marks, lambda a: a IN ({listed(vocab.ASSERTIONS)})) AS legal, t IN ({BEARING}) AS bears FROM j),
m AS (SELECT *, CASE WHEN t NOT IN ({listed(vocab.TYPES)}) THEN 'bad_type' WHEN NOT fits OR bare = '' OR said <> bare THEN 'bad_offset' WHEN contains(bare, chr(10)) THEN 'line_break' END AS reason,
  s + length(own) - length(regexp_replace(own, '^[{WS}]+', '')) AS ts, len(marks) > len(CASE WHEN bears THEN legal ELSE []::VARCHAR[] END) AS repaired FROM q),
u AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY doc_id, reason IS NULL, CASE WHEN reason IS NULL THEN ts END, CASE WHEN reason IS NULL THEN length(bare) END, CASE WHEN reason IS NULL THEN t END ORDER BY k) > 1 THEN 'duplicate' ELSE reason END AS why FROM m),
items AS (SELECT doc_id, ts AS s, ts + length(bare) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY ts, ts + length(bare), k) AS r FROM u WHERE why IS NULL),{keep_longest('items')},
z AS (SELECT why AS reason, count(*) AS n FROM u WHERE why IS NOT NULL GROUP BY why
  UNION ALL SELECT 'assertion_repaired', count(*) FROM u WHERE why IS NULL AND repaired
  UNION ALL SELECT 'overlap', sum(dropped) FROM state_end)
SELECT reason, n::BIGINT AS n FROM z WHERE n > 0"""

NMS = f"""WITH RECURSIVE {TOKENS_SQL},{spans_sql('g')},
best AS (SELECT doc_id, "start" AS s, "end" AS e, "type" AS t, max(conf) AS c FROM spans GROUP BY ALL),
items AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, e - s DESC, s, t) AS r FROM best),
walk AS (
  SELECT doc_id, r, s, e, t, c, true AS took, [s] AS ks, [e] AS ke FROM items WHERE r = 1
  UNION ALL
  SELECT doc_id, r, s, e, t, c, free, CASE WHEN free THEN list_append(ks, s) ELSE ks END, CASE WHEN free THEN list_append(ke, e) ELSE ke END FROM (
    SELECT n.*, w.ks, w.ke, len(list_filter(range(1, len(w.ks) + 1), lambda y: w.ks[y] < n.e AND n.s < w.ke[y])) = 0 AS free
    FROM walk w JOIN items n ON n.doc_id = w.doc_id AND n.r = w.r + 1))
SELECT doc_id, s::INT AS "start", e::INT AS "end", t AS "type", (c / 100)::DOUBLE AS confidence FROM walk WHERE took"""

_NAMES = [*vocab.LABEL_MAP, "ORGAN"]
_GROUP = listed(vocab.DRUG_GROUP)
_MAPPED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.LABEL_MAP.items())
BASELINE = rf"""WITH {TOKENS_SQL},{spans_sql('g')},
a AS (SELECT p.doc_id, p."start" AS s0, [{listed(_NAMES)}][p.i % 5 + 1] AS t, substr(d.text, p."start" + 1, p."end" - p."start") AS x, d.text FROM spans p JOIN documents d USING (doc_id)),
one AS (SELECT doc_id, text, t, s0 + length(x) - length(regexp_replace(x, '^[{EDGE.replace("'", "''")}]+', '')) AS s, regexp_replace(x, '^[{EDGE.replace("'", "''")}]+|[{EDGE.replace("'", "''")}]+$', '', 'g') AS x FROM a),
trimmed AS (SELECT *, s + length(x) AS e FROM one WHERE x <> ''),
unblocked AS (SELECT * FROM trimmed WHERE lower({_BARE('x')}) NOT IN ({listed(vocab.BLOCKED_SURFACES)})),
w AS (SELECT *, lag(e) OVER q AS pe, lag(t) OVER q AS pt FROM unblocked WINDOW q AS (PARTITION BY doc_id ORDER BY s, e, t)),
b AS (SELECT *, CASE WHEN s - pe <= 3 AND (s <= pe OR regexp_matches(substr(text, pe + 1, s - pe), '^[\t\x0b-\r\x1c-\x20]*$')) AND (t = pt OR (t IN ({_GROUP}) AND pt IN ({_GROUP}))) THEN 0 ELSE 1 END AS brk FROM w),
c AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY s, e, t ROWS UNBOUNDED PRECEDING) AS run FROM b),
merged AS (SELECT doc_id, run, min(s) AS s, last(e ORDER BY s, e, t) AS e, CASE WHEN count(DISTINCT t) > 1 THEN '{vocab.DRUG_GROUP[0]}' ELSE min(t) END AS t, first(text) AS text FROM c GROUP BY doc_id, run),
final AS (SELECT DISTINCT doc_id, lower({_BARE('substr(text, s + 1, e - s)')}) AS key, CASE t {_MAPPED} END AS t FROM merged WHERE t IN ({listed(vocab.LABEL_MAP)}))
SELECT 'trimmed' AS stage, count(*) AS n FROM trimmed UNION ALL SELECT 'unblocked', count(*) FROM unblocked UNION ALL SELECT 'merged', count(*) FROM merged UNION ALL SELECT 'final', count(*) FROM final"""

CHUNKS = f"""WITH RECURSIVE {TOKENS_SQL},
c AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, n FROM tokens),
walk AS (
  SELECT doc_id, i, upto - n AS base, 1 AS k FROM c WHERE i = 0
  UNION ALL
  SELECT doc_id, i, base, k FROM (
    SELECT c.doc_id, c.i, c.upto - c.n AS base, w.k + 1 AS k, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.i) AS rn
    FROM walk w JOIN c ON c.doc_id = w.doc_id AND c.i > w.i AND c.i <= w.i + 512 AND c.upto - w.base > 512) WHERE rn = 1)
SELECT doc_id, max(k)::INT AS chunks FROM walk GROUP BY doc_id"""

UNCOVERED = f"""WITH {TOKENS_SQL},{spans_sql('g')},
n AS (SELECT doc_id, max(i) + 1 AS n FROM tokens GROUP BY doc_id),
x AS (SELECT s.doc_id, s.i, least(s.i + 70, n.n - 1) AS last, n.n FROM (SELECT * FROM spans WHERE conf < 50) s JOIN n USING (doc_id)),
u AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM range(0, 4000) w(k) WHERE w.k <= greatest(0, ceil((x.n - 180) / 135.0)) AND w.k * 135 <= x.i AND x.last < least(x.n, w.k * 135 + 180)))
SELECT u.doc_id AS id, (a.e - a.n)::INT AS "start", b.e::INT AS "end" FROM u JOIN tokens a ON a.doc_id = u.doc_id AND a.i = u.i JOIN tokens b ON b.doc_id = u.doc_id AND b.i = u.last"""


# --- cues


def cue_sql(chunk: str, cues, gap: int | None = None) -> str:
    """A cue that is no part of a word; without look-around the neighbours are consumed."""
    words = "|".join(c.replace("'", "''") for c in vocab.listed(cues))
    edge = "0-9a-zà-ỹ"
    tail = f"(?:$|[^{edge}])" if gap is None else f"(?:$|[^{edge}].{{0,{gap - 1}}}$)"
    return f"regexp_matches({chunk}, '(?s)(?:^|[^{edge}])(?:{words}){tail}')"


def clause_sql(text: str, at: str, window: int, hard: bool) -> str:
    ends = r"\. |\n|! |\? " + ("|; |, |: " if hard else "")
    return rf"regexp_replace(lower(substr({text}, greatest(0, {at} - {window}) + 1, {at} - greatest(0, {at} - {window}))), '(?s)^.*(?:{ends})', '')"


def support_sql(text: str, s: str, e: str, cues) -> dict[str, str]:
    """For each assertion whether a cue supports it."""
    before = clause_sql(text, s, 220, False)
    after = rf"regexp_extract(lower(substr({text}, {e} + 1, 26)), '^[^.!?\n]*')"
    dated = rf"(regexp_matches({before}, '(?:^|[^\p{{L}}\p{{N}}_])(?:19|20)\p{{Nd}}{{2}}(?:$|[^\p{{L}}\p{{N}}_])') OR contains({before}, '{vocab.YEAR_WORD}'))"
    out = {}
    for name, listed_ in cues.items():
        hit = cue_sql(before, listed_)
        if name == "isNegated":
            hit = f"({hit} OR {cue_sql(after, vocab.NEGATION_AFTER)})"
        if name == "isHistorical":
            hit = f"({hit} OR {dated})"
        out[name] = hit
    return out


def conflict_sql(text: str, s: str, cues) -> dict[str, str]:
    chunk = clause_sql(text, s, 30, True)
    out = {}
    for name, listed_ in cues.items():
        words = vocab.listed(listed_)
        hit = cue_sql(chunk, [w for w in words if w != vocab.QUANTITY_CUE], 18)
        if vocab.QUANTITY_CUE in words:
            next_ = rf"regexp_extract({chunk}, '(?s)^.*{vocab.QUANTITY_CUE}\s*([^ ]*)', 1)"
            hit = f"({hit} OR ({cue_sql(chunk, [vocab.QUANTITY_CUE], 18)} AND {next_} NOT IN ({listed(vocab.listed(vocab.QUANTITY_WORDS))})))"
        out[name] = hit
    return out


def chosen(flags: dict[str, str]) -> str:
    """The names whose condition holds, as a sorted list."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in sorted(flags.items())) + "], lambda a: a IS NOT NULL)"


def cue_findings(cues) -> str:
    return f"""WITH {TOKENS_SQL},{spans_sql('g')},
c AS (SELECT s.doc_id, s.i::INT AS i, {chosen(support_sql('d.text', 's.start', 's."end"', cues))} AS a, {chosen(conflict_sql('d.text', 's.start', cues))} AS b FROM spans s JOIN documents d USING (doc_id))
SELECT doc_id, i, array_to_string(a, ',') AS supported, array_to_string(b, ',') AS conflicting FROM c WHERE len(a) > 0 OR len(b) > 0"""


GENRES = f"""WITH {GOLD_SQL},
n AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY doc_id),
g AS (SELECT d.doc_id, length(text) AS chars, coalesce(n, 0) AS n, regexp_matches(text, '(?i)Câu hỏi từ người dùng|Câu trả lời của bác sĩ') AS asked,
  regexp_matches(text, '(?m)^[{WS}]*\\p{{Nd}}+[{WS}]*[.)][{WS}]*(?:Tiền sử|Bệnh sử|Lịch sử|Đánh giá|Khám)') AS rec FROM documents d LEFT JOIN n USING (doc_id)),
k AS (SELECT CASE WHEN asked AND rec THEN 'MIXED' WHEN asked THEN 'ADVICE' WHEN rec THEN 'RECORD' ELSE 'OTHER' END AS genre, chars, n FROM g)
SELECT coalesce(genre, '(all)') AS genre, count(*) AS notes, sum(chars)::BIGINT AS chars, sum(n)::BIGINT AS entities, 1000::DOUBLE * sum(n) / sum(chars) AS per_1k FROM k GROUP BY ROLLUP (genre)"""

DRAWS = f"""WITH b AS (SELECT doc_id, n_chars::DOUBLE AS w, {hashed('doc_id::VARCHAR')} % 64 AS b FROM documents),
c AS (SELECT doc_id, w, sum(w) OVER (ORDER BY b, doc_id) AS hi, sum(w) OVER () AS total FROM b),
u AS (SELECT k AS draw, {hashed("'7'", 'k')} / 4294967295.0 AS u FROM range(200) t(k))
SELECT u.draw::BIGINT AS draw, c.doc_id FROM u JOIN c ON u.u * total >= hi - w AND u.u * total < hi"""

WORDS = r"""SELECT conv_id, turn, len(regexp_split_to_array(trim(text), ' +'))::INT AS n, CASE WHEN trim(text) = '' THEN 0 ELSE length(rtrim(text, ' ')) END::INT AS last_end FROM conversations"""
COMPOSED = "SELECT doc_id, length(nfc_normalize(text))::INT AS n FROM documents"
REPLIES = """SELECT item_id::VARCHAR AS key, '{"verdict": "keep", "length": ' || length(text) || '}' AS reply FROM benchmark"""

_AMBIGUOUS = " OR ".join("starts_with(tx, '" + p + "')" for p in vocab.listed(vocab.AMBIGUOUS_PREFIXES))
GUARD = f"""WITH {TOKENS_SQL},
top_ AS (SELECT lower(tok) AS tx, count(*) AS n FROM tokens WHERE length(tok) >= 4 GROUP BY 1 ORDER BY n DESC, tx LIMIT 200),
kinds AS (SELECT tx, {TYPE_LIST}[{hashed("'c'", 'tx')} % 5 + 1] AS t FROM top_),
terms AS (SELECT tx FROM kinds WHERE t <> '{vocab.SYMPTOM}' AND tx NOT IN ({listed(vocab.listed(vocab.META_NOUNS))}) AND NOT ({_AMBIGUOUS}))
SELECT d.doc_id, least(12, count(k.tx))::INT AS hits FROM documents d LEFT JOIN (SELECT doc_id, lower(tok) AS tx FROM tokens) t ON t.doc_id = d.doc_id LEFT JOIN terms k ON k.tx = t.tx GROUP BY d.doc_id"""
