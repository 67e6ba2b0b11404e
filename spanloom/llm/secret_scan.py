"""Secret scans: strong patterns, and weak parts that are linked before they count.

The base kinds are reported on sight. The other parts of a credential are weak on
their own: an account name, a long mixed token, an address. They are reported only
where complementary parts stand within ``SCOPE`` code points of each other:

* a token, when an identifier or an address stands near it;
* an identifier, when a secret (a token or a base span) stands near it;
* an address, when both an identifier and a secret stand near it.

The link is an interval join. A part of the role looked for is entered under its
bin of ``SCOPE`` code points, and each bin keeps only its first and last start; a
weak part probes its own and the two neighbouring bins. Two starts in one bin are
always within the scope, and the nearest starts of the neighbouring bins decide
for those, so the join is exact with at most three probes for each part and
no pair of parts is ever emitted.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, quoted
from .spans import HIT, SPAN, find, joined, labelled

SCOPE = 256


class Part(NamedTuple):
    name: str
    role: str
    #: A cheap pattern or plain string that every text with a hit holds.
    needs: str
    pattern: str
    valid: Callable[[Column], Column]
    base: bool


_VALUE = "A-Za-z0-9+/_.=-"
_KEYS = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_NAMES = r"(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_[Ii][Dd])"


def _long_value(h: Column) -> Column:
    # what follows the sign and an optional quote is group 2 of the base pattern
    return F.length(F.regexp_extract(h["hit"], rf"[:=]\x20*[\"']?([{_VALUE}]+)\z", 1)) >= 6


def _mixed(h: Column) -> Column:
    s = h["hit"]
    return s.rlike("[0-9]") & s.rlike("[a-z]") & s.rlike("[A-Z]")


PARTS = (
    Part("assign", "secret", "[:=]", rf"{_KEYS}[\"']?\x20*+[:=]\x20*+[\"']?[{_VALUE}]+", _long_value, True),
    Part("access", "identifier", "AKIA", r"AKIA[A-Z0-9]+", lambda h: F.length(h["hit"]) >= 20, True),
    Part("hex", "secret", "[0-9a-f]{24}", r"(?<![0-9a-f])[0-9a-f]{24,}+", lambda h: F.lit(True), True),
    Part("token", "secret", "[A-Za-z0-9+/_=-]{32}", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}+", _mixed, False),
    Part("identifier", "identifier", "[:=]", rf"{_NAMES}[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9._@-]+", lambda h: F.lit(True), False),
    Part("endpoint", "endpoint", "://", r"[a-z]++://[^\x20\x09-\x0D\"'<>]+", lambda h: F.lit(True), False),
)

# A weak part's role, and the roles that must stand near it (any set of one line).
LINKS = {"token": ({"identifier"}, {"endpoint"}), "identifier": ({"secret"},), "endpoint": ({"identifier", "secret"},)}


def parts_of(text: Column, part: Part) -> Column:
    present = text.rlike(part.needs) if "[" in part.needs else text.contains(part.needs)
    return F.when(present, F.filter(find(text, part.pattern), part.valid)).otherwise(F.array().cast(HIT))


def outside(weak: Column, strong: Column) -> Column:
    """Weak spans that touch no strong one; each is held against all strong spans of its text."""
    return F.when(F.size(strong) == 0, weak).otherwise(
        F.filter(weak, lambda w: ~F.exists(strong, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    )


def link(parts: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """Weak parts with all complementary roles within ``scope`` starts of them.

    parts: key columns, kind, role, start, end, base (boolean).
    """
    where = parts.withColumn("bin", F.floor(F.col("start") / scope))
    roles = where.groupBy(*key, "bin", "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    weak = where.filter(~F.col("base")).withColumnRenamed("role", "own")
    probes = weak.select(*key, "kind", "own", "start", "end", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = (
        probes.join(roles, [*key, "bin"])
        .filter(F.col("role") != F.col("own"))
        .filter(
            (F.floor(F.col("start") / scope) == F.col("bin"))
            | ((F.col("lo") > F.col("start")) & (F.col("lo") - F.col("start") <= scope))
            | ((F.col("hi") < F.col("start")) & (F.col("start") - F.col("hi") <= scope))
        )
        .groupBy(*key, "kind", "start", "end")
        .agg(F.collect_set("role").alias("roles"))
    )
    complete = F.lit(False)
    for kind, sets in LINKS.items():
        for needed in sets:
            complete |= (F.col("kind") == kind) & F.forall(F.array(*map(F.lit, sorted(needed))), lambda r: F.array_contains("roles", r))
    return near.filter(complete).select(*key, "kind", "start", "end")


def scan(docs: DataFrame, text: str = "text", out: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """Append ``out``: all spans (start, ord, end, kind) sorted, and ``out``_base: those of the base kinds.

    Offsets count code points, ends are exclusive. A null or empty text has no
    spans. Parts are linked within one text only: its rows are told apart by all
    kept columns' row, so repeated rows each get their own full result. A very long text is
    searched whole. An empty table gives an empty one; columns that already have these
    names are replaced, others may have any name.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (out, f"{out}_base")]
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    names = [f"{out}_{p.name}__part" for p in PARTS]
    found = docs.select(*[F.col(quoted(c)) for c in keep], F.sha2(t, 256).alias(f"{out}__key"), *[parts_of(t, p).alias(n) for p, n in zip(PARTS, names)])
    spans = {p.name: labelled(F.col(quoted(n)), p.name, i) for i, (p, n) in enumerate(zip(PARTS, names))}
    base = F.concat(F.array().cast(SPAN), *[spans[p.name] for p in PARTS if p.base])
    loose = F.concat(F.array().cast(SPAN), *[spans[p.name] for p in PARTS if not p.base])
    both = found.select(*[F.col(quoted(c)) for c in keep], f"{out}__key", let(F.struct(base.alias("b"), loose.alias("w")), lambda x: F.struct(x["b"].alias("b"), outside(x["w"], x["b"]).alias("w"))).alias(f"{out}__parts"))
    # written once: the patterns would run again for every branch below
    rows = materialise(both, "parts")
    p = F.col(f"{out}__parts")
    role = F.create_map(*[F.lit(x) for q in PARTS for x in (q.name, q.role)])
    texts = rows.filter(F.size(p["w"]) > 0).groupBy(f"{out}__key").agg(F.first(p).alias("p"))
    parts = texts.select(f"{out}__key", F.explode(F.concat(F.transform(F.col("p")["b"], lambda s: s.withField("base", F.lit(True))), F.transform(F.col("p")["w"], lambda s: s.withField("base", F.lit(False))))).alias("s"))
    parts = parts.select(f"{out}__key", "s.kind", role[F.col("s.kind")].alias("role"), "s.start", "s.end", "s.base")
    order = F.create_map(*[F.lit(x) for i, q in enumerate(PARTS) for x in (q.name, i)])
    linked = (
        link(parts, [f"{out}__key"])
        .groupBy(f"{out}__key")
        .agg(F.collect_list(F.struct("start", order[F.col("kind")].alias("ord"), "end", "kind")).cast(SPAN).alias(f"{out}__linked"))
    )
    # Texts without weak parts, nearly all, need no join and are not shuffled.
    plain = rows.filter(F.size(p["w"]) == 0).withColumn(f"{out}__linked", F.array().cast(SPAN))
    merged = rows.filter(F.size(p["w"]) > 0).join(linked, f"{out}__key", "left").unionByName(plain)
    everything = F.sort_array(F.concat(p["b"], F.coalesce(F.col(f"{out}__linked"), F.array().cast(SPAN))))
    return merged.select(*[F.col(quoted(c)) for c in keep], everything.alias(out), F.sort_array(p["b"]).alias(f"{out}_base"))


def summary(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans of each document."""
    found = scan(docs, keep=["doc_id"])
    count = lambda k: F.size(F.filter("secrets_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("secrets_base")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every reported span by ``mark``; texts without one, nulls included, stay as they are.

    Overlapping spans are covered by one mark each time a new stretch begins. All columns
    stay, whatever their names; an empty table gives an empty one.
    """
    # names of our own for all columns, so that none of theirs can clash
    names = [f"c{i}" for i in range(len(docs.columns))]
    body = names[docs.columns.index(text)]
    found = scan(docs.select(*[F.col(quoted(c)).alias(n) for c, n in zip(docs.columns, names)]), text=body, out="spans", keep=names)
    t = F.col(body)

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        piece = F.when(fresh, F.concat(F.substr(t, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], piece).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(F.col("spans"), start, step, lambda s: F.concat(s["out"], F.substr(t, s["at"] + 1, F.length(t))))
    new = F.when(F.size("spans") > 0, clean).otherwise(t)
    return found.select(*[(new if n == body else F.col(n)).alias(c) for c, n in zip(docs.columns, names)])


def duckdb_sql() -> str:
    """The summary for DuckDB: base spans by pattern, weak parts by an interval self-join of each text."""
    q = lambda s: s.replace("'", "''")
    patterns = {
        "assign": rf"{_KEYS}[\"']?\x20*[:=]\x20*[\"']?[{_VALUE}]+",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]{24,}",
        "token": r"[A-Za-z0-9+/_=-]{32,}",
        "identifier": rf"{_NAMES}[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]+",
        "endpoint": r"[a-z]+://[^\x20\x09-\x0D\"'<>]+",
    }
    valid = {
        "assign": f"length(regexp_extract(hit, '{q(rf'[:=]\x20*["\']?([{_VALUE}]+)$')}', 1)) >= 6",
        "access": "length(hit) >= 20",
        "token": "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')",
    }
    hits = " UNION ALL ".join(
        f"SELECT rid, '{k}' AS kind, {i} AS ord, '{PARTS[i].role}' AS role, {PARTS[i].base} AS base, unnest(range(1, len(h) + 1)) AS i, h, g FROM (SELECT rid, regexp_extract_all(t, '{q(p)}') AS h, string_split_regex(t, '{q(p)}') AS g FROM d)"
        for i, (k, p) in enumerate(patterns.items())
    )
    case = " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in valid.items())
    near = lambda role: f"EXISTS (SELECT 1 FROM loose o WHERE o.rid = w.rid AND o.role = '{role}' AND abs(o.s - w.s) <= {SCOPE})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({hits}),
placed AS (
  SELECT rid, kind, ord, role, base, h[i] AS hit,
    coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS s
  FROM hits),
valid AS (SELECT rid, kind, ord, role, base, s::BIGINT AS s, (s + length(hit))::BIGINT AS e FROM placed WHERE CASE {case} ELSE true END),
loose AS (
  SELECT * FROM valid v WHERE base OR NOT EXISTS (SELECT 1 FROM valid b WHERE b.base AND b.rid = v.rid AND b.s < v.e AND v.s < b.e)),
kept AS (
  SELECT * FROM loose w WHERE base
    OR (kind = 'token' AND ({near("identifier")} OR {near("endpoint")}))
    OR (kind = 'identifier' AND {near("secret")})
    OR (kind = 'endpoint' AND {near("identifier")} AND {near("secret")})),
made AS (
  SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE base) AS based,
    count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex
  FROM kept GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN made USING (rid)
"""
