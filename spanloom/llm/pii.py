"""Personal data: patterns propose, checksums confirm, context words adjust a score.

Each row of ``KINDS`` names a pattern, a validator, a base score and the words that
raise it when they stand within ``spans.CONTEXT`` code points. The four base kinds
are certain once validated and always reported; the other kinds are reported when
their score reaches the threshold. Everything is a built-in expression of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted
from .spans import SPAN, digits_of, find, joined, labelled, luhn, mod97


class Kind(NamedTuple):
    name: str
    #: A plain string that every hit holds, tested first; "" tests for a digit.
    needs: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    boost: float
    base: bool


def _ip(h: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) <= 3, F.coalesce(F.try_to_number(F.concat(F.lit("0"), bare), F.lit("9999")).cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False))

    return F.forall(F.split(h["hit"], r"\.", -1), small)


def _card(h: Column) -> Column:
    digits = digits_of(h["hit"])
    n = F.length(digits)
    return F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))


def _phone(h: Column) -> Column:
    return F.length(digits_of(h["hit"])).between(9, 15)


def _apart(h: Column, sign: str) -> Column:
    """No character of the class beside the hit, so that it is not cut from a longer run."""
    return ~F.right(h["before"], F.lit(1)).rlike(sign) & ~F.left(h["after"], F.lit(1)).rlike(sign)


def _iban(h: Column) -> Column:
    fits = F.length(h["hit"]).between(15, 34) & _apart(h, "[A-Za-z0-9]")
    return F.when(fits, mod97(h["hit"])).otherwise(F.lit(False))


def _ssn(h: Column) -> Column:
    digits = digits_of(h["hit"])
    void = digits.rlike("^(000|666|9)") | (F.substr(digits, F.lit(4), F.lit(2)) == "00") | digits.rlike("0000$")
    return _apart(h, "[0-9A-Za-z-]") & ~void


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    # A local part is tried from the start of its run, or from where the last hit ended.
    Kind("email", "@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda h: F.lit(True), 1.0, "", 0.0, True),
    Kind("ip", "", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _ip, 1.0, "", 0.0, True),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++", _card, 1.0, "", 0.0, True),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 1.0, "", 0.0, True),
    Kind("iban", "", r"[A-Z][A-Z][0-9][0-9][A-Z0-9]+", _iban, 0.8, "iban|account|konto|compte|cuenta|bank", 0.2, False),
    Kind("ssn", "-", r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", _ssn, 0.3, "ssn|social security|tax id|taxpayer", 0.5, False),
)
THRESHOLD = 0.6


def candidates(text: Column, kind: Kind) -> Column:
    """Validated hits of one kind, each with its score."""
    present = text.contains(kind.needs) if kind.needs else text.rlike("[0-9]")
    hits = F.filter(find(text, kind.pattern), kind.valid)

    def scored(h: Column) -> Column:
        near = F.lower(F.concat_ws(" ", h["before"], h["after"])).rlike(kind.context) if kind.context else F.lit(False)
        return h.withField("score", F.lit(kind.score) + F.when(near, F.lit(kind.boost)).otherwise(F.lit(0.0)))

    kept = F.filter(F.transform(hits, scored), lambda h: h["score"] >= THRESHOLD)
    return F.when(present, kept).otherwise(F.array().cast(dict_type()))


def dict_type() -> str:
    return "array<struct<start:int,end:int,hit:string,before:string,after:string,score:double>>"


def detect(docs: DataFrame, kinds: Sequence[Kind] = KINDS, text: str = "text", out: str = "pii") -> DataFrame:
    """Append an array column for each kind, prefixed ``out``: hits with offsets, context and score.

    Offsets count code points, ends are exclusive. A null or empty text has no
    hits. Rows are independent: repeated rows give repeated results, an empty
    table an empty one. A very long text is searched whole, in time linear in its length but
    for its hits. Columns that already have these names are replaced.
    """
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    names = {f"{out}_{k.name}" for k in kinds}
    kept = [F.col(quoted(c)) for c in docs.columns if c not in names]
    return docs.select(*kept, *[candidates(t, k).alias(f"{out}_{k.name}") for k in kinds])


def span_list(kinds: Sequence[Kind] = KINDS, out: str = "pii", base_only: bool = False) -> Column:
    """All spans of ``detect``'s columns as one sortable array."""
    found = [labelled(F.col(f"{out}_{k.name}"), k.name, i) for i, k in enumerate(kinds) if k.base or not base_only]
    return F.concat(F.array().cast(SPAN), *found)


def summary(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans of each document."""
    found = detect(docs)
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(joined(span_list(base_only=True)), 256).alias("base_sha256"),
        joined(span_list()).alias("spans"),
    )


def duckdb_sql() -> str:
    """The same summary for DuckDB, whose expressions have no look-around."""
    local = f"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
    patterns = {
        "email": local,
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z][A-Z][0-9][0-9][A-Z0-9]+",
        "ssn": r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]",
    }
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn_sum = (
        f"list_sum(list_transform(range(0, length({digits})), lambda i: "
        f"CASE WHEN i % 2 = 1 AND substr({digits}, length({digits}) - i, 1)::INT > 4 THEN 2 * substr({digits}, length({digits}) - i, 1)::INT - 9 "
        f"WHEN i % 2 = 1 THEN 2 * substr({digits}, length({digits}) - i, 1)::INT ELSE substr({digits}, length({digits}) - i, 1)::INT END))"
    )
    turned = "(substr(hit, 5) || substr(hit, 1, 4))"
    mod = (
        f"list_reduce(list_prepend(0, list_transform(range(1, length({turned}) + 1), lambda i: ascii(substr({turned}, i, 1)))), "
        "lambda r, c: CASE WHEN c >= 65 THEN (r * 100 + c - 55) % 97 ELSE (r * 10 + c - 48) % 97 END)"
    )
    apart = lambda c: f"NOT regexp_matches(right(before, 1), '{c}') AND NOT regexp_matches(left(after, 1), '{c}')"
    near = lambda k: f"regexp_matches(lower(right(before, 40) || ' ' || left(after, 40)), '{k.context}')"
    valid = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))",
        "card": f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn_sum} % 10 = 0 ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"CASE WHEN length(hit) BETWEEN 15 AND 34 AND {apart('[A-Za-z0-9]')} THEN {mod} = 1 ELSE false END",
        "ssn": f"{apart('[0-9A-Za-z-]')} AND NOT regexp_matches({digits}, '^(000|666|9)') AND substr({digits}, 4, 2) <> '00' AND NOT regexp_matches({digits}, '0000$') AND {near(KINDS[5])}",
    }
    return spans_sql(patterns, valid, [k.name for k in KINDS if k.base])


def spans_sql(patterns: dict[str, str], valid: dict[str, str], base: Sequence[str]) -> str:
    hits = " UNION ALL ".join(
        f"SELECT rid, '{k}' AS kind, {i} AS ord, unnest(range(1, len(h) + 1)) AS i, h, g FROM (SELECT rid, regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}') AS h, string_split_regex(t, '{p.replace(chr(39), chr(39) * 2)}') AS g FROM d)"
        for i, (k, p) in enumerate(patterns.items())
    )
    case = " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in valid.items())
    listed = ", ".join(f"'{k}'" for k in base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({hits}),
placed AS (
  SELECT rid, kind, ord, h[i] AS hit, g[i] AS before, g[i + 1] AS after,
    coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS s
  FROM hits),
kept AS (SELECT rid, kind, ord, s::BIGINT AS s, (s + length(hit))::BIGINT AS e FROM placed WHERE CASE {case} END),
made AS (
  SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE kind IN ({listed})) AS based,
    {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base)}
  FROM kept GROUP BY rid)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in base)},
  sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN made USING (rid)
"""
