"""Spans of regular expressions with code-point offsets, as built-in expressions.

``split`` yields the text between the hits and ``regexp_extract_all`` the hits, so
offsets are running sums of lengths; nothing needs a user function. Patterns are
written so that Java's matcher stays linear on long runs: repeated classes are
possessive where that cannot change the match, and a run is tried from its first
character only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: Code points of context kept on either side of a hit.
CONTEXT = 40
#: Running sums are taken block by block, so that a text with very many hits stays cheap.
BLOCK = 256

HIT = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def running_sums(values: Column) -> Column:
    """Sums of all earlier elements of an int array, one for each element."""

    def folded(block: Column, base: Column) -> Column:
        step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        start = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, step, lambda s: s["out"])

    def blocked(x: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda g: F.slice(x, g * BLOCK + 1, F.lit(BLOCK)))

        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, v: s + v))
            return let(folded(totals, F.lit(0)), lambda bases: F.flatten(F.transform(parts, lambda p, g: folded(p, F.get(bases, g)))))

        return let(groups, joined)

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).when(F.size(values) <= BLOCK, folded(values, F.lit(0))).otherwise(blocked(values))


def find(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping hits: start, end (exclusive), hit, and context on both sides."""

    def placed(both: Column) -> Column:
        gaps, hits = both["gaps"], both["hits"]
        steps = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))

        def spans(earlier: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                start = F.get(earlier, i) + F.length(F.get(gaps, i))
                return F.struct(
                    start.alias("start"),
                    (start + F.length(h)).alias("end"),
                    h.alias("hit"),
                    F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
                    F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"),
                )

            return F.transform(hits, one)

        return let(let(steps, running_sums), spans)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits")), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(HIT))


def labelled(hits: Column, kind: str, order: int) -> Column:
    """Hits as sortable (start, ord, end, kind) structs."""
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(order).alias("ord"), h["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans by start, then kind order, joined by commas."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a short string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number of capitals and digits passes the mod-97 check."""
    turned = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substr(account, F.lit(1), F.lit(4)))

    def step(r: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1
