"""Helpers that the column functions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running sums are folded block by block, which keeps long arrays cheap.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once; a lambda that names a plain expression would evaluate it for every element."""
    return F.transform(F.array(value), body)[0]


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def running_sums(values: Column) -> Column:
    """For each element of an int array, the sum of the elements before it."""

    def fold(block: Column, base: Column) -> Column:
        step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(block, F.struct(base.alias("at"), empty("array<int>").alias("out")), step, lambda s: s["out"])

    def blocked(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(x, g * BLOCK + 1, F.lit(BLOCK)))

        def joined(p: Column) -> Column:
            totals = F.transform(p, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v))
            return let(fold(totals, F.lit(0)), lambda bases: F.flatten(F.transform(p, lambda b, g: fold(b, F.get(bases, g)))))

        return let(parts, joined)

    return F.when(F.size(values) == 0, empty("array<int>")).when(F.size(values) <= BLOCK, fold(values, F.lit(0))).otherwise(blocked(values))


def regex_spans(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping hits as array<struct<s, e, hit>>; offsets count code points.

    ``split`` gives the text between hits, so offsets are running sums of lengths.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(both: Column) -> Column:
        gaps, hits = both["gaps"], both["hits"]
        steps = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))

        def spans(before: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                s = F.get(before, i) + F.length(F.get(gaps, i))
                return F.struct(s.alias("s"), (s + F.length(h)).alias("e"), h.alias("hit"))

            return F.transform(hits, one)

        return let(let(steps, running_sums), spans)

    found = let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits")), placed)
    return F.when(F.regexp_like(text, pattern), found).otherwise(empty("array<struct<s:int,e:int,hit:string>>"))


def quote(literal: Column) -> Column:
    """A Java regular expression that matches a string literally."""
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def piece(text: Column, s: Column, e: Column) -> Column:
    """text[s:e] by code points."""
    return F.substr(text, s + 1, e - s)


def points(text: Column) -> Column:
    """The code points of a text, four bytes each: a place far into it is reached as fast as one at its start.

    For ``cut`` with many places of one text; bind it (``let``), or it is made for each of them.
    """
    return F.encode(text, "UTF-32")


def n_points(made: Column) -> Column:
    """The length of the text that ``points`` was made of."""
    return F.shiftright(F.octet_length(made), 2)


def cut(made: Column, s: Column, e: Column) -> Column:
    """``piece`` of the text that ``points`` was made of."""
    # no text is as long; behind the mark that decoding drops another one stays
    s, e = (F.when(at > _FAR, _FAR).otherwise(at) for at in (s, e))
    own = F.substr(made, s * 4 + F.when(s >= 0, 1).otherwise(4), (e - s) * 4)
    return F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), own), "UTF-32")


_FAR = 1 << 28


def hash_unit(*parts: Column) -> Column:
    """A uniform number in [0, 1] from the first 8 hex digits of sha256 of the parts joined by ``:``."""
    return hash_int(*parts) / F.lit(4294967295.0)


def hash_int(*parts: Column) -> Column:
    """The first 8 hex digits of sha256 of the parts joined by ``:``, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")
