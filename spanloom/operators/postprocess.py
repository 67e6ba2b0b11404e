"""Spans of a tagger into final labels: trim, block, merge, map, dedup, suppress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.core import cut, empty, let, piece, points
from ..functions.spans import drop_blocked, strip_spans
from ..functions.text import WS, strip

GAP = 3


def trimmed(rows: DataFrame) -> DataFrame:
    """Rows (id, text, spans)."""
    return rows.withColumn("spans", strip_spans(F.col("text"), F.col("spans")))


def unblocked(rows: DataFrame) -> DataFrame:
    """F5."""
    return rows.withColumn("spans", drop_blocked(F.col("spans")))


def merge_runs(spans: DataFrame, gap: int = GAP, group: tuple[str, ...] = vocab.DRUG_GROUP) -> DataFrame:
    """Adjacent spans (id, raw, start, end, type) joined over at most ``gap`` blanks of one line.

    Same type, or both in the group, which becomes its first type; n_merged tells how
    many. A span that overlaps the one before it has no gap; the run ends where
    its last span ends. The two-member group makes the run condition pairwise, so
    a break flag and its running sum give the runs.
    """
    w = Window.partitionBy("id").orderBy("start", "end", "type")
    prev_end, prev_type = F.lag("end").over(w), F.lag("type").over(w)
    between = piece(F.col("raw"), prev_end, F.col("start"))
    near = (F.col("start") - prev_end <= gap) & ((F.col("start") <= prev_end) | between.rlike(rf"\A[{WS}&&[^\n]]*\z"))
    kin = (F.col("type") == prev_type) | (F.col("type").isin(list(group)) & prev_type.isin(list(group)))
    rows = spans.withColumn("new", F.when(near & kin, 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("start", "end", "type"))
    mixed = F.count_distinct("type") > 1
    made = rows.groupBy("id", "run").agg(
        F.min("start").alias("start"), last["end"].alias("end"), F.when(mixed, F.lit(group[0])).otherwise(F.min("type")).alias("type"), F.count(F.lit(1)).alias("n_merged"), F.first("raw").alias("raw")
    )
    return made.select("id", "start", "end", "type", "n_merged", F.substr("raw", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def merged_runs(text: Column, spans: Column, gap: int = GAP, group: tuple[str, ...] = vocab.DRUG_GROUP) -> Column:
    """``merge_runs`` of one note's array of spans: array<struct<start,end,type,n_merged,text>> in order of place."""
    return let(points(text), lambda p: runs_in(p, spans, gap, group))


def runs_in(made: Column, spans: Column, gap: int = GAP, group: tuple[str, ...] = vocab.DRUG_GROUP) -> Column:
    """``merged_runs`` in the ``points`` of a text."""
    order = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"))))

    def runs(all_: Column) -> Column:
        def opens(i: Column) -> Column:
            def apart(pair: Column) -> Column:
                x, y = pair["x"], pair["y"]
                between = cut(made, x["end"], y["start"])
                near = (y["start"] - x["end"] <= gap) & ((y["start"] <= x["end"]) | between.rlike(rf"\A[{WS}&&[^\n]]*\z"))
                kin = (y["type"] == x["type"]) | (y["type"].isin(list(group)) & x["type"].isin(list(group)))
                return ~(near & kin)

            return (i == 0) | let(F.struct(F.get(all_, i - 1).alias("x"), F.get(all_, i).alias("y")), apart)

        def joined_at(at: Column) -> Column:
            def one(a: Column, j: Column) -> Column:
                def joined(run: Column) -> Column:
                    first, last = run[0], F.element_at(run, -1)
                    mixed = F.exists(run, lambda x: x["type"] != first["type"])
                    return F.struct(first["start"].alias("start"), last["end"].alias("end"), F.when(mixed, F.lit(group[0])).otherwise(first["type"]).alias("type"), F.size(run).alias("n_merged"), cut(made, first["start"], last["end"]).alias("text"))

                return let(F.slice(all_, a + 1, F.coalesce(F.get(at, j + 1), F.size(all_)) - a), joined)

            return F.transform(at, one)

        return let(F.filter(F.sequence(F.lit(0), F.size(all_) - 1), opens), joined_at)

    kind = "array<struct<start:int,end:int,type:string,n_merged:int,text:string>>"
    return F.when(F.size(spans) > 0, let(order, runs)).otherwise(empty(kind))


def mapped(spans: Column, table: dict[str, str] = vocab.LABEL_MAP) -> Column:
    """tagger labels of an array of spans to types; labels that the table lacks are dropped."""
    types = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    made = F.transform(spans, lambda x: x.withField("type", F.try_element_at(types, x["type"])))
    return F.filter(made, lambda x: x["type"].isNotNull())


def final(spans: Column) -> Column:
    """Of spans in order of place the first of each folded text and type."""
    key = lambda x: F.struct(F.lower(strip(x["text"])).alias("text"), x["type"].alias("type"))

    def firsts(all_: Column) -> Column:
        keyed = F.sort_array(F.transform(all_, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        own = let(keyed, lambda ks: F.filter(ks, lambda x, j: (j == 0) | ~F.get(ks, j - 1)["k"].eqNullSafe(x["k"])))
        return F.transform(F.sort_array(F.transform(own, lambda x: x["i"])), lambda i: F.get(all_, i))

    return let(spans, firsts)


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; a maximum of structs, so a hot key is summed before the shuffle."""
    others = [c for c in events.columns if c != key]
    best = events.groupBy(key).agg(F.max(F.struct(order, *[c for c in others if c != order])).alias("x"))
    return best.select(key, *[F.col("x")[c].alias(c) for c in others])


def last_before(lines: DataFrame, points: DataFrame, id: str = "id") -> DataFrame:
    """As-of join: each point (id, at) with the last line (id, at, value) at or before it."""
    both = lines.select(id, "at", "value", F.lit(0).alias("side")).unionByName(points.select(id, "at", F.lit(None).cast("string").alias("value"), F.lit(1).alias("side")))
    w = Window.partitionBy(id).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(w)).filter("side = 1").drop("side")
