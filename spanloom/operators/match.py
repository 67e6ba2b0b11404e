"""Matching predictions with references, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow, vocab
from ..functions.core import empty, let
from ..functions.text import WS, strip

SPAN = "struct<text:string,start:int,end:int,type:string,assertions:array<string>>"


def paired_files(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Each gold file with its predictions; a missing file has none and is told; others are ignored."""
    both = gold.select("file", F.col("spans").alias("gold")).join(pred.select("file", F.col("spans").alias("pred"), F.lit(True).alias("has_pred")), "file", "left")
    return both.select("file", "gold", F.coalesce("pred", empty(f"array<{SPAN}>")).alias("pred"), F.coalesce("has_pred", F.lit(False)).alias("has_pred"))


def overlap_pairs(gold: Column, pred: Column, same_type: bool = True) -> Column:
    """Pairs (overlap, g, p) of spans that share a character, by falling overlap, then g and p."""

    def of(g: Column, gi: Column) -> Column:
        def one(p: Column, pi: Column) -> Column:
            o = F.least(g["end"], p["end"]) - F.greatest(g["start"], p["start"])
            fits = (o > 0) & ((g["type"] == p["type"]) if same_type else (g["type"] != p["type"]))
            return F.when(fits, F.struct((-o).alias("o"), gi.alias("g"), pi.alias("p")))

        return F.array_compact(F.transform(pred, one))

    return F.array_sort(F.flatten(F.transform(gold, of)))


def greedy_match(gold: Column, pred: Column) -> Column:
    """M1: one-to-one pairs (g, p), taken by falling overlap while both are free."""
    step = lambda kept, x: F.when(F.exists(kept, lambda k: (k["g"] == x["g"]) | (k["p"] == x["p"])), kept).otherwise(F.concat(kept, F.array(F.struct(x["g"], x["p"]))))
    return F.aggregate(overlap_pairs(gold, pred), empty("array<struct<g:int,p:int>>"), step)


def matched(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """file, gold, pred, has_pred and pairs."""
    return paired_files(gold, pred).withColumn("pairs", greedy_match(F.col("gold"), F.col("pred")))


def prf(tp: Column, pred: Column, gold: Column) -> list[Column]:
    """A5: precision, recall and F1 in percent, 0 where undefined."""
    p = F.coalesce(F.try_divide(100.0 * tp, pred), F.lit(0.0))
    r = F.coalesce(F.try_divide(100.0 * tp, gold), F.lit(0.0))
    return [p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def pair_rows(m: DataFrame) -> DataFrame:
    """One row for each matched pair with both spans."""
    rows = m.select("file", F.explode("pairs").alias("x"), "gold", "pred")
    return rows.select("file", F.col("gold")[F.col("x.g")].alias("g"), F.col("pred")[F.col("x.p")].alias("p"))


def score_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Long table (scope, key, tp, pred, gold, p, r, f1).

    Scopes: micro (overlap matches), exact (same edges among matches), type,
    assertion (on matched pairs whose type may carry one).
    """
    m = matched(gold, pred)
    n = m.agg(F.sum(F.size("pairs")).alias("tp"), F.sum(F.size("pred")).alias("pred"), F.sum(F.size("gold")).alias("gold"))
    micro = n.select(F.lit("micro").alias("scope"), F.lit("all").alias("key"), "tp", "pred", "gold")
    pairs = pair_rows(m)
    exact = pairs.filter((F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end"))).agg(F.count(F.lit(1)).alias("tp"))
    exact = exact.crossJoin(n.select("pred", "gold")).select(F.lit("exact").alias("scope"), F.lit("all").alias("key"), "tp", "pred", "gold")
    side = lambda c, name: m.select(F.explode(c).alias("x")).groupBy(F.col("x.type").alias("key")).agg(F.count(F.lit(1)).alias(name))
    tps = pairs.groupBy(F.col("g.type").alias("key")).agg(F.count(F.lit(1)).alias("tp"))
    types = side("gold", "gold").join(side("pred", "pred"), "key", "full").join(tps, "key", "left").na.fill(0)
    types = types.select(F.lit("type").alias("scope"), "key", "tp", "pred", "gold")
    bearing = pairs.filter(F.col("g.type").isin(list(vocab.ASSERTION_TYPES)))
    has = lambda c, a: F.array_contains(F.col(f"{c}.assertions"), a)
    flags = F.explode(F.array(*[F.struct(F.lit(a).alias("key"), has("g", a).alias("g"), has("p", a).alias("p")) for a in vocab.ASSERTIONS]))
    marks = bearing.select(flags.alias("x")).groupBy("x.key").agg(F.count_if(F.col("x.g") & F.col("x.p")).alias("tp"), F.count_if("x.p").alias("pred"), F.count_if("x.g").alias("gold"))
    marks = marks.select(F.lit("assertion").alias("scope"), "key", "tp", "pred", "gold")
    whole = micro.unionByName(exact).unionByName(types).unionByName(marks)
    return whole.select("*", *prf(F.col("tp"), F.col("pred"), F.col("gold")))


def boundary_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Matches, exact matches, and words that matched predictions have beyond their gold span."""
    words = lambda c: F.regexp_count(F.col(c), F.lit(rf"[^{WS}]+"))
    rows = pair_rows(matched(gold, pred))
    same = (F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end"))
    return rows.agg(F.count(F.lit(1)).alias("matched"), F.count_if(same).alias("exact"), F.coalesce(F.sum(words("p.text") - words("g.text")), F.lit(0)).alias("extra_words"))


def confusion(gold: DataFrame, pred: DataFrame, most: int = 6) -> DataFrame:
    """The most frequent (gold type, predicted type) of unmatched predictions.

    Each counts against the first gold span of another type that it overlaps.
    """
    m = matched(gold, pred)
    numbered = F.transform("pred", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    free = let(F.col("pairs"), lambda pairs: F.filter(numbered, lambda y: ~F.exists(pairs, lambda k: k["p"] == y["i"])))
    rows = m.select("gold", free.alias("free"))
    rows = rows.select("gold", F.explode("free.x").alias("p"))
    first = F.get(F.filter("gold", lambda g: (g["type"] != F.col("p.type")) & (g["start"] < F.col("p.end")) & (F.col("p.start") < g["end"])), F.lit(0))
    counts = rows.select(first["type"].alias("gold_type"), F.col("p.type").alias("pred_type")).filter("gold_type IS NOT NULL")
    return counts.groupBy("gold_type", "pred_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold_type", "pred_type").limit(most)


def sieve(spans: DataFrame, blocked: DataFrame) -> DataFrame:
    """File spans (exploded: file, text, …) without blocked surfaces; blocked: surface."""
    low = blocked.select(F.lower(strip(F.col("surface"))).alias("key")).filter("key <> ''").distinct()
    return spans.withColumn("key", F.lower(strip(F.col("text")))).join(low, "key", "left_anti").drop("key")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def word_errors(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance of two word arrays, one row of the table at a time."""
    base = F.sequence(F.lit(0), F.size(hyp))

    def row(prev: Column, w: Column) -> Column:
        def cell(acc: Column, x: Column) -> Column:
            j = F.size(acc)
            best = F.least(F.get(acc, j - 1) + 1, F.get(prev, j) + 1, F.get(prev, j - 1) + F.when(x == w, 0).otherwise(1))
            return F.concat(acc, F.array(best))

        return F.aggregate(hyp, F.array(prev[0] + 1), cell)

    return F.aggregate(ref, base, row, lambda last: F.element_at(last, -1))


def official_score(rows: DataFrame) -> DataFrame:
    """0.3 * mean(1 - WER) + 0.3 * mean(assertion Jaccard) + 0.4 * weighted candidate Jaccard.

    rows: ref, hyp (texts), gold_assertions, pred_assertions, gold_candidates,
    pred_candidates of aligned entities. 1 - WER is not below 0; a candidate set
    weighs its gold size plus one.
    """
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(rf"[^{WS}]+"), F.lit(0))
    wer = F.try_divide(word_errors(words("ref"), words("hyp")), F.size(words("ref")))
    weight = F.size("gold_candidates") + 1
    parts = rows.select(
        F.greatest(F.lit(0.0), 1 - F.coalesce(wer, F.lit(0.0))).alias("t"),
        jaccard(F.col("gold_assertions"), F.col("pred_assertions")).alias("a"),
        (jaccard(F.col("gold_candidates"), F.col("pred_candidates")) * weight).alias("c"),
        weight.alias("w"),
    )
    return parts.agg(F.avg("t").alias("text"), F.avg("a").alias("assertion"), (F.sum("c") / F.sum("w")).alias("candidate")).select("*", (0.3 * F.col("text") + 0.3 * F.col("assertion") + 0.4 * F.col("candidate")).alias("score"))


def tag_scores(rows: DataFrame) -> DataFrame:
    """Exact-span P/R/F of tag sequences (id, gold_tags, pred_tags) by type and over all."""
    arrow.limit_batches()
    found = rows.select("gold_tags", "pred_tags").mapInArrow(arrow.tag_counts, "key string, tp long, pred long, gold long")
    counted = found.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("tp", "pred", "gold")]).filter("pred + gold > 0")
    total = counted.agg(*[F.sum(c).alias(c) for c in ("tp", "pred", "gold")]).select(F.lit("all").alias("key"), "tp", "pred", "gold")
    return counted.unionByName(total).select("*", *prf(F.col("tp"), F.col("pred"), F.col("gold")))


def selection_score(ner_f1: Column, assertion_f1: Column) -> Column:
    """The number that picks a model."""
    return 0.8 * ner_f1 + 0.2 * assertion_f1


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of each stage, the change from the stage before and the share of the first."""
    counted = None
    for i, (name, df) in enumerate(stages):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), F.lit(name).alias("stage"), "n")
        counted = one if counted is None else counted.unionByName(one)
    w = Window.orderBy("i")
    return counted.select("stage", "n", F.coalesce(F.col("n") - F.lag("n").over(w), F.lit(0)).alias("delta"), F.try_divide(100.0 * F.col("n"), F.first("n").over(w)).alias("pct"))
