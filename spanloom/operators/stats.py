"""Corpus statistics, type majorities, lint and repeated-surface analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.core import let
from ..functions.spans import lint_tags
from ..functions.text import genre, marked_context, occurrences, sentence_breaks, sentence_index, strip, token_bounds, tokens, word_count
from ..sources import files

MIN_SURFACE, NEAR = 3, 100
MAJORITY_SHARE, MAJORITY_COUNT = 0.85, 4


def entity_rows(records: DataFrame, *keep: str) -> DataFrame:
    """One row for each entity: id, entity_index, e."""
    return records.select("id", *keep, F.posexplode("entities").alias("entity_index", "e"))


def describe(records: DataFrame) -> DataFrame:
    """A1: records, chars, entities, density per 1,000 characters and share with an assertion, by source and over all."""
    marked = F.size(F.filter("entities", lambda e: F.size(e["assertions"]) > 0))
    rows = records.select("source", F.length("text").alias("chars"), F.size("entities").alias("n"), marked.alias("marked"))
    agg = rows.rollup("source").agg(F.count(F.lit(1)).alias("records"), F.sum("chars").alias("chars"), F.sum("n").alias("entities"), F.sum("marked").alias("marked"), F.grouping("source").alias("total"))
    return agg.select(
        F.when(F.col("total") == 1, "(all)").otherwise(F.col("source")).alias("source"),
        "records",
        "chars",
        "entities",
        F.try_divide(1000.0 * F.col("entities"), "chars").alias("per_1k"),
        F.try_divide(100.0 * F.col("marked"), "entities").alias("assertion_pct"),
    )


def type_shares(records: DataFrame) -> DataFrame:
    """A1, A2: entities of each type and their percentage."""
    counts = entity_rows(records).groupBy(F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def genre_density(records: DataFrame) -> DataFrame:
    """Notes, characters, entities and density by genre with a total row."""
    rows = records.select(genre(F.col("text")).alias("genre"), F.length("text").alias("chars"), F.size("entities").alias("n"))
    agg = rows.rollup("genre").agg(F.count(F.lit(1)).alias("notes"), F.sum("chars").alias("chars"), F.sum("n").alias("entities"))
    return agg.select(F.coalesce("genre", F.lit("(all)")).alias("genre"), "notes", "chars", "entities", F.try_divide(1000.0 * F.col("entities"), "chars").alias("per_1k"))


def assertion_counts(records: DataFrame) -> DataFrame:
    """A2: entities of each type with each assertion."""
    rows = entity_rows(records).select(F.col("e.type").alias("type"), F.explode("e.assertions").alias("assertion"))
    return rows.groupBy("type", "assertion").agg(F.count(F.lit(1)).alias("n"))


def length_histogram(records: DataFrame) -> DataFrame:
    """Entities by word count, the last class open."""
    return entity_rows(records).groupBy(word_count(F.col("e.text")).alias("words")).agg(F.count(F.lit(1)).alias("n"))


def lint(records: DataFrame) -> DataFrame:
    """Flags (grp, tag, file, start, end, detail) of every entity and adjacent pair.

    Adjacent spans in order of place that share a character are nested or overlap.
    """
    base = records.select("id", "text", "entities", token_bounds(tokens(F.col("text"))).alias("b"))

    def flags(e: Column) -> Column:
        # the text and its token edges stay in their row; only flags become rows
        detail = marked_context(F.col("text"), F.greatest(F.lit(0), e["start"]), F.greatest(e["start"], e["end"]))
        made = lambda t: F.struct(t["grp"].alias("grp"), t["tag"].alias("tag"), e["start"].alias("start"), e["end"].alias("end"), detail.alias("detail"))
        return F.transform(lint_tags(F.col("text"), e, F.col("b.starts"), F.col("b.ends")), made)

    def pairs(all_: Column) -> Column:
        # in order of place, each span with the end of the one before it
        prev = lambda i: F.get(all_, i - 1)["end"]
        shared = F.filter(F.transform(all_, lambda x, i: F.struct(x.alias("x"), prev(i).alias("prev"))), lambda p: p["x"]["start"] < p["prev"])
        return F.transform(shared, lambda p: F.struct(F.lit("overlap").alias("grp"), F.when(p["x"]["end"] <= p["prev"], "nested").otherwise("overlap").alias("tag"), p["x"]["start"].alias("start"), p["x"]["end"].alias("end"), p["x"]["text"].alias("detail")))

    def twice(all_: Column) -> Column:
        # equal places stand together; the last of each with another before it
        same = lambda i, j: F.coalesce(F.get(all_, i).eqNullSafe(F.get(all_, j)), F.lit(False))
        last = F.filter(F.transform(all_, lambda x, i: F.struct(x.alias("x"), ((i > 0) & same(i, i - 1) & ((i == F.size(all_) - 1) | ~same(i, i + 1))).alias("last"))), lambda p: p["last"])
        return F.transform(last, lambda p: F.struct(F.lit("span").alias("grp"), F.lit("duplicate").alias("tag"), p["x"]["start"].alias("start"), p["x"]["end"].alias("end"), p["x"]["type"].alias("detail")))

    ordered = lambda *names: F.array_sort(F.transform("entities", lambda e: F.struct(*[e[n].alias(n) for n in names])))
    made = F.concat(F.flatten(F.transform("entities", flags)), let(ordered("start", "end", "type", "text"), pairs), let(ordered("start", "end", "type"), twice))
    # explode alone would have its input made once more, to filter out rows without flags
    return base.select("id", F.explode_outer(made).alias("x")).filter("x IS NOT NULL").select("x.grp", "x.tag", F.col("id").alias("file"), "x.start", "x.end", "x.detail")


def overlap_flags(spans: DataFrame) -> DataFrame:
    """Spans (file, start, end, type, text) that share a character with the span before them."""
    w = Window.partitionBy("file").orderBy("start", "end", "type", "text")
    rows = spans.withColumn("prev_end", F.lag("end").over(w))
    return rows.filter(F.col("start") < F.col("prev_end")).withColumn("tag", F.when(F.col("end") <= F.col("prev_end"), "nested").otherwise("overlap"))


def full_overlaps(spans: DataFrame) -> DataFrame:
    """Number of all overlapping pairs per file, by counting starts and ends before each span.

    A pair overlaps unless one ends before the other starts, so the count needs no self-join.
    """
    events = spans.select("file", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("kind")), F.struct(F.col("end").alias("at"), F.lit(0).alias("kind")))).alias("x")).select("file", "x.at", "x.kind")
    w = Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    running = events.withColumn("open", F.coalesce(F.sum(F.when(F.col("kind") == 1, 1).otherwise(-1)).over(w), F.lit(0)))
    return running.filter("kind = 1").groupBy("file").agg(F.sum("open").alias("pairs"))


def lint_summary(flags: DataFrame, show: int = 25) -> DataFrame:
    """L3, K7: count of each flag and up to ``show`` examples in order of place.

    Counts come from an aggregate; the rank alone is a window, whose limit each task applies
    before the shuffle, so that a frequent flag is not sorted in one task.
    """
    w = Window.partitionBy("grp", "tag").orderBy("file", "start", "end", "detail")
    flags = files.written(flags)  # read by the ranking and by the counts
    ranked = flags.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= show)
    counts = flags.groupBy("grp", "tag").agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(F.broadcast(counts), ["grp", "tag"])  # one row for each kind of flag


def type_majority(rows: DataFrame, surface: str = "surface", kind: str = "type") -> DataFrame:
    """A3, L2: per folded surface its most frequent type (ties: the smaller name), its count and the total."""
    counts = rows.groupBy(F.lower(strip(F.col(surface))).alias("key"), F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    # two partial sums and a maximum; no window over a hot surface
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("type").alias("type")))
    return counts.groupBy("key").agg(best.alias("b"), F.sum("n").alias("total")).select("key", F.col("b.type").alias("winner"), (-F.col("b.neg")).alias("top"), "total")


def type_minority(rows: DataFrame, table: DataFrame, share: float = MAJORITY_SHARE, least: int = MAJORITY_COUNT, surface: str = "surface", kind: str = "type") -> DataFrame:
    """Rows whose type is not the overwhelming majority of their surface."""
    firm = table.filter((F.col("total") >= least) & (F.col("top") >= share * F.col("total")))
    return rows.withColumn("key", F.lower(strip(F.col(surface)))).join(firm, "key").filter(F.col(kind) != F.col("winner"))


def occurrence_rows(records: DataFrame, least: int = MIN_SURFACE, near: int = NEAR) -> DataFrame:
    """One D17 row for each labelled surface of each record."""
    base = records.select(F.col("id").alias("file"), "text", "entities", sentence_breaks(F.col("text")).alias("breaks"))
    firsts = F.transform(F.array_distinct(F.transform("entities", lambda e: e["text"])), lambda s: F.struct(s.alias("surface"), F.filter("entities", lambda e: e["text"] == s).alias("own")))
    rows = base.select("file", "text", "entities", "breaks", F.explode(firsts).alias("x")).filter(F.length("x.surface") >= least)
    surface, n = F.col("x.surface"), F.length("x.surface")
    rows = rows.withColumn("occ", occurrences(F.col("text"), surface)).withColumn("starts", F.transform("x.own", lambda e: e["start"])).withColumn("type", F.col("x.own")[0]["type"])
    inside = lambda s: F.exists("entities", lambda e: (e["start"] <= s) & (s + n <= e["end"]) & ~((e["start"] == s) & (e["end"] == s + n)))
    rows = rows.withColumn("hidden", F.filter("occ", inside)).withColumn("cand", F.filter("occ", lambda s: ~inside(s)))
    rows = rows.withColumn("taken", F.array_intersect("cand", "starts")).withColumn("left", F.array_except("cand", "starts"))
    close = lambda s: F.exists("taken", lambda o: (s - o > 0) & (s - o < near) & (sentence_index(F.col("breaks"), s) == sentence_index(F.col("breaks"), o)))
    return rows.select(
        "file",
        surface.alias("surface"),
        "type",
        F.size("cand").alias("occurrence_count"),
        F.size("taken").alias("selected_count"),
        F.size("left").alias("omitted_count"),
        F.size("hidden").alias("covered_count"),
        F.size(F.filter("taken", close)).alias("near_same_sentence_taken"),
        F.size(F.filter("left", close)).alias("near_same_sentence_omitted"),
        ((F.size("left") > 0) & (F.col("taken") == F.slice("cand", 1, 1))).alias("first_only"),
    )


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def occurrence_summary(rows: DataFrame, n_records: Column, by_type: bool = False) -> DataFrame:
    """A4: shares over repeated surfaces (two or more occurrences), over all or by type."""
    rep = rows.filter("occurrence_count >= 2")
    mixed = F.count_if(F.col("omitted_count") > 0)
    near_taken, near_left = F.coalesce(F.sum("near_same_sentence_taken"), F.lit(0)), F.coalesce(F.sum("near_same_sentence_omitted"), F.lit(0))
    groups = F.count(F.lit(1))
    grouped = rep.groupBy("type") if by_type else rep.groupBy()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return grouped.agg(
        groups.alias("groups"),
        F.coalesce(F.try_divide(groups, F.max(n_records)), F.lit(0.0)).alias("groups_per_record"),
        _pct(F.count_if(F.col("omitted_count") == 0), groups).alias("take_all_pct"),
        _pct(mixed, groups).alias("mixed_pct"),
        total("selected_count").alias("selected"),
        total("omitted_count").alias("omitted"),
        total("covered_count").alias("covered"),
        _pct(near_taken, near_taken + near_left).alias("near_taken_pct"),
        _pct(F.count_if("first_only"), mixed).alias("first_only_pct"),
        _pct(total("selected_count"), total("selected_count") + total("omitted_count")).alias("take_rate_pct"),
    )


def occurrence_warnings(summary: DataFrame, empty_records: Column) -> DataFrame:
    """Which of the five thresholds one summary row misses."""
    return summary.select(
        F.array_compact(
            F.array(
                F.when((F.col("groups") > 0) & (F.col("mixed_pct") < 15), F.lit("mixed_low")),
                F.when(F.col("groups_per_record") < 0.5, F.lit("few_groups")),
                F.when(empty_records == 0, F.lit("no_empty_record")),
                F.when(F.col("covered") == 0, F.lit("no_covered_occurrence")),
                F.when(F.col("first_only_pct") > 60, F.lit("first_only_high")),
            )
        ).alias("warnings")
    )


def declared_roles(mentions: DataFrame, plan: DataFrame) -> DataFrame:
    """Roles that plans declare for unlabelled mentions (seed_id), counted."""
    rows = mentions.filter(~F.col("should_label")).join(plan.select("seed_id", "occurrence_role"), "seed_id", "left")
    return rows.groupBy(F.coalesce("occurrence_role", F.lit("intentional_o")).alias("role")).agg(F.count(F.lit(1)).alias("n"))
