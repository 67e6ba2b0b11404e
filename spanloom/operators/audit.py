"""Label audit: screens, verdicts, decisions, and corrected copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.core import empty, let, piece
from ..functions.cues import conflict, support
from ..functions.text import context, headings, leading_negation, nearest_heading, strip
from ..sources import files
from .stats import type_majority, type_minority

CONTEXT = 400
#: Which types an automatic decision may delete.
DELETABLE = (vocab.SYMPTOM,)


def _proposal(assertions: Column | None = None, kind: Column | None = None, text: Column | None = None, start: Column | None = None, end: Column | None = None, delete: Column | None = None) -> Column:
    def or_null(c: Column | None, t: str) -> Column:
        return F.lit(None).cast(t) if c is None else c.cast(t)

    return F.struct(
        or_null(assertions, "array<string>").alias("assertions"),
        or_null(kind, "string").alias("type"),
        or_null(text, "string").alias("text"),
        or_null(start, "int").alias("start"),
        or_null(end, "int").alias("end"),
        or_null(delete, "boolean").alias("delete"),
    )


def entity_finding(text: Column, e: Column) -> Column:
    """V2: struct (kind, mechanical, proposed) of the first rule that an entity breaks, else null.

    Order: offsets, assertions on a type that takes none, unknown assertions, an
    assertion without cue, a cue without assertion, a negation at the start of
    the span, a historical drug.
    """
    marks = F.coalesce(e["assertions"], empty("array<string>"))
    known = F.array(*[F.lit(a) for a in vocab.ASSERTIONS])
    fits = F.coalesce((e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text)) & (piece(text, e["start"], e["end"]) == e["text"]), F.lit(False))
    bearing = e["type"].isin(list(vocab.ASSERTION_TYPES))

    def finding(kind: str, mechanical: bool, proposed: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(mechanical).alias("mechanical"), proposed.alias("proposed"))

    def cued(x: Column) -> Column:
        missing = F.size(F.array_except(marks, x["support"])) > 0
        extra = F.array_sort(F.array_except(x["conflict"], marks))
        spared = (e["type"] == vocab.DRUG) & (extra == F.array(F.lit("isHistorical")))
        lead = leading_negation(e["text"])
        core = F.substr(e["text"], F.length(lead) + 1, F.length(e["text"]))
        from_ = e["start"] + F.length(lead)
        negated = F.array_contains(marks, "isNegated")
        with_negation = F.array_sort(F.array_union(marks, F.array(F.lit("isNegated"))))
        return (
            F.when(missing, finding("assertion_without_cue", False, _proposal(F.array_intersect(marks, x["support"]), e["type"])))
            .when((F.size(extra) > 0) & ~spared, finding("cue_without_assertion", False, _proposal(F.array_sort(F.array_union(marks, extra)), e["type"])))
            .when((lead != "") & negated, finding("span_swallows_negation", False, _proposal(marks, e["type"], core, from_, e["end"])))
            .when(lead != "", finding("negation_inside_span", False, _proposal(with_negation, e["type"], core, from_, e["end"])))
            .when((e["type"] == vocab.DRUG) & F.array_contains(marks, "isHistorical"), finding("historical_drug", False, _proposal(F.array_remove(marks, "isHistorical"), e["type"])))
        )

    cues = let(F.struct(support(text, e["start"], e["end"]).alias("support"), conflict(text, e["start"]).alias("conflict")), cued)
    return (
        F.when(~fits, F.struct(F.lit("offset_mismatch").alias("kind"), F.lit(True).alias("mechanical"), F.lit(None).cast("struct<assertions:array<string>,type:string,text:string,start:int,end:int,delete:boolean>").alias("proposed")))
        .when((F.size(marks) > 0) & ~bearing, finding("assertion_on_forbidden_type", True, _proposal(empty("array<string>"), e["type"])))
        .when(F.size(F.array_except(marks, known)) > 0, finding("unknown_assertion", True, _proposal(F.filter(marks, lambda a: F.array_contains(known, a)), e["type"])))
        .when(bearing, cues)
    )


def _with_context(rows: DataFrame) -> DataFrame:
    """Adds context around the entity and its nearest heading."""
    valid = (F.col("e.start") >= 0) & (F.col("e.end") <= F.length("text")) & (F.col("e.start") < F.col("e.end"))
    ctx = context(F.col("text"), F.col("e.start"), F.col("e.end"), CONTEXT)
    near = nearest_heading(F.col("heads"), F.col("e.start"))
    kind = "struct<before:string,surface:string,after:string,window_start:int,heading:string>"
    made = F.struct(ctx["before"].alias("before"), ctx["surface"].alias("surface"), ctx["after"].alias("after"), ctx["window_start"].cast("int").alias("window_start"), near.alias("heading"))
    blank = F.struct(F.lit("").alias("before"), F.col("e.text").alias("surface"), F.lit("").alias("after"), F.col("e.start").alias("window_start"), F.lit(None).cast("string").alias("heading"))
    return rows.withColumn("context", F.when(valid, made.cast(kind)).otherwise(blank.cast(kind)))


def screen(records: DataFrame) -> DataFrame:
    """V2, V9: findings of all entities: key, file, entity_index, source, kind, mechanical, current, proposed, entity, context."""
    base = records.select("id", "source", "text", "entities", headings(F.col("text")).alias("heads"))
    rows = base.select("id", "source", "text", "heads", F.posexplode("entities").alias("entity_index", "e"))
    rows = rows.withColumn("f", entity_finding(F.col("text"), F.col("e"))).filter("f IS NOT NULL")
    return _finding_columns(_with_context(rows))


def _finding_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        finding_id(F.col("id"), F.col("entity_index")).alias("key"),
        F.col("id").alias("file"),
        "entity_index",
        "source",
        "f.kind",
        "f.mechanical",
        F.struct(F.col("e.assertions").alias("assertions"), F.col("e.type").alias("type")).alias("current"),
        "f.proposed",
        F.col("e").alias("entity"),
        "context",
    )


def screen_minority(records: DataFrame) -> DataFrame:
    """Entities whose type is not that of nearly all entities with their surface."""
    base = records.select("id", "source", "text", "entities", headings(F.col("text")).alias("heads"))
    rows = base.select("id", "source", "text", "heads", F.posexplode("entities").alias("entity_index", "e"))
    rows = rows.withColumn("surface", F.col("e.text")).withColumn("type", F.col("e.type"))
    odd = type_minority(rows, type_majority(rows.select("surface", "type")))
    keep = F.when(F.col("winner").isin(list(vocab.ASSERTION_TYPES)), F.col("e.assertions")).otherwise(empty("array<string>"))
    odd = odd.withColumn("f", F.struct(F.lit("type_minority_vs_corpus").alias("kind"), F.lit(False).alias("mechanical"), _proposal(keep, F.col("winner")).alias("proposed")))
    return _finding_columns(_with_context(odd))


def screen_all(records: DataFrame) -> DataFrame:
    """Rule findings, and minority findings of entities that no rule reported."""
    own = screen(records)
    return own.unionByName(screen_minority(records).join(own.select("key"), "key", "left_anti"))


def delete_candidates(records: DataFrame) -> DataFrame:
    """V5: every entity whose offsets are right, as a proposal to delete it."""
    base = records.select("id", "source", "text", "entities", headings(F.col("text")).alias("heads"))
    rows = base.select("id", "source", "text", "heads", F.posexplode("entities").alias("entity_index", "e"))
    fits = (F.col("e.start") >= 0) & (F.col("e.start") < F.col("e.end")) & (piece(F.col("text"), F.col("e.start"), F.col("e.end")) == F.col("e.text"))
    rows = rows.filter(fits).withColumn("f", F.struct(F.lit("delete_candidate").alias("kind"), F.lit(False).alias("mechanical"), _proposal(delete=F.lit(True)).alias("proposed")))
    return _finding_columns(_with_context(rows))


def finding_id(file: Column, index: Column) -> Column:
    """V9: file#index."""
    return F.concat_ws("#", file, index)


def payload(findings: DataFrame) -> DataFrame:
    """V9: what an external judge gets, as JSON in a fixed field order."""
    made = F.to_json(F.struct(F.col("key").alias("id"), "kind", "current", "proposed", F.col("context.before").alias("before"), F.col("context.surface").alias("surface"), F.col("context.after").alias("after"), F.col("context.heading").alias("heading")))
    return findings.select("key", made.alias("payload"))


def input_signature(*parts: str) -> Column:
    """The first 12 hex digits of sha256 over prompt and context settings."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.lit(p) for p in parts]), 256), 1, 12)


def current_verdicts(verdicts: DataFrame, signature: Column) -> DataFrame:
    """The last verdict of each id (by seq) among those with this signature; others are stale."""
    fresh = verdicts.filter(F.col("input_signature") == signature)
    others = [c for c in fresh.columns if c != "id"]
    best = fresh.groupBy("id").agg(F.max(F.struct("seq", *[c for c in others if c != "seq"])).alias("x"))
    return best.select("id", *[F.col("x")[c].alias(c) for c in others])


def pending(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings that need a verdict and have none; mechanical ones need none."""
    return findings.filter(~F.col("mechanical")).join(verdicts.select(F.col("id").alias("key")), "key", "left_anti")


def to_judge(findings: DataFrame, verdicts: DataFrame, limit: int | None = None) -> DataFrame:
    """L3: at most ``limit`` pending findings in key order, and all mechanical ones."""
    open_ = pending(findings, verdicts)
    open_ = open_.orderBy("key").limit(limit) if limit is not None else open_
    return open_.unionByName(findings.filter("mechanical"))


def resolve_change(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with the change their verdict asks for; those it does not change go.

    A span must be a part of the old one and never widens it; a type that takes no
    assertion clears them; mechanical findings take their own proposal.
    """
    v = verdicts.select(F.col("id").alias("key"), F.lit(True).alias("has"), F.col("verdict").alias("v"), F.col("assertions").alias("va"), F.col("type").alias("vt"), F.trim("span").alias("vs"))
    rows = findings.join(v, "key", "left").filter("mechanical OR has").filter(~F.coalesce(F.col("v") == "keep", F.lit(False)))
    e, cur = F.col("entity"), F.col("current")
    kind = F.when(F.col("mechanical"), F.coalesce(F.col("proposed.type"), cur["type"])).otherwise(F.coalesce("vt", cur["type"]))
    marks = F.when(F.col("mechanical"), F.coalesce(F.col("proposed.assertions"), cur["assertions"])).otherwise(F.coalesce("va", empty("array<string>")))
    marks = F.when(kind.isin(list(vocab.ASSERTION_TYPES)), marks).otherwise(empty("array<string>"))
    at = F.call_function("locate", F.coalesce("vs", F.lit("")), e["text"])
    moved = ~F.col("mechanical") & (F.coalesce("vs", F.lit("")) != "") & (F.col("vs") != e["text"]) & (at > 0)
    start = e["start"] + at - 1
    rows = rows.withColumn("n", F.struct(kind.alias("type"), marks.alias("assertions"), F.when(moved, F.col("vs")).alias("text"), F.when(moved, start).cast("int").alias("start"), F.when(moved, start + F.length("vs")).cast("int").alias("end")))
    changed = (F.col("n.type") != cur["type"]) | (F.col("n.assertions") != cur["assertions"]) | F.col("n.text").isNotNull()
    rows = rows.filter(changed)
    proposed = _proposal(F.col("n.assertions"), F.when(F.col("n.type") != cur["type"], F.col("n.type")), F.col("n.text"), F.col("n.start"), F.col("n.end"))
    return rows.select(*[proposed.alias("proposed") if c == "proposed" else F.col(c) for c in findings.columns])


def merge_findings(fix: DataFrame, delete: DataFrame) -> DataFrame:
    """Fixes and deletions by key; a deletion wins and remembers the kind it supersedes."""
    columns = [c for c in fix.columns if c != "key"]
    f, d = fix.alias("f"), delete.alias("d")
    both = f.join(d, F.col("f.key") == F.col("d.key"), "full")
    has = F.col("d.key").isNotNull()
    return both.select(
        F.coalesce("d.key", "f.key").alias("key"),
        *[F.when(has, F.col(f"d.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in columns],
        F.when(has, F.col("f.kind")).alias("supersedes_fix"),
    )


def veto(finding_type: Column, assertions: Column, proposed: Column) -> Column:
    """V8: a reason code, or null if the proposal may stand."""
    gone = F.coalesce(proposed["delete"], F.lit(False))
    kept = F.coalesce(F.size(proposed["assertions"]) > 0, F.lit(False))
    return (
        F.when(gone & ~finding_type.isin(list(DELETABLE)), "delete_type")
        .when(gone & (F.size(assertions) > 0), "delete_with_assertion")
        .when(~gone & proposed["type"].isNotNull() & ~proposed["type"].isin(list(vocab.ASSERTION_TYPES)) & kept, "retype_keeps_assertion")
    )


def auto_decide(findings: DataFrame) -> DataFrame:
    """Key, decision, reason and action of every finding."""
    rows = findings.withColumn("reason", veto(F.col("current.type"), F.col("current.assertions"), F.col("proposed")))
    action = F.when(F.coalesce(F.col("proposed.delete"), F.lit(False)), "delete").otherwise("fix")
    return rows.select("key", F.when(F.col("reason").isNull(), "accept").otherwise("reject").alias("decision"), "reason", action.alias("action"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Accepted by action, rejected by reason."""
    return decisions.groupBy("decision", F.coalesce("reason", "action").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """A10: findings by kind, by source and by kind and source, with the mechanical ones."""
    sets = findings.groupingSets([["kind"], ["source"], ["kind", "source"], []], "kind", "source")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("mechanical").alias("mechanical"), F.grouping_id().alias("level"))


def apply_decisions(records: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records with accepted changes, all columns as they were; entities keep their order.

    Entities are addressed by their ordinal, so a deletion moves no other. A new span
    is taken only where the raw text still holds it.
    """
    accepted = findings.join(decisions.filter("decision = 'accept'").select("key"), "key", "left_semi")
    changes = accepted.groupBy(F.col("file").alias("id")).agg(F.collect_list(F.struct(F.col("entity_index").alias("i"), F.col("proposed").alias("p"))).alias("changes"))
    rows = records.join(changes, "id", "left")

    def one(e: Column, i: Column) -> Column:
        c = F.get(F.filter("changes", lambda x: x["i"] == i), F.lit(0))["p"]
        moved = c["text"].isNotNull() & (piece(F.col("text"), c["start"], c["end"]) == c["text"])
        new = vocab.entity(
            F.when(moved, c["text"]).otherwise(e["text"]),
            F.when(moved, c["start"]).otherwise(e["start"]),
            F.when(moved, c["end"]).otherwise(e["end"]),
            F.coalesce(c["type"], e["type"]),
            F.coalesce(c["assertions"], e["assertions"]),
            e["candidates"],
            e["supervised"],
        )
        return F.struct(F.when(c.isNull(), e).otherwise(new).alias("e"), F.coalesce(c["delete"], F.lit(False)).alias("gone"))

    done = F.transform(F.filter(F.transform("entities", one), lambda x: ~x["gone"]), lambda x: x["e"])
    return rows.select(*[F.when(F.col("changes").isNull(), F.col("entities")).otherwise(done).alias(c) if c == "entities" else F.col(c) for c in records.columns])


def changed_sources(records: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """K5: the sources that an accepted decision touches; only these are written again."""
    accepted = findings.join(decisions.filter("decision = 'accept'").select("key"), "key", "left_semi")
    return accepted.select("source").distinct()


def label_diff(proposed: DataFrame, final: DataFrame) -> DataFrame:
    """Labels (file, start, end, type, assertions) deleted, added, retyped or with other assertions."""
    p, f = proposed.alias("p"), final.alias("f")
    on = (F.col("p.file") == F.col("f.file")) & (F.col("p.start") == F.col("f.start")) & (F.col("p.end") == F.col("f.end"))
    rows = p.join(f, on, "full")
    change = (
        F.when(F.col("f.file").isNull(), "deleted")
        .when(F.col("p.file").isNull(), "added")
        .when(F.col("p.type").isNull() & F.col("f.type").isNotNull(), "promoted")
        .when(~F.col("p.type").eqNullSafe(F.col("f.type")), "retyped")
        .when(F.array_sort("p.assertions") != F.array_sort("f.assertions"), "assertion_changed")
    )
    found = rows.select(*[F.coalesce(f"p.{c}", f"f.{c}").alias(c) for c in ("file", "start", "end")], change.alias("change"))
    return found.filter("change IS NOT NULL")


def change_counts(diff: DataFrame) -> DataFrame:
    """A13."""
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def review_coverage(reviewed: DataFrame, metadata: DataFrame, id: str = "id") -> DataFrame:
    """Ids that are reviewed without metadata (unknown) or known without review (unreviewed)."""
    unknown = reviewed.select(id).join(metadata.select(id), id, "left_anti").select(id, F.lit("unknown").alias("state"))
    return unknown.unionByName(metadata.select(id).join(reviewed.select(id), id, "left_anti").select(id, F.lit("unreviewed").alias("state")))


def review_errors(rows: DataFrame, fields: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each field its rows that are blank or fail their check."""
    made = [F.struct(F.lit(n).alias("field"), F.col(n).isNull().alias("blank"), (F.col(n).isNotNull() & ~check(F.col(n))).alias("bad")) for n, check in fields.items()]
    return rows.select(F.explode(F.array(*made)).alias("x")).groupBy("x.field").agg(F.count_if("x.blank").alias("blank"), F.count_if("x.bad").alias("bad"), F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame, order: str, name: str = "doc", width: int = 3) -> DataFrame:
    """A number from 1 in the order of a column, padded with zeros.

    Rows are sorted by ranges; a number is its place in its range behind the sizes of the
    ranges before, so no task sees all rows. Equal values are told apart by their digest.
    The sorted rows are written once: sorted anew, the ranges, which Spark draws from a
    sample, have other bounds.
    """
    tie = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    placed = files.written(rows.orderBy(order, tie).withColumn("at__n", F.monotonically_increasing_id()))
    part, place = F.shiftright("at__n", 33), F.col("at__n").bitwiseAND(F.lit((1 << 33) - 1))
    before, items = 0, []
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        items += [F.lit(r["p"]).cast("long"), F.lit(before).cast("long")]
        before += r["n"]
    base = F.create_map(*items)[part] if items else F.lit(0)
    number = (base + place + 1).cast("string")
    return placed.withColumn(name, F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)).drop("at__n")


def stripped_key(surface: Column) -> Column:
    return F.lower(strip(surface))
