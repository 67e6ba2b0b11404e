"""The public jobs: one function for each command a user runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.core import empty, let, piece, points
from ..functions.spans import any_flag, arbitrate, bio_spans, drop_blocked, span_confidence, strip_in, suppress
from ..operators import audit, contract, leakage, match, postprocess, split, stats, windows
from ..sources import files
from ..streaming import external

CANDIDATE = "struct<text:string,start:int,end:int,type:string,confidence:double>"


@dataclass
class CorpusConfig:
    validation_documents: int = split.VALIDATION_DOCUMENTS
    validation_synthetic: int = split.VALIDATION_SYNTHETIC
    seed: int = split.SEED
    exclude: Sequence[str] = field(default_factory=tuple)
    mask_synthetic: bool = False


def build_corpus(sources: dict[str, DataFrame], cfg: CorpusConfig = CorpusConfig()) -> DataFrame:
    """E-a: all sources with a split; validation is drawn by hash and its ids are checked against training."""
    rows = split.union_sources(sources, cfg.exclude)
    if cfg.mask_synthetic:
        clear = F.transform("entities", lambda e: e.withField("assertions", empty("array<string>")).withField("supervised", F.lit(False)))
        rows = rows.withColumn("entities", F.when(F.col("source") == "synthetic", clear).otherwise(F.col("entities")))
    kind = F.when(F.col("record_kind").startswith("gold"), "document").when(F.col("source") == "synthetic", "synthetic")
    done = split.hold_out(rows, kind, cfg.validation_documents, cfg.validation_synthetic, cfg.seed)
    split.assert_disjoint(done.filter("split = 'train'"), done.filter("split <> 'train'"))
    return done


def window_corpus(corpus: DataFrame, gold_mass: float = 0.5, standalone: float = 0.6, **args) -> DataFrame:
    """E-b: training rows of every record; those of the training split are weighted."""
    rows = windows.training_rows(corpus, keep=("split",), **args)
    weighed = split.mass_weights(rows.filter("split = 'train'"), gold_mass, standalone)
    held = rows.filter("split <> 'train'").withColumn("bucket", F.lit("held_out")).withColumn("sample_weight", F.lit(1.0))
    return weighed.unionByName(held)


def split_report(rows: DataFrame) -> DataFrame:
    """Records, windows and entities of each split."""
    return rows.groupBy("split").agg(F.count_distinct("record_id").alias("records"), F.count(F.lit(1)).alias("windows"), F.sum(F.size("spans")).alias("entities"))


def build_v1(records: DataFrame, most: int = windows.LINE_SIZE, val: float = 0.1, test: float = 0.1, oversample: int = 1, seed: int = 42) -> DataFrame:
    """E-c: line-packed rows split by note; training notes may be repeated."""
    marked = split.ratio_split(records, val, test, seed)
    rows = windows.training_rows_v1(marked, most).join(marked.select("id", "split"), "id")
    return split.oversample(rows, F.when(F.col("split") == "train", oversample).otherwise(1))


def predict(notes: DataFrame, scorer: Callable, head: DataFrame | None = None, abstain: float = 0.60, disagree: float = 0.85, **args) -> DataFrame:
    """E-d: id, spans: tag windows, decode, arbitrate with a span head (id, w, first, type, confidence), suppress overlaps.

    The pieces of a span that window edges cut are joined before overlaps are suppressed.
    """
    ws = windows.sliding_windows(notes, **args)
    scored = external.score_tokens(ws, scorer).join(ws.select("id", "w", "word_start", "content"), ["id", "w"])
    spans = scored.select("id", "w", "word_start", "content", "probs", F.explode(bio_spans(F.col("labels"))).alias("s"))
    spans = spans.withColumn("conf", span_confidence(F.col("probs"), F.col("s.first"), F.col("s.last")))
    if head is not None:
        h = head.select("id", "w", "first", F.col("type").alias("head_type"), F.col("confidence").alias("head_conf"), F.lit(True).alias("has"))
        spans = spans.withColumn("first", F.col("s.first")).join(h, ["id", "w", "first"], "left")
        verdict = F.when(F.col("has"), arbitrate(F.col("s.type"), F.col("conf"), F.col("head_type"), F.col("head_conf"), abstain, disagree)).otherwise(F.struct(F.col("s.type").alias("type"), F.col("conf").alias("confidence")))
        spans = spans.withColumn("v", verdict).filter("v IS NOT NULL")
    else:
        spans = spans.withColumn("v", F.struct(F.col("s.type").alias("type"), F.col("conf").alias("confidence")))
    start, end = F.col("content")[F.col("s.first")]["s"], F.col("content")[F.col("s.last")]["e"]
    edges = (F.col("s.first") == 0) & (F.col("w") > 0), F.col("s.last") == F.size("content") - 1
    places = spans.select("id", (F.col("word_start") + F.col("s.first")).alias("first"), (F.col("word_start") + F.col("s.last")).alias("last"), edges[0].alias("cut_before"), edges[1].alias("cut_behind"), start.alias("start"), end.alias("end"), "v.type", "v.confidence")
    found = joined_pieces(places).select("id", F.struct(F.lit("").alias("text"), "start", "end", "type", "confidence").alias("x"))
    grouped = found.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("found"))
    rows = notes.select(F.col("id"), "text").join(grouped, "id", "left")
    texted = F.transform(F.coalesce("found", empty(f"array<{CANDIDATE}>")), lambda x: x.withField("text", piece(F.col("text"), x["start"], x["end"])))
    return rows.withColumn("found", texted).select("id", suppress(F.col("found"), CANDIDATE).alias("spans"))


def joined_pieces(places: DataFrame) -> DataFrame:
    """Spans (id, start, end, type, confidence) of pieces in tokens of the note (first, last, cut_before, cut_behind).

    Windows cut a span that is longer than their overlap. Pieces of a type that share a token
    are one span if the later one begins, or the earlier one ends, with its window. It has the
    confidence of its longest piece if that is the whole span, else the mean over its pieces' tokens.
    """
    w = Window.partitionBy("id", "type").orderBy("first", "last", "confidence")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = (F.col("cut_before") & (F.col("first") <= F.max("last").over(before))) | (F.col("first") <= F.max(F.when(F.col("cut_behind"), F.col("last"))).over(before))
    rows = places.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.col("last") - F.col("first") + 1)
    made = rows.groupBy("id", "type", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first") + 1).alias("whole"), F.max(F.struct("n", "confidence")).alias("best"), (F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("mean")
    )
    return made.select("id", "start", "end", "type", F.when(F.col("best.n") == F.col("whole"), F.col("best.confidence")).otherwise(F.col("mean")).alias("confidence"))


def decode_bio(rows: DataFrame, mode: str = "lenient", threshold: float = 0.5) -> DataFrame:
    """E-n: id, spans of labelled tokens (id, labels, tokens with s and e); flags reach a span when any token does."""
    made = F.transform(bio_spans(F.col("labels"), mode), lambda s: F.struct(F.col("tokens")[s["first"]]["s"].alias("start"), F.col("tokens")[s["last"]]["e"].alias("end"), s["type"].alias("type"), s["first"].alias("first"), s["last"].alias("last")))
    out = rows.withColumn("spans", made)
    if "flags" in rows.columns:
        out = out.withColumn("flagged", F.transform("spans", lambda s: any_flag(F.col("flags"), s["first"], s["last"], threshold)))
    return out


def score(gold: DataFrame, pred: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """E-e: the long score table; blocked surfaces leave both sides before."""
    if blocked is not None:
        gold, pred = (_sieved(x, blocked) for x in (gold, pred))
    return match.score_report(gold, pred)


def _sieved(files: DataFrame, blocked: DataFrame) -> DataFrame:
    # spans keep their order, on which ties of the matching depend
    rows = files.select("file", F.posexplode("spans").alias("at", "s")).select("file", "at", "s", F.col("s.text").alias("text"))
    kept = match.sieve(rows, blocked).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("kept"))
    return files.join(kept, "file", "left").select("file", F.coalesce("kept", empty(f"array<{match.SPAN}>")).alias("spans"))


def leakage_report(gold: DataFrame, preds: dict[str, DataFrame], targets: DataFrame, donors: DataFrame, most: float = leakage.MOST) -> DataFrame:
    """E-f: scores over all files and over files whose text the donors do not hold."""
    return leakage.leakage_report(gold, preds, leakage.overlap(targets, donors), most)


def lint(records: DataFrame) -> DataFrame:
    """E-g: all lint flags."""
    return stats.lint(records)


def occurrence_report(records: DataFrame, source: str | None = None) -> dict[str, DataFrame]:
    """E-j, F8: rows, summary, summary by type and warnings."""
    own = records.filter(F.col("source") == source) if source else records
    rows = stats.occurrence_rows(own)
    n = own.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.size("entities") == 0).alias("empty_records"))
    with_n = rows.crossJoin(F.broadcast(n))  # one row
    summary = stats.occurrence_summary(with_n, F.col("n_records"))
    warned = stats.occurrence_warnings(summary.crossJoin(F.broadcast(n)), F.col("empty_records"))
    return {"rows": rows, "summary": summary, "by_type": stats.occurrence_summary(with_n, F.col("n_records"), by_type=True), "warnings": warned}


def audit_screen(records: DataFrame, mode: str = "fix") -> DataFrame:
    """E-k screen: findings of rules and majorities, or deletion candidates."""
    return audit.delete_candidates(records) if mode == "delete" else audit.screen_all(records)


def audit_adjudicate(findings: DataFrame, cache: DataFrame, client: external.Client = external.offline_client, limit: int | None = None, **args) -> DataFrame:
    """E-k adjudicate: replies to all pending findings, cached ones included."""
    answered = findings.filter("NOT mechanical").join(cache.filter("error IS NULL").select("key"), "key", "left_semi").select(*findings.columns)
    open_ = audit.to_judge(findings, cache.filter("error IS NULL").select(F.col("key").alias("id")), limit).filter("NOT mechanical").select(*findings.columns)
    return external.with_cache(audit.payload(open_.unionByName(answered)), cache, client, **args)


def audit_decide(fix: DataFrame, delete: DataFrame) -> DataFrame:
    """E-l: automatic decisions on all findings."""
    return audit.auto_decide(audit.merge_findings(fix, delete))


def audit_apply(records: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """E-k apply: corrected records."""
    return audit.apply_decisions(records, findings, decisions)


def decide(decisions: DataFrame, key: str, decision: str | None, seq: int) -> DataFrame:
    """E-m, X8: set one decision, or unset it with None; other values are an error."""
    if decision not in ("accept", "reject", None):
        raise ValueError(f"no such decision: {decision}")
    row = decisions.sparkSession.createDataFrame([(key, decision, seq)], "key string, decision string, seq long")
    return postprocess.latest(decisions.unionByName(row), "key", "seq").filter("decision IS NOT NULL").select(*decisions.columns)


def draft_requests(spark: SparkSession, n_cases: int, variants: int, catalog: DataFrame, seed: int = 7, focus: bool = False) -> DataFrame:
    """E-i prepare, P11, P12: requests with brief and plan."""
    reqs = contract.requests(contract.briefs(contract.coverage_cases(spark, n_cases)), variants)
    plans = contract.build_plan(reqs, catalog, seed)
    plans = contract.add_repeats(contract.add_unlabelled(plans, catalog, 1, seed), seed, focus)
    return reqs.join(plans, "request_id").withColumn("header_mode", F.lit("explicit"))


def draft_generate(reqs: DataFrame, cache: DataFrame, client: external.Client = external.offline_client) -> DataFrame:
    """E-i generate: replies to all requests; requests that were answered are not sent again."""
    payload = reqs.select(F.col("request_id").alias("key"), F.to_json(F.struct("request_id", "brief", "plan")).alias("payload"))
    return external.with_cache(payload, cache, client)


def draft_audit(drafts: DataFrame, reqs: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """E-i audit: drafts with errors, flags and status; the same input gives the same result."""
    return contract.validate_drafts(drafts, reqs, contract.guard_terms(catalog) if catalog is not None else None)


def draft_export(drafts: DataFrame, test: float = 0.05, val: float = 0.05) -> DataFrame:
    """E-i export-training, R4: valid drafts with a hash split; a rejected draft stops the export."""
    if drafts.filter("status = 'rejected'").limit(1).count():
        raise ValueError("rejected drafts: audit first")
    return drafts.withColumn("split", split.hash_split(F.col("draft_id"), test, val))


def baseline_labels(rows: DataFrame) -> list[tuple[str, DataFrame]]:
    """E-n: the four stages of baseline spans (id, text, spans): trimmed, unblocked, merged, final.

    All stages of a note are made in its row and written once, without the note's text;
    each stage has one row for each span, with the span's text.
    """
    def stages(p: Column, one: Column) -> Column:
        final = lambda m: postprocess.final(postprocess.mapped(m))
        rest = lambda two: let(postprocess.runs_in(p, two), lambda m: F.struct(one.alias("trimmed"), two.alias("unblocked"), m.alias("merged"), final(m).alias("final")))
        return let(drop_blocked(one), rest)

    made = let(points(F.col("text")), lambda p: let(strip_in(p, F.col("spans")), lambda one: stages(p, one)))
    done = files.written(rows.select("id", made.alias("x"))).select("id", "x.*")
    flat = lambda name: done.select("id", F.explode_outer(name).alias("x")).filter("x IS NOT NULL").select("id", "x.*")
    return [(name, flat(name)) for name in ("trimmed", "unblocked", "merged", "final")]


RECORD_SCHEMA = vocab.RECORD
