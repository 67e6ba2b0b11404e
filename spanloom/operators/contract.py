"""Contracts of generated drafts: plans, marks, validation and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.core import cut, empty, hash_int, hash_unit, let, n_points, points
from ..functions.cues import cue_errors, evidence_supports, repaired
from ..functions.spans import high_precision, lexicon_hits, overlaps, surface_conflicts, surface_safe
from ..functions.text import LAYOUT_FROM, LEADING_NEGATION, MAX_SHORT, MIN_SHORT, WS, cuts_no_word, has_table, is_word_bounded, layout, measurements, natural_heading, occurrences, parse_marks, strip
from .split import weighted_choice, weighted_order

# Caps of a batch, rates of covered, empty, repeated and omitted occurrences, weight of a document's bias.
MOST_DRAFTS, MOST_VARIANTS = 6000, 40
COVERED_RATE, EMPTY_RATE = 0.18, 0.06
REPEAT_RATE, OMITTED_FIRST, FOCUS_RATE = 0.38, 0.55, 0.62
BIAS_RATE = 0.88

# Coverage profiles (key, format, heading, low yield, types in order).
PROFILES = (
    ("outpatient_followup", "outpatient_followup_note", "Tái khám", False, (vocab.SYMPTOM, vocab.DIAGNOSIS, vocab.DRUG)),
    ("admission", "admission_note_excerpt", "Nhập viện", False, (vocab.SYMPTOM, vocab.DIAGNOSIS, vocab.TEST, vocab.RESULT)),
    ("nursing", "nursing_progress_note", "Theo dõi điều dưỡng", False, (vocab.SYMPTOM, vocab.TEST, vocab.RESULT)),
    ("medication", "medication_reconciliation", "Danh sách thuốc", False, (vocab.DRUG, vocab.DIAGNOSIS, vocab.SYMPTOM)),
    ("laboratory", "laboratory_result_form", "Phiếu kết quả", False, (vocab.TEST, vocab.RESULT)),
    ("imaging", "imaging_request_note", "Chỉ định chẩn đoán hình ảnh", False, (vocab.TEST, vocab.DIAGNOSIS, vocab.RESULT, vocab.SYMPTOM)),
    ("telehealth", "telehealth_consultation", "Trao đổi từ xa", False, (vocab.SYMPTOM, vocab.DRUG, vocab.DIAGNOSIS)),
    ("referral", "referral_letter_excerpt", "Giấy chuyển tuyến", False, (vocab.DIAGNOSIS, vocab.TEST, vocab.RESULT, vocab.DRUG)),
    ("procedure", "procedure_preparation_note", "Chuẩn bị thủ thuật", False, (vocab.TEST, vocab.DRUG, vocab.SYMPTOM)),
    ("discharge", "discharge_instruction", "Dặn dò ra viện", False, (vocab.DRUG, vocab.DIAGNOSIS, vocab.SYMPTOM)),
    ("education", "patient_education_leaflet", "Thông tin dành cho người bệnh", True, (vocab.DIAGNOSIS, vocab.SYMPTOM)),
    ("counseling", "medication_counseling_leaflet", "Lưu ý khi dùng thuốc", True, (vocab.DRUG, vocab.DIAGNOSIS)),
    ("qa_answer", "patient_question_answer", "Hỏi đáp cùng bác sĩ", True, (vocab.SYMPTOM, vocab.DIAGNOSIS)),
    ("prevention", "prevention_guidance_note", "Hướng dẫn phòng ngừa", True, (vocab.DIAGNOSIS, vocab.SYMPTOM, vocab.DRUG)),
)
# Briefs by case prefix (format, heading, length, labelled, unlabelled, all mentions).
BRIEFS = (
    ("discourse.education", "patient_education_leaflet", "THÔNG TIN DÀNH CHO NGƯỜI BỆNH", 250, 550, 1, 3, 2, 4, 8),
    ("discourse.drug_example", "medication_counseling_leaflet", "LƯU Ý KHI DÙNG THUỐC", 250, 550, 0, 2, 2, 4, 7),
    ("occurrence.", "sectioned_clinical_progress_note", "DIỄN BIẾN BỆNH", 180, 420, 4, 8, 0, 2, 10),
    ("type.test_to_finding", "specialty_examination_report", "KHÁM CHUYÊN KHOA", 170, 420, 4, 8, 0, 2, 10),
    ("coverage.", None, None, 220, 500, 3, 6, 0, 2, 8),
    ("", "clinical_note", "DIỄN BIẾN", 250, 550, 3, 6, 0, 2, 8),
)
# Cue styles by assertion with their shares.
CUE_STYLES = {
    "isHistorical": {"list_marker": 0.72, "prose": 0.16, "column_field": 0.12},
    "isNegated": {"list_marker": 0.55, "prose": 0.32, "column_field": 0.13},
    "isFamily": {"list_marker": 0.62, "prose": 0.24, "column_field": 0.14},
}


def profile_table(spark) -> DataFrame:
    rows = [(k, f, h, low, list(types)) for k, f, h, low, types in PROFILES]
    frame = spark.createDataFrame(rows, "key string, document_format string, heading string, low_yield boolean, type_mix array<string>")
    order = {k: i for i, (k, *_) in enumerate(PROFILES)}
    seat = F.create_map(*[F.lit(x) for k, i in order.items() for x in (k, i if i < 10 else i - 10)])
    return frame.withColumn("seat", seat[F.col("key")])


def coverage_cases(spark, n: int) -> DataFrame:
    """Case ``index`` below n: every fourth is a low-yield profile, both kinds rotate."""
    cases = spark.range(n).select(F.col("id").cast("int").alias("index"))
    quarter = F.expr("index div 4").cast("int")
    low = F.col("index") % 4 == 3
    seat = F.when(low, quarter % 4).otherwise((F.col("index") - quarter) % 10)
    cases = cases.select("index", low.alias("low_yield"), seat.cast("int").alias("seat"))
    rows = cases.join(F.broadcast(profile_table(spark)), ["low_yield", "seat"])  # fourteen rows
    return rows.select(F.format_string("coverage.%s.%03d", "key", F.col("index") + 1).alias("case_id"), "index", "document_format", "heading", "low_yield", "type_mix")


def briefs(cases: DataFrame) -> DataFrame:
    """The generation brief of every case by the first prefix that fits its id."""
    out = None
    for p, fmt, heading, lo, hi, l0, l1, o0, o1, most in BRIEFS:
        own_format = F.lit(fmt) if fmt else F.col("document_format")
        own_heading = F.lit(heading) if heading else F.col("heading")
        row = F.struct(
            own_format.alias("document_format"),
            natural_heading(own_heading).alias("heading_text"),
            F.array(F.lit(lo), F.lit(hi)).alias("length_chars"),
            F.array(F.lit(l0), F.lit(l1)).alias("labeled"),
            F.array(F.lit(o0), F.lit(o1)).alias("intentional_o"),
            F.lit(most).alias("mentions_max"),
        )
        cond = F.col("case_id").startswith(p)
        out = F.when(cond, row) if out is None else out.when(cond, row)
    return cases.withColumn("brief", out)


def requests(cases: DataFrame, variants: int, track: str = "document") -> DataFrame:
    """Every case as ``variants`` requests; the caps are errors, not cuts."""
    if variants > MOST_VARIANTS:
        raise ValueError(f"at most {MOST_VARIANTS} variants")
    n = cases.count()
    if n * variants > MOST_DRAFTS:
        raise ValueError(f"{n} cases with {variants} variants exceed {MOST_DRAFTS} drafts")
    rows = cases.withColumn("variant_index", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    return rows.withColumn("track", F.lit(track)).withColumn("request_id", F.format_string("%s:v%02d", "case_id", "variant_index"))


def select_cases(cases: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """approved cases that are not open, optionally only the wanted ones; a missing one is an error."""
    ready = cases.filter("status <> 'open'")
    if wanted is None:
        return ready
    asked = cases.sparkSession.createDataFrame([(w,) for w in wanted], "case_id string")
    missing = [r["case_id"] for r in asked.join(ready, "case_id", "left_anti").limit(20).collect()]
    if missing:
        raise ValueError(f"cases not ready: {missing}")
    return ready.join(F.broadcast(asked), "case_id", "left_semi")  # as long as the argument


def same_requests(old: DataFrame, new: DataFrame) -> bool:
    """Whether a prepared set can be resumed: equal as multisets."""
    return old.exceptAll(new).limit(1).count() == 0 and new.exceptAll(old).limit(1).count() == 0


def request_key(*parts: Column) -> Column:
    """sha256 of the parts as JSON in the given order."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def approved(casebook_sha256: Column, approval_sha256: Column, stage: Column, wanted: str) -> Column:
    """Whether an approval is for this stage and this checksum."""
    return F.coalesce((stage == wanted) & (casebook_sha256 == approval_sha256), F.lit(False))


def planned_item(seed_id: Column, text: Column, kind: Column, should_label: Column, assertions: Column, role: Column, occurrence_role: str = "primary") -> Column:
    """One occurrence of a plan; an unlabelled one has no type and no assertions."""
    return F.struct(
        seed_id.alias("seed_id"),
        text.alias("text"),
        kind.alias("semantic_type"),
        should_label.alias("should_label"),
        F.when(should_label, kind).alias("type"),
        F.when(should_label, assertions).otherwise(empty("array<string>")).alias("assertions"),
        role.alias("role"),
        F.lit(occurrence_role).alias("occurrence_role"),
        F.lit(None).cast("string").alias("repeat_of"),
        F.lit(None).cast("string").alias("covered_by"),
        F.lit(None).cast("string").alias("order_hint"),
        F.lit(None).cast("string").alias("cue_style"),
    )


def assertion_draw(text: Column, kind: Column, bias: Column, rate: Column, *parts: Column) -> Column:
    """P5: array with the assertion a supplement gets, or nothing.

    The bias of the document wins nearly always; drugs get no history and a surface
    that negates itself no negation.
    """
    name = F.when(bias.isNotNull(), bias).otherwise(weighted_choice(list(vocab.ASSERTION_SPLIT), list(vocab.ASSERTION_SPLIT.values()), *parts, F.lit("name")))
    drawn = hash_unit(*parts, F.lit("rate")) < F.when(bias.isNotNull(), F.lit(BIAS_RATE)).otherwise(rate)
    barred = ((name == "isHistorical") & (kind == vocab.DRUG)) | ((name == "isNegated") & text.rlike(LEADING_NEGATION.replace(r"(?=\S)", "")))
    ok = drawn & kind.isin(list(vocab.ASSERTION_TYPES)) & ~barred
    return F.when(ok, F.array(name)).otherwise(empty("array<string>"))


def cue_style(assertions: Column, *parts: Column) -> Column:
    """How the text should show the assertion."""
    out = None
    for name, table in CUE_STYLES.items():
        one = weighted_choice(list(table), list(table.values()), *parts, F.lit("style"))
        out = F.when(F.array_contains(assertions, name), one) if out is None else out.when(F.array_contains(assertions, name), one)
    return out


def density_target(low_yield: Column, expected_chars: Column, *parts: Column) -> Column:
    """Struct (class, entities, assertion_rate): a density class by weight and a density inside it."""
    names = [c[0] for c in vocab.DENSITY_CLASSES]
    drawn = weighted_choice(names, [c[3] for c in vocab.DENSITY_CLASSES], *parts, F.lit("class"))
    lo, hi, rate = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, a, b, _, r in vocab.DENSITY_CLASSES:
        lo, hi, rate = (F.when(drawn == name, F.lit(float(x))).otherwise(c) for c, x in ((lo, a), (hi, b), (rate, r)))
    blank = low_yield & (hash_unit(*parts, F.lit("empty")) < EMPTY_RATE * 4)
    lo, hi = F.when(low_yield, F.lit(3.0)).otherwise(lo), F.when(low_yield, F.lit(8.0)).otherwise(hi)
    per_1k = lo + (hi - lo) * hash_unit(*parts, F.lit("density"))
    n = F.greatest(F.lit(0), F.round(per_1k * expected_chars / 1000)).cast("int")
    return F.struct(
        F.when(low_yield, F.lit("low_yield")).otherwise(drawn).alias("class"),
        F.when(blank, F.lit(0)).otherwise(n).alias("entities"),
        F.when(blank, F.lit(vocab.ASSERTION_RATE)).when(low_yield, F.lit(0.12)).otherwise(rate).alias("assertion_rate"),
    )


#: Terms of a lexicon that is kept in memory (plans, guards): most frequent first.
LEXICON = 200


def entity_catalog(rows: DataFrame, kind: Column, most: int = LEXICON, least: int = 4) -> DataFrame:
    """Text, type, n, sources, flagged: the ``most`` frequent folded surfaces of at least ``least`` characters.

    rows: surface, source. kind: the type of a folded surface, given as the column ``text``.
    """
    counts = rows.filter(F.length("surface") >= least).groupBy(F.lower("surface").alias("text")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))
    return counts.orderBy(F.desc("n"), "text").limit(most).select("text", kind.alias("type"), "n", "sources", F.lit(False).alias("flagged"))


def sample_entities(catalog: DataFrame, kind: str, k: int, seed: int, exclude: list[str] | None = None, least_sources: int = 1) -> DataFrame:
    """K surfaces of a type in hash order of seed and text: not flagged, from enough sources, in no conflict with the excluded."""
    rows = catalog.filter((F.col("type") == kind) & ~F.coalesce(F.col("flagged"), F.lit(False)) & (F.col("sources") >= least_sources))
    if exclude:
        rows = rows.filter(~surface_conflicts(F.col("text"), F.array(*map(F.lit, exclude))))
    return rows.withColumn("draw__", F.sha2(F.concat_ws(":", F.lit(seed), "text"), 256)).orderBy("draw__", "text").limit(k).drop("draw__")


def lab_pair(catalog: DataFrame, seed: int) -> DataFrame:
    """One safe test and one safe result, which are planned together."""
    safe = catalog.filter(surface_safe(F.col("text")))
    return sample_entities(safe, vocab.TEST, 1, seed).unionByName(sample_entities(safe, vocab.RESULT, 1, seed))


def build_plan(reqs: DataFrame, catalog: DataFrame, seed: int, per_type: int = 3) -> DataFrame:
    """request_id, plan: surfaces of the types that a request asks for.

    catalog: text, type, flagged. For each request and type the surfaces come in hash
    order; unsafe ones are left out beforehand, later ones that equal or contain an
    earlier one go, as does what exceeds the labelled budget. Surfaces are drawn by a
    hash window of the catalogue around a random place, not by pairing all with all.
    """
    usable = catalog.filter(~F.coalesce(F.col("flagged"), F.lit(False))).filter(surface_safe(F.col("text"))).select("text", "type").distinct()
    ring = usable.withColumn("slot", F.row_number().over(Window.partitionBy("type").orderBy(F.sha2("text", 256), "text")) - 1)
    sizes = ring.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    asked = reqs.select("request_id", "brief", F.posexplode(weighted_order_of("type_mix", seed)).alias("rank", "type"))
    asked = asked.join(F.broadcast(sizes), "type")  # one row for each type
    picks = asked.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_type - 1))))
    picks = picks.withColumn("slot", (hash_int(F.lit(seed), F.col("request_id"), F.col("type"), F.col("k")) % F.col("n")).cast("int"))
    # a surface that is drawn again keeps its first draw
    rows = picks.join(ring, ["type", "slot"]).groupBy("request_id", "text").agg(F.min(F.struct("k", "rank", "type")).alias("x"))
    ordered = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("x.k", "x.rank", "text", "x.type"))).alias("items")).join(reqs.select("request_id", "brief"), "request_id")
    kind = "array<struct<k:int,rank:int,text:string,type:string>>"
    step = lambda kept, x: F.when(surface_conflicts(x["text"], F.transform(kept, lambda y: y["text"])), kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.slice(F.aggregate("items", empty(kind), step), F.lit(1), F.col("brief.labeled")[1])
    item = lambda x, i: planned_item(
        F.format_string("core:%02d", i + 1), x["text"], x["type"], F.lit(True), assertion_draw(x["text"], x["type"], F.lit(None).cast("string"), F.lit(vocab.ASSERTION_RATE), F.lit(seed), F.col("request_id"), x["text"]), F.lit("supplemental_random")
    )
    return ordered.select("request_id", F.transform(kept, item).alias("plan"))


def weighted_order_of(column: str, seed: int) -> Column:
    """A row's own types, heavy ones tending to come first."""
    ordered = weighted_order(list(vocab.GOLD_WEIGHTS), list(vocab.GOLD_WEIGHTS.values()), F.lit(seed), F.col("request_id"))
    return F.filter(ordered, lambda t: F.array_contains(column, t))


def add_unlabelled(plans: DataFrame, catalog: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` further safe surfaces that appear without label, in no conflict with the plan."""
    terms = catalog.filter(surface_safe(F.col("text"))).select("text", "type").distinct()
    ring = terms.withColumn("slot", F.row_number().over(Window.orderBy(F.sha2("text", 256), "text")) - 1)
    n = terms.count()
    if n == 0 or count == 0:
        return plans
    picks = plans.select("request_id", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("k"))
    picks = picks.withColumn("slot", (hash_int(F.lit(seed), F.col("request_id"), F.lit("o"), F.col("k")) % n).cast("int"))
    drawn = picks.join(ring, "slot").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("k", "text", "type"))).alias("extra"))
    rows = plans.join(drawn, "request_id", "left")
    taken = F.transform("plan", lambda x: x["text"])
    free = F.filter(F.coalesce("extra", empty("array<struct<k:int,text:string,type:string>>")), lambda x: ~surface_conflicts(x["text"], taken))
    item = lambda x: planned_item(F.format_string("discourse_o:%02d", x["k"]), x["text"], x["type"], F.lit(False), empty("array<string>"), F.lit("intentional_o_discourse"), "intentional_o")
    return rows.select("request_id", F.concat("plan", F.transform(free, item)).alias("plan"))


def covered_phrase(text: Column, lexicon: Column) -> Column:
    """The longest, then leftmost, proper phrase of a surface (4 or more characters) in the lexicon, else null."""
    words = F.split(strip(text), rf"[{WS}]+", -1)

    def phrases(w: Column) -> Column:
        n = F.size(w)
        sizes = F.sequence(n - 1, F.lit(1), F.lit(-1))
        own = lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda s: strip(F.array_join(F.slice(w, s + 1, k), " "), r" ,.;:()"))
        made = F.flatten(F.transform(sizes, own))
        fits = F.filter(made, lambda p: (F.length(p) >= 4) & (p != text) & F.array_contains(lexicon, p))
        return F.when(n >= 2, F.get(fits, F.lit(0)))

    return let(words, phrases)


def add_covered(plans: DataFrame, lexicon: Column, seed: int, rate: float = COVERED_RATE) -> DataFrame:
    """At the given rate, a short known phrase inside a longer planned surface, without label."""
    hosts = F.transform(F.filter("plan", lambda x: x["should_label"]), lambda x: F.struct(x.alias("x"), covered_phrase(x["text"], lexicon).alias("p")))
    found = F.get(F.filter(hosts, lambda h: h["p"].isNotNull()), F.lit(0))
    item = planned_item(F.lit("covered:01"), found["p"], found["x"]["semantic_type"], F.lit(False), empty("array<string>"), F.lit("covered_by_longer_entity"), "covered_by_longer").withField("covered_by", found["x"]["seed_id"])
    wanted = (hash_unit(F.lit(seed), F.col("request_id"), F.lit("covered")) < rate) & found.isNotNull()
    return plans.select("request_id", F.when(wanted, F.concat("plan", F.array(item))).otherwise(F.col("plan")).alias("plan"))


def add_repeats(plans: DataFrame, seed: int, focus: bool = False) -> DataFrame:
    """One to three (focus: two to four) planned surfaces again, with or without label and with an order hint."""
    counts, weights, rate = (("2", "3", "4"), (0.30, 0.45, 0.25), FOCUS_RATE) if focus else (("1", "2", "3"), (0.50, 0.35, 0.15), REPEAT_RATE)
    part = (F.lit(seed), F.col("request_id"))
    eligible = F.filter("plan", lambda x: x["should_label"] & x["type"].isin(list(vocab.ASSERTION_TYPES)) & (F.length(x["text"]) >= 4))
    drawn = F.transform(F.array_sort(F.transform(eligible, lambda x: F.struct(hash_int(*part, F.lit("repeat"), x["seed_id"]).alias("h"), x.alias("x")))), lambda y: y["x"])
    chosen = F.slice(drawn, F.lit(1), weighted_choice(counts, weights, *part, F.lit("repeats")).cast("int"))

    def again(x: Column, i: Column) -> Column:
        own = (*part, F.lit("again"), x["seed_id"])
        omitted = hash_unit(*own, F.lit("gate")) < rate
        before = hash_unit(*own, F.lit("order")) < OMITTED_FIRST
        other = F.when((x["type"] != vocab.DRUG) & ~F.array_contains(x["assertions"], "isHistorical"), F.lit("isHistorical")).otherwise(F.lit("isNegated"))
        fresh = (hash_unit(*own, F.lit("assertion")) < 0.6) & ~F.array_contains(x["assertions"], other) & ~((other == "isNegated") & x["text"].rlike(LEADING_NEGATION))
        marks = F.when(fresh, F.array(other)).otherwise(empty("array<string>"))
        item = planned_item(F.format_string("repeat:%02d", i + 1), x["text"], x["semantic_type"], ~omitted, marks, F.when(omitted, F.lit("occurrence_gate_negative")).otherwise(F.lit("occurrence_repeat_labeled")))
        item = item.withField("occurrence_role", F.when(omitted, F.lit("repeat_omitted")).otherwise(F.lit("repeat_labeled"))).withField("repeat_of", x["seed_id"])
        return item.withField("order_hint", F.when(omitted, F.when(before, F.lit("before_primary")).otherwise(F.lit("after_primary"))))

    return plans.select("request_id", F.concat("plan", F.transform(chosen, again)).alias("plan"))


def gate_positions(text: Column, marks: Column, plan: Column) -> Column:
    """Struct of positions (seed_id, s, e) and errors that match marks with a plan.

    Labelled rows need exactly one mark with their surface; covered rows must occur
    inside an occurrence of their host and nowhere else; other unlabelled rows take,
    in plan order, the first occurrence outside all marks that none took before.
    """
    pos = "array<struct<seed_id:string,s:int,e:int>>"
    labelled = F.filter(plan, lambda x: x["should_label"])
    of_seed = lambda seed: F.filter(marks, lambda m: m["id"] == seed)
    err = lambda code, seed: F.concat(F.lit(code + ":"), seed)
    ids = F.array_distinct(F.transform(marks, lambda m: m["id"]))
    foreign = F.transform(F.filter(ids, lambda i: ~F.exists(labelled, lambda x: x["seed_id"] == i)), lambda i: err("unplanned_mark", i))
    twice = F.transform(F.filter(ids, lambda i: F.size(of_seed(i)) > 1), lambda i: err("repeated_mark", i))
    missing = F.transform(F.filter(labelled, lambda x: F.size(of_seed(x["seed_id"])) == 0), lambda x: err("missing_mark", x["seed_id"]))
    row_of = lambda m: F.get(F.filter(plan, lambda x: x["seed_id"] == m["id"]), F.lit(0))
    other = F.transform(F.filter(marks, lambda m: row_of(m)["text"] != m["text"]), lambda m: err("other_surface", m["id"]))
    same = F.filter(marks, lambda m: row_of(m)["text"] == m["text"])
    cut = F.transform(F.filter(same, lambda m: ~is_word_bounded(text, m["s"], m["e"])), lambda m: err("cut_word", m["id"]))
    placed = F.transform(same, lambda m: F.struct(m["id"].alias("seed_id"), m["s"].alias("s"), m["e"].alias("e")))

    def hidden(x: Column) -> Column:
        n = F.length(x["text"])
        host = F.get(F.filter(plan, lambda y: y["seed_id"] == x["covered_by"]), F.lit(0))["text"]
        hosts = F.coalesce(occurrences(text, host), empty("array<int>"))
        held = lambda s: F.exists(hosts, lambda h: (h <= s) & (s + n <= h + F.length(host)))

        def judged(occ: Column) -> Column:
            inner, outer = F.filter(occ, held), F.filter(occ, lambda s: ~held(s))
            errors = F.array_compact(F.array(F.when(F.size(inner) == 0, err("covered_missing", x["seed_id"])), F.when(F.size(outer) > 0, err("covered_outside", x["seed_id"]))))
            at = F.when(F.size(inner) > 0, F.array(F.struct(x["seed_id"].alias("seed_id"), inner[0].alias("s"), (inner[0] + n).alias("e")))).otherwise(empty(pos))
            return F.struct(at.alias("p"), errors.alias("errors"))

        return let(occurrences(text, x["text"]), judged)

    covered = F.transform(F.filter(plan, lambda x: ~x["should_label"] & (x["occurrence_role"] == "covered_by_longer")), hidden)
    plain = F.filter(plan, lambda x: ~x["should_label"] & ~F.coalesce(x["occurrence_role"] == "covered_by_longer", F.lit(False)))

    def step(state: Column, x: Column) -> Column:
        n = F.length(x["text"])
        free = F.filter(
            occurrences(text, x["text"]),
            lambda s: ~F.exists(marks, lambda m: (m["s"] <= s) & (s + n <= m["e"])) & ~F.exists(state["p"], lambda u: (u["s"] == s) & (u["e"] == s + n)),
        )

        def took(f: Column) -> Column:
            hit = F.size(f) > 0
            at = F.struct(x["seed_id"].alias("seed_id"), f[0].alias("s"), (f[0] + n).alias("e"))
            return F.struct(
                F.when(hit, F.concat(state["p"], F.array(at))).otherwise(state["p"]).alias("p"),
                F.when(hit, state["errors"]).otherwise(F.concat(state["errors"], F.array(err("missing_occurrence", x["seed_id"])))).alias("errors"),
            )

        return let(free, took)

    rest = F.aggregate(plain, F.struct(empty(pos).alias("p"), empty("array<string>").alias("errors")), step)

    def joined(x: Column) -> Column:
        return F.struct(
            F.concat(placed, F.flatten(F.transform(x["c"], lambda y: y["p"])), x["r"]["p"]).alias("positions"),
            F.concat(foreign, twice, missing, other, cut, F.flatten(F.transform(x["c"], lambda y: y["errors"])), x["r"]["errors"]).alias("errors"),
        )

    return let(F.struct(covered.alias("c"), rest.alias("r")), joined)


def surface_counts(text: Column, plan: Column) -> Column:
    """Rule 30: surfaces that do not occur exactly as often as the plan lists them, covered rows aside."""
    own = F.filter(plan, lambda x: ~F.coalesce(x["occurrence_role"] == "covered_by_longer", F.lit(False)))
    texts = F.transform(own, lambda x: x["text"])
    wrong = F.filter(F.array_distinct(texts), lambda s: F.size(occurrences(text, s)) != F.size(F.filter(texts, lambda t: t == s)))
    return F.transform(wrong, lambda s: F.concat(F.lit("occurrence_count:"), s))


def unplanned(text: Column, plan: Column, heading: Column, terms: Column) -> Column:
    """Struct of measurements and lexicon terms that neither plan nor heading holds."""
    known = F.flatten(F.transform(plan, lambda x: F.transform(occurrences(text, x["text"]), lambda s: F.struct(s.alias("start"), (s + F.length(x["text"])).alias("end")))))
    head = F.when(F.length(F.coalesce(heading, F.lit(""))) > 0, F.transform(occurrences(text, heading), lambda s: F.struct(s.alias("start"), (s + F.length(heading)).alias("end")))).otherwise(empty("array<struct<start:int,end:int>>"))

    def free(x: Column) -> Column:
        clear = lambda s: ~F.exists(x["taken"], lambda k: overlaps(k, s))
        numbers = F.filter(F.transform(measurements(text), lambda h: F.struct(h["s"].alias("start"), h["e"].alias("end"), h["hit"].alias("term"))), clear)
        return F.struct(numbers.alias("measurements"), F.filter(x["hits"], clear).alias("terms"))

    return let(F.struct(F.concat(known, head).alias("taken"), lexicon_hits(F.lower(text), terms).alias("hits")), free)


def guard_terms(catalog: DataFrame, least: int = 3) -> DataFrame:
    """One row with the high-precision terms, longest first; they are a bounded lexicon."""
    rows = catalog.filter(high_precision(F.col("text"), F.col("type"))).filter(F.length("text") >= least).select(F.lower("text").alias("t")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("t")).alias("n"), "t")))
    return rows.agg(F.transform(ordered, lambda x: x["t"]).alias("terms"))


def validate_drafts(drafts: DataFrame, reqs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Draft columns with errors, quality_flags and status.

    drafts: draft_id, marked_text, source_case_id, document_format, section_path,
    mentions. reqs: request_id, case_id, brief, header_mode, plan. A draft without
    request has one error. The rules are small boolean columns; the first group
    rejects, the second only flags.
    """
    rows = drafts.join(reqs.withColumnRenamed("request_id", "draft_id").withColumnRenamed("case_id", "want_case"), "draft_id", "left")
    rows = rows.withColumn("parsed", parse_marks(F.coalesce("marked_text", F.lit(""))))
    rows = rows.withColumn("text", F.col("parsed.raw")).withColumn("lay", layout(F.col("parsed.raw")))
    plan = F.coalesce(F.col("plan"), F.filter(F.array(planned_item(*[F.lit("")] * 3, F.lit(False), empty("array<string>"), F.lit(""))), lambda x: F.lit(False)))
    rows = rows.withColumn("plan", plan)
    rows = rows.withColumn("gate", gate_positions(F.col("text"), F.col("parsed.marks"), F.col("plan")))
    if terms is not None:
        rows = rows.crossJoin(F.broadcast(terms))  # one row
    else:
        rows = rows.withColumn("terms", empty("array<string>"))
    rows = rows.withColumn("extra", unplanned(F.col("text"), F.col("plan"), F.col("brief.heading_text"), F.col("terms")))
    text, n, b, m = F.col("text"), F.length("text"), F.col("brief"), F.col("mentions")
    long_ = n >= LAYOUT_FROM
    prose = long_ & ((F.col("lay.lines") < F.col("lay.required")) | (F.col("lay.short_ratio") < MIN_SHORT))
    drift = long_ & ~prose & ~((F.col("lay.lines") >= 24) & F.col("lay.short_ratio").between(0.42, MAX_SHORT))
    low = F.lower(text)
    first = F.get(F.filter(F.transform(F.split(text, "\n", -1), lambda x: strip(x)), lambda x: x != ""), F.lit(0))
    shout = (F.length(first) >= 4) & (first == F.upper(first)) & first.rlike(r"\p{L}")
    head, path = b["heading_text"], F.coalesce("section_path", empty("array<string>"))
    no_header = F.col("header_mode") == "none"
    seeds = F.transform(m, lambda x: x["seed_id"])
    planned = F.transform("plan", lambda x: x["seed_id"])
    # Mentions become rows, so that each of their values is a plain column.
    own = rows.select("draft_id", "text", F.posexplode("mentions").alias("k", "x"), "plan", F.col("gate.positions").alias("pos"))
    x = F.col("x")
    own = own.withColumn("p", F.get(F.filter("plan", lambda y: y["seed_id"] == F.col("x.seed_id")), F.lit(0))).withColumn("s", F.get(F.filter("pos", lambda y: y["seed_id"] == F.col("x.seed_id")), F.lit(0))["s"]).drop("plan", "pos")
    own = own.withColumn("e", F.col("s") + F.length("x.text")).withColumn("marks", F.coalesce("x.assertions", empty("array<string>"))).withColumn("asked", F.coalesce("p.assertions", empty("array<string>")))
    own = own.withColumn("fixed", F.coalesce(repaired(F.col("text"), F.col("s"), F.col("e"), F.col("p.type"), F.col("asked")), F.col("marks")))
    own = own.withColumn("disagrees", F.size(cue_errors(F.col("text"), F.col("s"), F.col("e"), F.col("x.type"), F.col("fixed"))) > 0)
    own = own.withColumn("loose", F.col("s").isNotNull() & ~evidence_supports(F.col("text"), F.col("x.text"), F.col("s"), F.coalesce("x.context_evidence", F.lit(""))))
    p, s, marks = F.col("p"), F.col("s"), F.col("marks")
    checks = [
        (~x["text"].eqNullSafe(p["text"]) | ~x["should_label"].eqNullSafe(p["should_label"]) | ~x["type"].eqNullSafe(p["type"]), "differs_from_plan"),
        (F.coalesce(x["text"], F.lit("")) == "", "no_surface"),
        (s.isNull(), "no_position"),
        (x["position"].isNotNull() & ~x["position"].eqNullSafe(F.array(s, F.col("e"))), "stored_position"),
        (x["should_label"].isNull(), "should_label"),
        (x["should_label"] & ~F.coalesce(x["type"].isin(list(vocab.TYPES)), F.lit(False)), "bad_type"),
        (x["should_label"] & (F.size(F.array_except(marks, F.array(*[F.lit(a) for a in vocab.ASSERTIONS]))) > 0), "bad_assertion"),
        (x["should_label"] & (F.size(marks) > 0) & ~x["type"].isin(list(vocab.ASSERTION_TYPES)), "assertion_on_type"),
        (x["should_label"] & F.lower(strip(x["text"])).isin(vocab.listed(vocab.META_NOUNS)), "meta_noun"),
        (x["should_label"] & (x["type"] == vocab.DRUG) & F.array_contains(marks, "isHistorical"), "historical_drug"),
        (~x["should_label"] & (x["type"].isNotNull() | (F.size(marks) > 0)), "unlabelled_with_label"),
        (F.coalesce(strip(x["context_evidence"]), F.lit("")) == "", "no_evidence"),
        (F.coalesce(strip(x["rationale"]), F.lit("")) == "", "no_rationale"),
        (x["should_label"] & s.isNotNull() & F.col("disagrees") & x["type"].isin(list(vocab.ASSERTION_TYPES)), "cue_disagrees"),
    ]
    made = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.concat(F.lit(f"{t}:"), F.coalesce(x["seed_id"], F.lit("?")))) for c, t in checks]))
    changed = x["should_label"] & (F.size(F.array_union(F.array_except("asked", "fixed"), F.array_except("fixed", "asked"))) > 0)
    judged = own.select("draft_id", "k", made.alias("made"), F.coalesce(changed, F.lit(False)).alias("changed"), F.coalesce("loose", F.lit(False)).alias("loose"))
    judged = judged.groupBy("draft_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "made"))), lambda y: y["made"])).alias("mention_errors"), F.bool_or("changed").alias("changed"), F.bool_or("loose").alias("loose"))
    rows = rows.join(judged, "draft_id", "left")
    spans = F.array_sort(F.transform(F.filter("gate.positions", lambda p: F.exists("plan", lambda y: (y["seed_id"] == p["seed_id"]) & y["should_label"])), lambda p: F.struct(p["s"].alias("start"), p["e"].alias("end"))))
    overlap = let(spans, neighbours_overlap)
    seen = F.coalesce(m, F.array().cast(F_MENTIONS))
    errors = [
        (F.col("want_case").isNull(), F.lit("no_request")),
        (F.coalesce("marked_text", F.lit("")) == "", F.lit("no_marked_text")),
        (F.col("source_case_id") != F.col("want_case"), F.lit("source_case")),
        (~n.between(20, 1500), F.lit("length")),
        (prose, F.lit("layout")),
        (F.exists(F.array(*[F.lit(p) for p in vocab.listed(vocab.META_PHRASES)]), lambda p: low.contains(p)), F.lit("meta_text")),
        (~F.col("document_format").eqNullSafe(b["document_format"]), F.lit("document_format")),
        (F.col("section_path").isNull(), F.lit("section_path")),
        (no_header & (F.size(path) > 0), F.lit("path_without_header")),
        (no_header & shout, F.lit("header_without_mode")),
        (~no_header & ~F.coalesce(text.contains(head), F.lit(False)), F.lit("no_heading")),
        (~no_header & ~F.coalesce(F.array_contains(path, head), F.lit(False)), F.lit("heading_not_in_path")),
        (has_table(text), F.lit("table")),
        (F.size(seen) == 0, F.lit("no_mentions")),
        (F.exists(seen, lambda x: x["seed_id"].isNull()), F.lit("seed_null")),
        (F.size(F.array_distinct(seeds)) < F.size(seeds), F.lit("seed_repeated")),
        (F.size(F.array_except(planned, seeds)) > 0, F.lit("seed_missing")),
        (F.size(F.array_except(F.array_compact(seeds), planned)) > 0, F.lit("seed_unexpected")),
        (overlap, F.lit("labelled_overlap")),
        (F.size("extra.measurements") > 0, F.lit("unplanned_measurement")),
    ]
    flat = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in errors]))
    every = F.concat(flat, F.col("parsed.errors"), F.col("gate.errors"), F.coalesce("mention_errors", empty("array<string>")), surface_counts(text, F.col("plan")))
    labelled = F.size(F.filter(seen, lambda x: F.coalesce(x["should_label"], F.lit(False))))
    flags = [
        (~n.between(b["length_chars"][0], b["length_chars"][1]), F.lit("length_budget")),
        (drift, F.lit("layout_drift")),
        (F.col("changed"), F.lit("assertion_repaired")),
        (F.col("loose"), F.lit("evidence_not_anchored")),
        (F.size("extra.terms") > 0, F.lit("unplanned_term")),
        (~labelled.between(b["labeled"][0], b["labeled"][1]), F.lit("labelled_budget")),
        (~(F.size(seen) - labelled).between(b["intentional_o"][0], b["intentional_o"][1]), F.lit("unlabelled_budget")),
        (F.size(seen) > b["mentions_max"], F.lit("mention_budget")),
    ]
    rows = rows.withColumn("errors", every).withColumn("quality_flags", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in flags])))
    status = F.when(F.size("errors") > 0, "rejected").when(F.size("quality_flags") > 0, "valid_with_flags").otherwise("valid")
    return rows.select("draft_id", "source_case_id", "document_format", "section_path", "text", "mentions", "marked_text", F.col("gate.positions").alias("positions"), "errors", "quality_flags", status.alias("status"))


F_MENTIONS = f"array<{vocab.MENTION}>"


def neighbours_overlap(spans: Column) -> Column:
    """Whether any span in order of place shares a character with the next."""
    return F.exists(F.transform(spans, lambda s, i: F.coalesce(F.get(spans, i + 1)["start"] < s["end"], F.lit(False))), lambda x: x)


def draft_distribution(drafts: DataFrame) -> DataFrame:
    """Long table (what, key, n, value) of drafts: size, labels, density, types, formats, flags, status."""
    named = drafts.withColumn("lab", F.filter("mentions", lambda x: F.coalesce(x["should_label"], F.lit(False))))
    whole = named.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("lab")).alias("labelled"), F.sum(F.size("mentions") - F.size("lab")).alias("unlabelled"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in ("chars", "labelled", "unlabelled")], F.struct(F.lit("per_1k").alias("key"), F.try_divide(1000.0 * F.col("labelled"), "chars").alias("value"))))
    total = whole.select("n", rows.alias("x")).select(F.lit("total").alias("what"), "x.key", "n", "x.value")
    by = lambda what, key, df: df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "key", "n", F.lit(None).cast("double").alias("value"))
    out = total.unionByName(by("type", F.col("x.type"), named.select(F.explode("lab").alias("x"))))
    out = out.unionByName(by("format", F.col("document_format"), named)).unionByName(by("status", F.col("status"), named))
    return out.unionByName(by("flag", F.col("flag"), named.select(F.explode("quality_flags").alias("flag"))))


def validate_labels(rows: DataFrame) -> DataFrame:
    """Errors of review labels (id, text, entities): the lint checks and word edges."""

    def of(p: Column, e: Column) -> Column:
        fits = F.coalesce((e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= n_points(p)), F.lit(False))
        checks = [
            (~fits, "bad_position"),
            (fits & (cut(p, e["start"], e["end"]) != e["text"]), "text_mismatch"),
            (fits & ~cuts_no_word(p, e["start"], e["end"]), "cut_word"),
            (~F.coalesce(e["type"].isin(list(vocab.TYPES)), F.lit(False)), "bad_type"),
            (F.size(F.array_except(e["assertions"], F.array(*[F.lit(a) for a in vocab.ASSERTIONS]))) > 0, "bad_assertion"),
            ((F.size(e["assertions"]) > 0) & ~e["type"].isin(list(vocab.ASSERTION_TYPES)), "assertion_on_type"),
            ((F.size(F.coalesce(e["candidates"], empty("array<string>"))) > 0) & ~e["type"].isin(list(vocab.CANDIDATE_TYPES)), "candidates_on_type"),
        ]
        return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in checks]))

    order = F.array_sort(F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
    clash = let(order, neighbours_overlap)
    errors = F.concat(F.flatten(let(points(F.col("text")), lambda p: F.transform("entities", lambda e: of(p, e)))), F.when(clash, F.array(F.lit("overlap"))).otherwise(empty("array<string>")))
    return rows.select("id", errors.alias("errors"))


def app_label(mention: Column) -> Column:
    """The label a reviewer sees."""
    return F.struct(mention["text"].alias("text"), mention["position"].alias("position"), mention["type"].alias("type"), mention["assertions"].alias("assertions"), empty("array<string>").alias("candidates"))


def semantic_type(own: Column, lexicon_types: Column, fallbacks: Column) -> Column:
    """P10: the decision's own type, else the only one the lexicon knows, else the first fallback, else null."""
    return F.coalesce(own, F.when(F.size(lexicon_types) == 1, lexicon_types[0]), F.get(fallbacks, F.lit(0)))


def review_packet(drafts: DataFrame) -> DataFrame:
    """Drafts whose mentions carry blank fields for a reviewer."""
    blank = lambda x: x.withField("review_verdict", F.lit(None).cast("string")).withField("review_note", F.lit(None).cast("string"))
    return drafts.withColumn("mentions", F.transform("mentions", blank)).withColumn("reviewer", F.lit(None).cast("string"))
