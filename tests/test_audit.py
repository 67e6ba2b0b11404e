"""Screens, verdicts, decisions, contracts, splits, sources, streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.functions import vocab
from spanloom.operators import audit, contract, leakage, postprocess, split
from spanloom.plans import jobs
from spanloom.sources import readers, sinks
from spanloom.streaming import external, journal


def ent(text, surface, kind, *marks):
    s = text.index(surface)
    return (surface, s, s + len(surface), kind, list(marks), [], True)


def records(spark, *rows):
    data = [(f"r{i}", t, es, "gold_document", "part1", "g") for i, (t, es) in enumerate(rows)]
    return spark.createDataFrame(data, f"id string, text string, entities {vocab.ENTITIES}, record_kind string, source string, genre string")


SCREENS = [
    ("PLT: 190 g/L", "190 g/L", vocab.RESULT, ["isNegated"], "assertion_on_forbidden_type", []),
    ("Người bệnh không có đau ngực trong đợt này.", "đau ngực", vocab.SYMPTOM, [], "cue_without_assertion", ["isNegated"]),
    ("Hiện tại người bệnh vàng da và mệt nhiều.", "vàng da", vocab.SYMPTOM, ["isHistorical"], "assertion_without_cue", []),
    ("Tiền sử: người bệnh từng mắc viêm phổi năm 2019.", "viêm phổi", vocab.DIAGNOSIS, ["isHistorical"], None, None),
    ("Người bệnh đau ngực từ sáng nay.", "đau ngực", vocab.SYMPTOM, [], None, None),
    ("Khám: không chóng mặt trong đợt này.", "không chóng mặt", vocab.SYMPTOM, [], "negation_inside_span", ["isNegated"]),
    ("Đã ngừng, tiền sử aspirin", "aspirin", vocab.DRUG, ["isHistorical"], "historical_drug", []),
    ("x không y", "y", vocab.SYMPTOM, ["isNegated", "zzz"], "unknown_assertion", ["isNegated"]),
]


def test_screens(spark):
    df = records(spark, *[(t, [ent(t, s, k, *m)]) for t, s, k, m, _, _ in SCREENS])
    got = {r.file: r for r in audit.screen(df).collect()}
    for i, (_, _, _, _, kind, proposed) in enumerate(SCREENS):
        r = got.get(f"r{i}")
        assert (r.kind if r else None) == kind
        if kind:
            assert r.proposed.assertions == proposed and r.context.surface == SCREENS[i][1]


def test_swallowed_negation(spark):
    t = "Người bệnh phủ nhận: ho. Không đau đầu, không sốt."
    df = records(spark, ("Có. Không ghi nhận Không đau đầu", [ent("Có. Không ghi nhận Không đau đầu", "Không đau đầu", vocab.SYMPTOM, "isNegated")]), (t, []))
    r = audit.screen(df).first()
    assert r.kind == "span_swallows_negation" and r.proposed.text == "đau đầu"


def test_majority_screen(spark):
    rows = [("khó thở", [ent("khó thở", "khó thở", vocab.SYMPTOM)])] * 9 + [("khó thở", [ent("khó thở", "khó thở", vocab.DIAGNOSIS)])]
    got = audit.screen_minority(records(spark, *rows)).collect()
    assert [(r.file, r.proposed.type) for r in got] == [("r9", vocab.SYMPTOM)]


def findings(spark):
    t = "đau ngực và ho khan, sốt cao"
    df = records(spark, (t, [ent(t, s, vocab.SYMPTOM, "isNegated") for s in ("đau ngực", "ho khan", "sốt cao")]))
    return df, audit.delete_candidates(df)


def test_resolve_never_widens(spark):
    _, found = findings(spark)
    verdicts = spark.createDataFrame([("r0#0", "change", ["isFamily"], None, "rất đau ngực"), ("r0#1", "change", ["isNegated"], vocab.RESULT, "khan"), ("r0#2", "keep", ["isNegated"], None, None)], "id string, verdict string, assertions array<string>, type string, span string")
    got = {r.key: r.proposed for r in audit.resolve_change(found, verdicts).collect()}
    assert set(got) == {"r0#0", "r0#1"}
    assert got["r0#0"].text is None and got["r0#0"].assertions == ["isFamily"]
    assert got["r0#1"].assertions == [] and got["r0#1"].text == "khan" and got["r0#1"].start == 15


def test_delete_beats_fix_and_keeps_places(spark):
    df, found = findings(spark)
    fix = found.filter("entity_index > 0").withColumn("kind", F.lit("fix")).withColumn("proposed", audit._proposal(F.array(F.lit("isFamily"))))
    merged = audit.merge_findings(fix, found.filter("entity_index < 2"))
    got = {r.key: (r.kind, r.supersedes_fix) for r in merged.collect()}
    assert got == {"r0#0": ("delete_candidate", None), "r0#1": ("delete_candidate", "fix"), "r0#2": ("fix", None)}
    decisions = spark.createDataFrame([("r0#0", "accept"), ("r0#1", "reject"), ("r0#2", "accept")], "key string, decision string")
    left = audit.apply_decisions(df, merged, decisions).first().entities
    assert [(e.text, e.assertions) for e in left] == [("ho khan", ["isNegated"]), ("sốt cao", ["isFamily"])]
    reasons = {r.key: r.reason for r in audit.auto_decide(merged).collect()}
    assert reasons["r0#0"] == "delete_with_assertion" and reasons["r0#2"] is None


def test_stale_verdicts_and_pending(spark):
    _, found = findings(spark)
    sig = audit.input_signature("prompt", "400")
    rows = spark.createDataFrame([("r0#0", "a", "old", 1), ("r0#1", "b", None, 2), ("r0#1", "c", None, 3)], "id string, verdict string, input_signature string, seq int")
    rows = rows.withColumn("input_signature", F.coalesce("input_signature", sig))
    now = audit.current_verdicts(rows, sig)
    assert [(r.id, r.verdict) for r in now.collect()] == [("r0#1", "c")]
    assert sorted(r.key for r in audit.pending(found, now).collect()) == ["r0#0", "r0#2"]


MARKED = 'DIỄN BIẾN\nNgười bệnh <E id="core:01">đau ngực</E> từ sáng, không thấy đau ngực thêm.'


def plan_items(spark, *items):
    rows = [tuple(x) for x in items]
    kind = "array<struct<seed_id:string,text:string,semantic_type:string,should_label:boolean,type:string,assertions:array<string>,role:string,occurrence_role:string,repeat_of:string,covered_by:string,order_hint:string,cue_style:string>>"
    return spark.createDataFrame([(rows,)], f"plan {kind}")


def item(seed, text, label=True, role="primary", covered=None):
    return (seed, text, vocab.SYMPTOM, label, vocab.SYMPTOM if label else None, [], "core", role, None, covered, None, None)


def test_gate_positions(spark):
    from spanloom.functions.text import parse_marks

    cases = [
        ([item("core:01", "đau ngực"), item("repeat:01", "đau ngực", False, "repeat_omitted")], []),
        ([item("core:01", "đau ngực"), item("a", "đau ngực", False), item("b", "đau ngực", False)], ["missing_occurrence:b"]),
        ([item("core:02", "đau ngực")], ["unplanned_mark:core:01", "missing_mark:core:02"]),
        ([item("core:01", "đau ngực"), item("c", "ngực", False, "covered_by_longer", "core:01")], []),
        ([item("core:01", "đau ngực"), item("c", "sáng", False, "covered_by_longer", "core:01")], ["covered_missing:c", "covered_outside:c"]),
    ]
    for items, errors in cases:
        df = plan_items(spark, *items).withColumn("x", parse_marks(F.lit(MARKED)))
        r = df.select(contract.gate_positions(F.col("x.raw"), F.col("x.marks"), F.col("plan")).alias("g"), contract.surface_counts(F.col("x.raw"), F.col("plan")).alias("n")).first()
        assert sorted(e for e in r.g.errors if not e.startswith("other_surface")) == sorted(errors)


def test_drafts(spark):
    reqs = plan_items(spark, item("core:01", "đau ngực"), item("repeat:01", "đau ngực", False, "repeat_omitted"))
    brief = F.struct(F.lit("note").alias("document_format"), F.lit("DIỄN BIẾN").alias("heading_text"), F.array(F.lit(20), F.lit(300)).alias("length_chars"), F.array(F.lit(1), F.lit(2)).alias("labeled"), F.array(F.lit(0), F.lit(2)).alias("intentional_o"), F.lit(5).alias("mentions_max"))
    reqs = reqs.select(F.lit("d1").alias("request_id"), F.lit("case").alias("case_id"), brief.alias("brief"), F.lit("explicit").alias("header_mode"), "plan")
    mention = lambda seed, label: (seed, "đau ngực", label, vocab.SYMPTOM if label else None, [], "đau ngực từ sáng" if label else "thấy đau ngực thêm", "vì", None)
    rows = [("d1", MARKED, "case", "note", ["DIỄN BIẾN"], [mention("core:01", True), mention("repeat:01", False)]), ("d2", MARKED, "case", "note", [], [])]
    drafts = spark.createDataFrame(rows, f"draft_id string, marked_text string, source_case_id string, document_format string, section_path array<string>, mentions array<{vocab.MENTION}>")
    got = {r.draft_id: r for r in contract.validate_drafts(drafts, reqs).collect()}
    assert got["d1"].status == "valid", (got["d1"].errors, got["d1"].quality_flags)
    assert got["d2"].status == "rejected" and "no_request" in got["d2"].errors
    bad = drafts.filter("draft_id = 'd1'").withColumn("marked_text", F.concat("marked_text", F.lit(" Uống 5 mg. thuật ngữ này")))
    r = contract.validate_drafts(bad, reqs).first()
    assert {"unplanned_measurement", "meta_text"} <= set(r.errors)
    with pytest.raises(ValueError):
        jobs.draft_export(contract.validate_drafts(bad, reqs))


def test_plans(spark):
    catalog = spark.createDataFrame([(f"từ {i} dài", vocab.TYPES[i % 5], False) for i in range(60)], "text string, type string, flagged boolean")
    reqs = jobs.draft_requests(spark, 8, 2, catalog)
    again = jobs.draft_requests(spark, 8, 2, catalog).select("request_id", "plan")
    assert contract.same_requests(reqs.select("request_id", F.to_json("plan").alias("p")), again.select("request_id", F.to_json("plan").alias("p")))
    for r in reqs.collect():
        labelled = [x for x in r.plan if x.should_label and x.occurrence_role == "primary"]
        assert len(labelled) <= r.brief.labeled[1] and all(x.type in r.type_mix for x in labelled)
        assert all(x.type is None and not x.assertions for x in r.plan if not x.should_label)
    with pytest.raises(ValueError):
        contract.requests(contract.coverage_cases(spark, 200), 40)


def test_covered_phrase(spark):
    df = spark.createDataFrame([("viêm phổi nặng", ["viêm phổi", "phổi nặng", "phổi"])], "t string, l array<string>")
    assert df.select(contract.covered_phrase(F.col("t"), F.col("l"))).first()[0] == "viêm phổi"


def test_splits(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    parts = {r.s: r.n for r in df.groupBy(split.hash_split(F.col("id"), 0.1, 0.2).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert 150 < parts["test"] < 250 and 330 < parts["val"] < 470
    with pytest.raises(ValueError):
        split.assert_disjoint(df, df.limit(3))
    draws = split.weighted_sample(df.withColumn("w", F.when(F.col("id") == "7", 1000.0).otherwise(1.0)), "w", 600, 1)
    assert draws.count() == 600 and 120 < draws.filter("id = '7'").count() < 280
    with pytest.raises(ValueError):
        split.union_sources({"a": df}, ["b"])
    order = df.limit(50).select(split.weighted_order(["a", "b"], [9.0, 1.0], F.col("id")).alias("o")).collect()
    assert sum(r.o[0] == "a" for r in order) > 35


def test_leakage(spark):
    target = spark.createDataFrame([("a", "x y z w"), ("b", "q"), ("c", "k l m n")], "id string, text string")
    donor = spark.createDataFrame([("x y z other",)], "text string")
    got = {r.id: (r.n_shingles, r.n_shared, r.share) for r in leakage.overlap(target, donor, 3).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (0, 0, 0.0), "c": (2, 0, 0.0)}


def test_sources_and_sinks(spark, tmp_path):
    notes, labels = tmp_path / "notes", tmp_path / "labels"
    notes.mkdir()
    labels.mkdir()
    body = {"1": "đau ngực nhiều", "2": "khỏe", "10": "x" * 120 + " ho"}
    for k, v in body.items():
        (notes / f"{k}.txt").write_text(v, encoding="utf-8")
    raw = {"1": [{"text": "đau ngực", "position": [0, 8], "type": vocab.SYMPTOM, "assertions": ["isNegated"]}], "10": [{"text": "ho", "position": [121, 123], "type": vocab.SYMPTOM}]}
    for k, v in raw.items():
        (labels / f"{k}.json").write_text(json.dumps(v, ensure_ascii=False), encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        for k, v in raw.items():
            z.writestr(f"out/{k}.json", json.dumps(v))
    assert [r.id for r in readers.by_stem(readers.read_notes(spark, str(notes))).collect()] == ["1", "2", "10"]
    got = {r.id: r for r in readers.read_labelled_dir(spark, str(notes), str(labels), "s").collect()}
    assert set(got) == {"s:1", "s:10"} and got["s:10"].text == "x" * 30 + " ho" and got["s:10"].entities[0].start == 31
    zipped = {r.id: r for r in readers.read_zipped(spark, str(notes), str(tmp_path / "l.zip"), "s").collect()}
    assert len(zipped["s:10"].text) == 123 and zipped["s:1"].entities[0].assertions == ["isNegated"]
    recs = readers.read_labelled_dir(spark, str(notes), str(labels), "s", clean=False)
    sinks.write_label_files(recs, str(tmp_path / "out"))
    back = spark.read.option("basePath", str(tmp_path / "out")).text(str(tmp_path / "out"))
    assert back.count() == 2 and json.loads(back.filter(F.col("stem") == "s:1").first().value)[0]["position"] == [0, 8]
    sinks.write_jsonl(recs, str(tmp_path / "r.jsonl"))
    assert readers.read_jsonl(spark, str(tmp_path / "r.jsonl"), vocab.RECORD).count() == 2
    assert readers.read_jsonl(spark, str(tmp_path / "no.jsonl"), vocab.RECORD).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{oops\n')
    with pytest.raises(Exception, match="bad.jsonl:3"):
        readers.read_jsonl_strict(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "d.json").write_text('{"k1": "accept", "k2": "reject"}')
    assert {(r.key, r.decision) for r in readers.read_decisions(spark, str(tmp_path / "d.json")).collect()} == {("k1", "accept"), ("k2", "reject")}
    (tmp_path / "b.txt").write_text(" Ho \n\nSốt\n", encoding="utf-8")
    assert sorted(r.surface for r in readers.read_block_list(spark, str(tmp_path / "b.txt")).collect()) == ["ho", "sốt"]
    split_rows = recs.withColumn("split", F.lit("train"))
    sinks.export_splits(split_rows, str(tmp_path / "e"))
    with pytest.raises(Exception):
        sinks.export_splits(split_rows, str(tmp_path / "e"))
    sinks.export_app(recs, str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app" / "metadata")).count() == 2
    assert "# Lint report" in sinks.markdown_report(jobs.lint(recs))


def test_journal_stream(spark, tmp_path):
    path, state, cp = (str(tmp_path / x) for x in ("j", "s", "c"))
    schema = "key string, seq long, v string"
    write = lambda rows: sinks.append_journal(spark.createDataFrame(rows, schema), path)
    write([("a", 1, "x"), ("b", 2, "y")])
    journal.follow(spark, path, schema, state, cp)
    write([("a", 3, "z")])
    journal.follow(spark, path, schema, state, cp)
    assert {(r.key, r.v) for r in journal.state_of(spark, state, schema).collect()} == {("a", "z"), ("b", "y")}
    assert {(r.key, r.v) for r in journal.replay(spark.read.schema(schema).json(path)).collect()} == {("a", "z"), ("b", "y")}


def test_external_stage(spark):
    rows = spark.createDataFrame([(str(i), "p" * i) for i in range(20)], "key string, payload string")

    def client(payloads):
        if any(len(p) == 13 for p in payloads):
            raise RuntimeError("down")
        return [p.upper() for p in payloads]

    got = {r.key: r for r in external.run_stage(rows.coalesce(1), client, batch=1).collect()}
    assert got["13"].reply is None and "down" in got["13"].error and got["13"].calls == 3 and got["2"].reply == "PP"
    cache = external.run_stage(rows.filter("key < '5'"))
    assert external.unanswered(rows, cache).count() == rows.filter("key >= '5'").count()
    assert external.with_cache(rows, cache).count() == 20


def test_asof_and_latest(spark):
    lines = spark.createDataFrame([("d", 0, "A"), ("d", 10, "B")], "id string, at int, value string")
    points = spark.createDataFrame([("d", 5), ("d", 10), ("e", 1)], "id string, at int")
    assert {(r.id, r.at, r.value) for r in postprocess.last_before(lines, points).collect()} == {("d", 5, "A"), ("d", 10, "B"), ("e", 1, None)}


def test_jobs(spark):
    t = "Bệnh nhân không đau bụng hôm nay."
    gold = records(spark, *[(t, [ent(t, "đau bụng", vocab.SYMPTOM, "isNegated")])] * 4).withColumn("id", F.concat("id", F.monotonically_increasing_id()))
    corpus = jobs.build_corpus({"gold": gold}, jobs.CorpusConfig(validation_documents=1))
    assert corpus.filter("split = 'val'").count() == 1
    rows = jobs.window_corpus(corpus)
    assert rows.count() >= 3 and jobs.split_report(rows).count() == 2
    scorer = external.pattern_scorer({"đau": f"B-{vocab.SYMPTOM}", "bụng": f"I-{vocab.SYMPTOM}"})
    spans = jobs.predict(gold.select("id", "text").limit(1), scorer).first().spans
    assert [s.text for s in spans] == ["đau bụng"]
    decisions = spark.createDataFrame([("a", "accept", 1)], "key string, decision string, seq long")
    assert jobs.decide(decisions, "a", None, 2).count() == 0
    with pytest.raises(ValueError):
        jobs.decide(decisions, "a", "maybe", 2)


def test_entry(spark, sf):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).count() > 0


def test_lexicon_guard_searches_the_whole_lexicon(spark, sf):
    import re

    from spanloom import queries as core

    terms = contract.guard_terms(core.catalog(spark, sf)).first()["terms"]
    assert len(terms) > 40
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text, taken = (r["text"] or "").lower(), []
        for term in terms:
            found = [m.span() for m in re.finditer(rf"(?<!\w){re.escape(term)}(?!\w)", text)]
            taken += [(s, e) for s, e in found if not any(s < y and x < e for x, y in taken)]
            if len(taken) >= 12:
                break
        want[r["doc_id"]] = min(12, len(taken))
    got = {r["doc_id"]: r["hits"] for r in core.QUERIES["lexicon_guard"](spark, sf).collect()}
    assert got == want


def test_one_bad_request_fails_alone(spark):
    rows = spark.createDataFrame([(str(i), "p" * i) for i in range(20)], "key string, payload string")

    def client(payloads):
        if any(len(p) == 13 for p in payloads):
            raise RuntimeError("down")
        return [p.upper() for p in payloads]

    got = {r.key: r for r in external.run_stage(rows.coalesce(1), client, batch=8).collect()}
    assert got["13"].reply is None and "down" in got["13"].error
    assert all(got[str(i)].reply == "P" * i and got[str(i)].error is None for i in range(20) if i != 13)
