"""Registered queries of readers, writers and whole jobs.

Each writes what it reads again, in a folder that all executors share, so that the
result has passed the format both ways; the SQL starts from the tables.
"""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oracles
from .functions import vocab
from .functions.core import empty
from .operators import audit, contract, stats
from .oracles import BEARING, GOLD_SQL, hashed, listed
from .plans import jobs
from .queries import faulty_records, query, read, records
from .queries_rules import NOTES_SQL, note_records
from .sources import files, readers, sinks

_ONE = "id, text, s AS \"start\", e AS \"end\", x AS surface, t AS \"type\", array_to_string(marks, ',') AS marks"


def named_notes(spark, sf_dir) -> DataFrame:
    """The notes with ids that are file names."""
    return note_records(spark, sf_dir).withColumn("id", F.translate("id", ":", "_"))


def first_entity(df: DataFrame) -> DataFrame:
    e = F.col("entities")[0]
    return df.select("id", "text", e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("surface"), e["type"].alias("type"), F.array_join(e["assertions"], ",").alias("marks"))


def zipped(rows: DataFrame, path: str) -> None:
    """An archive of (name, value) rows; made on the driver, as archives are small."""
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for r in rows.toLocalIterator():
            z.writestr(f"labels/{r['name']}", r["value"])
    files.put(path, body.getvalue())


@query(f"WITH {NOTES_SQL} SELECT {_ONE.replace('id,', chr(39) + 'n:' + chr(39) + ' || replace(id, ' + chr(39) + ':' + chr(39) + ', ' + chr(39) + '_' + chr(39) + ') AS id,', 1)} FROM notes")
def labelled_folder(spark, sf_dir):
    """Notes and label files written one by one and read as records, nothing cleaned."""
    at = files.scratch(spark)
    rows = named_notes(spark, sf_dir)
    sinks.note_files(rows, f"{at}/notes")
    sinks.label_files(rows, f"{at}/labels")
    return first_entity(readers.read_labelled_dir(spark, f"{at}/notes", f"{at}/labels", "n", clean=False))


_DROPS = f"""WITH {NOTES_SQL}, k AS (SELECT *, x <> substr(text, s + 1, e - s) AS off, len(marks) > len(list_filter(marks, lambda a: a IN ({listed(vocab.ASSERTIONS)}) AND t IN ({BEARING}))) AS mended FROM notes)
SELECT 'bad_offset' AS reason, count(*) AS n FROM k WHERE off UNION ALL SELECT 'assertion_repaired', count(*) FROM k WHERE mended AND NOT off"""


@query(_DROPS)
def cleaned_folder(spark, sf_dir):
    """The same folder with cleaning; why entities were dropped or repaired."""
    at = files.scratch(spark)
    rows = named_notes(spark, sf_dir)
    sinks.note_files(rows, f"{at}/notes")
    sinks.label_files(rows, f"{at}/labels")
    return readers.drop_reasons(readers.read_labelled_dir(spark, f"{at}/notes", f"{at}/labels", "n"))


@query(f"WITH {NOTES_SQL} SELECT 'z:' || replace(id, ':', '_') AS id, length(text)::INT AS chars, (x = substr(text, s + 1, e - s))::INT AS entities FROM notes")
def zipped_labels(spark, sf_dir):
    """Notes of a folder with the labels of an archive."""
    at = files.scratch(spark)
    rows = named_notes(spark, sf_dir)
    sinks.note_files(rows, f"{at}/notes")
    zipped(rows.select(F.concat("id", F.lit(".json")).alias("name"), F.to_json(sinks.in_place(F.col("entities"))).alias("value")), f"{at}/labels.zip")
    found = readers.read_zipped(spark, f"{at}/notes", f"{at}/labels.zip", "z")
    return found.select("id", F.length("text").alias("chars"), F.size("entities").alias("entities"))


@query("SELECT doc_id, length(text)::INT AS n, lang, source FROM documents")
def jsonl_documents(spark, sf_dir):
    """Documents as JSON lines and back; a path that is not there reads as empty."""
    at = files.scratch(spark)
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    sinks.write_jsonl(rows, f"{at}/train.jsonl")
    found = readers.read_jsonl(spark, f"{at}/train.jsonl", rows.schema).unionByName(readers.read_jsonl(spark, f"{at}/none.jsonl", rows.schema))
    return found.select("doc_id", F.length("text").alias("n"), "lang", "source")


@query("SELECT n_nationkey::INT AS id, n_name AS name, NULL::INT AS bad_line FROM nation UNION ALL SELECT NULL, NULL, 3")
def strict_jsonl(spark, sf_dir):
    """JSON lines with blank lines between them; a bad line is an error that names its place."""
    at = files.scratch(spark)
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    lines = [r["v"] for r in rows.select(F.to_json(F.struct("id", "name")).alias("v")).collect()]
    files.put(f"{at}/good.jsonl", ("\n\n".join(lines) + "\n").encode())
    files.put(f"{at}/bad.jsonl", f"{lines[0]}\n\n{{oops\n".encode())
    try:
        readers.read_jsonl_strict(spark, f"{at}/bad.jsonl", "id int, name string").collect()
        place = None
    except Exception as e:  # noqa: BLE001  the error is what this query reports
        place = int(str(e).partition("bad.jsonl:")[2][:1])
    bad = spark.createDataFrame([(None, None, place)], "id int, name string, bad_line int")
    return readers.read_jsonl_strict(spark, f"{at}/good.jsonl", "id int, name string").withColumn("bad_line", F.lit(None).cast("int")).unionByName(bad)


@query("SELECT k AS kind, r_regionkey::VARCHAR AS id, r_name AS text FROM region, (SELECT unnest(['lines', 'list', 'object']) AS k)")
def evidence_examples(spark, sf_dir):
    """Examples from JSON lines, a list, and an object that holds them."""
    at = files.scratch(spark)
    rows = [{"id": str(r["r_regionkey"]), "text": r["r_name"]} for r in read(spark, sf_dir, "region").collect()]
    files.put(f"{at}/lines", "\n".join(map(json.dumps, rows)).encode())
    files.put(f"{at}/list", json.dumps(rows).encode())
    files.put(f"{at}/object", json.dumps({"examples": rows}).encode())
    found = [readers.read_evidence(spark, f"{at}/{k}").select(F.lit(k).alias("kind"), "id", "text") for k in ("lines", "list", "object")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"WITH {NOTES_SQL} SELECT 'train:' || id AS id, 1 AS entities FROM notes UNION ALL SELECT 'labels:' || replace(id, ':', '_'), 1 FROM notes")
def lint_inputs(spark, sf_dir):
    """Records of a corpus split and of a generated folder, whose files with a leading underscore are no labels."""
    at = files.scratch(spark)
    rows = named_notes(spark, sf_dir)
    sinks.write_jsonl(note_records(spark, sf_dir), f"{at}/train.jsonl")
    sinks.note_files(rows, f"{at}/notes")
    sinks.label_files(rows, f"{at}/labels")
    files.put(f"{at}/labels/_reviewed.json", b"[]")
    found = readers.read_lint_jsonl(spark, f"{at}/train.jsonl", "train").select("id", "entities")
    return found.unionByName(readers.read_lint_labels(spark, f"{at}/notes", f"{at}/labels").select("id", "entities")).select("id", F.size("entities").alias("entities"))


_MENTIONS = f"array<{vocab.MENTION}>"


def draft_rows(spark, sf_dir) -> DataFrame:
    """The notes as drafts: the labelled entity as a mention, and every third one unlabelled."""
    rows = note_records(spark, sf_dir).withColumn("e", F.col("entities")[0])
    e = F.col("e")
    label = F.substring_index("id", ":", 1).cast("int") % 3 != 0
    mention = F.struct(
        F.lit("core:01").alias("seed_id"), e["text"].alias("text"), label.alias("should_label"), F.when(label, e["type"]).alias("type"), F.when(label, e["assertions"]).otherwise(empty("array<string>")).alias("assertions"),
        F.lit("").alias("context_evidence"), F.lit("").alias("rationale"), F.array(e["start"], e["end"]).alias("position"),
    )
    return rows.select(
        F.col("id").alias("draft_id"), F.lit("").alias("marked_text"), F.concat(F.lit("case."), "id").alias("source_case_id"), F.when(F.substring_index("id", ":", -1).cast("int") % 2 == 0, "section").otherwise("document").alias("track"),
        F.lit("note").alias("document_format"), empty("array<string>").alias("section_path"), "text", F.array(mention).cast(_MENTIONS).alias("mentions"), empty("array<string>").alias("quality_flags"), F.lit("valid").alias("status"),
    )


_DRAFTS = f"{NOTES_SQL}, d AS (SELECT *, string_split(id, ':')[1]::INT % 3 <> 0 AS label FROM notes)"


@query(
    f"WITH {_DRAFTS} SELECT 'synthetic:' || id AS id, CASE WHEN j % 2 = 0 THEN 'segment' ELSE 'document' END AS record_kind, (label AND x = substr(text, s + 1, e - s))::INT AS entities FROM d"
)
def draft_records(spark, sf_dir):
    """Records of drafts; only mentions that should be labelled become entities."""
    at = files.scratch(spark)
    sinks.write_jsonl(draft_rows(spark, sf_dir), f"{at}/drafts.jsonl")
    return readers.read_drafts(spark, f"{at}/drafts.jsonl").select("id", "record_kind", F.size("entities").alias("entities"))


@query(
    f"""WITH {_DRAFTS} SELECT kind, count(*) AS records, sum(n)::BIGINT AS entities FROM (
  SELECT unnest(['jsonl', 'labels', 'zip']) AS kind, 1 AS n FROM d UNION ALL SELECT 'drafts', (label AND x = substr(text, s + 1, e - s))::INT FROM d) GROUP BY kind"""
)
def occurrence_inputs(spark, sf_dir):
    """The inputs of the repeated-surface report: JSON lines, a folder, an archive, drafts."""
    at = files.scratch(spark)
    rows = named_notes(spark, sf_dir)
    sinks.write_jsonl(rows, f"{at}/train.jsonl")
    sinks.note_files(rows, f"{at}/notes")
    sinks.label_files(rows, f"{at}/labels")
    sinks.write_jsonl(draft_rows(spark, sf_dir), f"{at}/drafts.jsonl")
    zipped(rows.select(F.concat("id", F.lit(".json")).alias("name"), F.to_json(sinks.in_place(F.col("entities"))).alias("value")), f"{at}/labels.zip")
    kinds = {"jsonl": {"jsonl": f"{at}/train.jsonl"}, "labels": {"notes": f"{at}/notes", "labels_dir": f"{at}/labels"}, "zip": {"notes": f"{at}/notes", "labels_zip": f"{at}/labels.zip"}, "drafts": {"drafts": f"{at}/drafts.jsonl"}}
    out = None
    for kind, given in kinds.items():
        one = readers.read_occurrences(spark, **given).agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("entities")).alias("entities")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'labels' AS list, lower(trim(n_name)) AS surface FROM nation UNION SELECT 'types', lower(r_name) FROM region")
def vocab_files(spark, sf_dir):
    """Word lists from files with blank lines and blanks."""
    at = files.scratch(spark)
    names = [r["n_name"] for r in read(spark, sf_dir, "nation").collect()]
    files.put(f"{at}/labels.txt", "\n\n".join(f"  {x} " for x in names).encode())
    files.put(f"{at}/types.txt", "\n".join(r["r_name"] for r in read(spark, sf_dir, "region").collect()).encode())
    one = readers.read_block_list(spark, f"{at}/labels.txt").select(F.lit("labels").alias("list"), "surface")
    return one.unionByName(readers.read_lines(spark, f"{at}/types.txt").select(F.lit("types").alias("list"), F.lower("value").alias("surface")))


@query("SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'accept' ELSE 'reject' END AS decision FROM nation")
def decision_file(spark, sf_dir):
    """Decisions from a JSON object; a file that is not there holds none."""
    at = files.scratch(spark)
    held = {r["n_name"]: "accept" if r["n_nationkey"] % 2 == 0 else "reject" for r in read(spark, sf_dir, "nation").collect()}
    files.put(f"{at}/decisions.json", json.dumps(held).encode())
    return readers.read_decisions(spark, f"{at}/decisions.json").unionByName(readers.read_decisions(spark, f"{at}/none.json"))


@query("SELECT user_id, max(event_id) AS event_id, count(*) AS appended FROM events GROUP BY user_id")
def journal_file(spark, sf_dir):
    """Events appended in two batches; the last of each user stands."""
    from .streaming import journal

    at = files.scratch(spark)
    rows = read(spark, sf_dir, "events").select("user_id", "event_id")
    for rest in (0, 1):
        sinks.append_journal(rows.filter(F.col("event_id") % 2 == rest), f"{at}/journal")
    back = spark.read.schema(rows.schema).json(f"{at}/journal")
    last = journal.replay(back, "user_id", "event_id").select("user_id", "event_id")
    return last.join(back.groupBy("user_id").agg(F.count(F.lit(1)).alias("appended")), "user_id")


@query(
    f"""WITH {NOTES_SQL}, c AS (SELECT * FROM notes WHERE x = substr(text, s + 1, e - s)),
p AS (SELECT 'notes/notes/' || replace(id, ':', '_') || '.txt' AS path, length(text)::INT AS n FROM notes
  UNION ALL SELECT 'notes/labels/' || replace(id, ':', '_') || '.json', CASE WHEN j % 2 = 0 AND x = substr(text, s + 1, e - s) THEN 0 ELSE 1 END FROM notes)
SELECT path, n FROM p UNION ALL SELECT 'accepted', (SELECT count(*) FROM c WHERE j % 2 = 0)::INT UNION ALL SELECT 'rejected', (SELECT count(*) FROM c WHERE j % 2 = 1)::INT UNION ALL SELECT 'files_written', (SELECT count(*) FROM notes)::INT"""
)
def corrected_files(spark, sf_dir):
    """The corrected copy as notes, labels and a manifest; entities of half of the sentences are deleted."""
    at = files.scratch(spark)
    recs = named_notes(spark, sf_dir)
    found = audit.delete_candidates(recs)
    even = F.regexp_extract("file", "_([0-9]+)$", 1).cast("int") % 2 == 0
    decisions = found.select("key", F.when(even, "accept").otherwise("reject").alias("decision"))
    done = audit.apply_decisions(recs, found, decisions)
    manifest = sinks.corrected_tree(done, audit.changed_sources(recs, found, decisions), decisions, at)
    path = F.regexp_extract(F.input_file_name(), r"(notes/(?:notes|labels)/[^/]+)$", 1)
    notes = spark.read.text(f"{at}/notes/notes", wholetext=True).select(path.alias("path"), F.length("value").alias("n"))
    labels = spark.read.text(f"{at}/notes/labels", wholetext=True).select(path.alias("path"), F.size(F.from_json("value", f"array<{readers.RAW_ENTITY}>")).alias("n"))
    facts = [(k, int(manifest[k])) for k in ("accepted", "rejected")] + [("files_written", sum(manifest["files_written"].values()))]
    return notes.unionByName(labels).unionByName(spark.createDataFrame(facts, "path string, n int"))


@query(oracles.OCCURRENCES.replace("SELECT * FROM report", "SELECT file::INT AS file, trim(replace(surface, ',', ' ')) AS surface, \"type\", occurrence_count, selected_count, omitted_count, covered_count FROM report WHERE regexp_matches(trim(replace(surface, ',', ' ')), '^[\\p{L}]+$')"))
def occurrence_csv(spark, sf_dir):
    """The seven columns of the report as CSV and back, for surfaces of letters."""
    at = files.scratch(spark)
    sinks.write_occurrence_csv(stats.occurrence_rows(records(spark, sf_dir)), f"{at}/rows")
    found = spark.read.option("header", True).option("multiLine", True).schema("file int, surface string, type string, occurrence_count int, selected_count int, omitted_count int, covered_count int").csv(f"{at}/rows")
    return found.filter(F.col("surface").rlike(r"\A\p{L}+\z"))


@query(f"SELECT '## ' || grp || ' / ' || tag || ': ' || n AS line, least(n, 25)::INT AS examples FROM ({oracles.LINT})")
def lint_markdown(spark, sf_dir):
    """K7, L3, E-g: headings of the lint report and the number of their examples."""
    out: dict[str, int] = {}
    last = ""
    for line in sinks.markdown_report(jobs.lint(faulty_records(spark, sf_dir))).split("\n"):
        if line.startswith("## "):
            last = line
            out[last] = 0
        elif line.startswith("- ") and last:
            out[last] += 1
    return spark.createDataFrame(list(out.items()), "line string, examples int")


@query("SELECT 'documents' AS stage, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents")
def manifest_file(spark, sf_dir):
    """K8: one row of facts as a JSON document."""
    at = files.scratch(spark)
    facts = read(spark, sf_dir, "documents").agg(F.lit("documents").alias("stage"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
    sinks.write_manifest(facts, f"{at}/manifest")
    return spark.read.schema(facts.schema).json(f"{at}/manifest")


@query(oracles.BASELINE)
def stage_files(spark, sf_dir):
    """K9, E-n: every stage of baseline spans written to a folder of its own, and what each holds."""
    at = files.scratch(spark)
    names = list(vocab.LABEL_MAP) + ["ORGAN"]
    from .queries import with_spans

    relabel = F.transform("spans", lambda s: F.struct(s["start"], s["end"], F.get(F.array(*map(F.lit, names)), (s["i"] % 5)).alias("type")))
    stages = jobs.baseline_labels(with_spans(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", relabel.alias("spans")))
    sinks.write_stages(stages, at)
    out = None
    for name, _ in stages:
        one = spark.read.text(f"{at}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_SPLIT = f"CASE WHEN {hashed('id')} / 4294967295.0 < 0.05 THEN 'test' WHEN {hashed('id')} / 4294967295.0 < 0.1 THEN 'val' ELSE 'train' END"


@query(f"WITH {NOTES_SQL}, z AS (SELECT {_SPLIT} AS split FROM notes) SELECT split, count(*) AS n, count(*) AS listed, true AS refused FROM z GROUP BY split")
def split_export(spark, sf_dir):
    """K10, R4, E-i: drafts exported by split with a manifest; a second export over it is refused."""
    at = files.scratch(spark)
    rows = jobs.draft_export(draft_rows(spark, sf_dir))
    sinks.export_splits(rows, f"{at}/export")
    try:
        sinks.export_splits(rows, f"{at}/export")
        refused = False
    except Exception:  # noqa: BLE001  the refusal is what this query reports
        refused = True
    back = spark.read.json(f"{at}/export").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    listed_ = spark.read.json(f"{at}/export/_manifest").select("split", F.col("rows").alias("listed"))
    return back.join(listed_, "split").withColumn("refused", F.lit(refused))


@query(f"WITH {_DRAFTS} SELECT id AS draft_id, 1 AS mentions, true AS blank FROM d")
def review_file(spark, sf_dir):
    """The review packet, whose mentions carry blank fields."""
    at = files.scratch(spark)
    sinks.export_review(draft_rows(spark, sf_dir), f"{at}/packet")
    kind = f"draft_id string, mentions array<{vocab.MENTION[:-1]},review_verdict:string,review_note:string>>, reviewer string"
    found = spark.read.schema(kind).json(f"{at}/packet")
    blank = F.forall("mentions", lambda m: m["review_verdict"].isNull() & m["review_note"].isNull()) & F.col("reviewer").isNull()
    return found.select("draft_id", F.size("mentions").alias("mentions"), blank.alias("blank"))


@query(
    f"""WITH {GOLD_SQL}, n AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY doc_id), r AS (SELECT d.doc_id::VARCHAR AS id, text, coalesce(n, 0)::INT AS n, row_number() OVER (ORDER BY d.doc_id::VARCHAR) AS k FROM documents d LEFT JOIN n USING (doc_id))
SELECT CASE WHEN length(k::VARCHAR) < 3 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS file_id, id, sha256(text) AS sha, n AS labels, true AS in_order FROM r"""
)
def app_export(spark, sf_dir):
    """Notes and sorted labels under padded numbers, with metadata and digests."""
    at = files.scratch(spark)
    sinks.export_app(records(spark, sf_dir), f"{at}/app")
    return exported_app(spark, f"{at}/app")


def exported_app(spark, at: str) -> DataFrame:
    """What an app export holds, by the names in its metadata: every row has its two files. A text that was null has no digest."""
    facts = spark.read.schema("file_id string, id string, note_sha256 string").json(f"{at}/metadata")
    named = facts.withColumns({"note": F.concat("file_id", F.lit(".txt")), "label": F.concat("file_id", F.lit(".json"))})
    notes = files.read_named(named, f"{at}/notes", "note", "text").select("file_id", "id", "label", F.when(F.col("note_sha256").isNotNull(), F.sha2("text", 256)).alias("sha"))
    found = files.read_named(notes, f"{at}/labels", "label", "labels").withColumn("l", F.from_json("labels", f"array<{readers.RAW_ENTITY}>"))
    places = F.transform("l", lambda e: F.struct(e["position"][0], e["position"][1], e["type"]))
    return found.select("file_id", "id", "sha", F.size("l").alias("labels"), (F.array_sort(places) == places).alias("in_order"))


# --- jobs


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source = 'src0' ORDER BY sha256('20260730:' || doc_id), doc_id::VARCHAR) AS k FROM documents WHERE source IN ('src0', 'src1')) SELECT d.doc_id::VARCHAR AS id, CASE WHEN (r.source = 'src0' AND k <= 15) OR (r.source = 'src1' AND k <= 200) THEN 'val' ELSE 'train' END AS split FROM documents d LEFT JOIN r USING (doc_id)")
def corpus_splits(spark, sf_dir):
    """E-a, R2, L5, J16: all sources joined; gold documents and synthetic records are held out by hash."""
    rows = records(spark, sf_dir)
    gold = rows.filter("source = 'src0'").withColumn("record_kind", F.lit("gold_document"))
    synthetic = rows.filter("source = 'src1'").withColumn("source", F.lit("synthetic"))
    rest = rows.filter("source NOT IN ('src0', 'src1')")
    return jobs.build_corpus({"gold": gold, "synthetic": synthetic, "rest": rest}).select("id", "split")


@query(f"WITH {NOTES_SQL}, n AS (SELECT id, {hashed(chr(39) + '42' + chr(39), 'id')} / 4294967295.0 AS u FROM notes), z AS (SELECT id, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'val' ELSE 'train' END AS split FROM n) SELECT split, count(*) AS notes FROM z GROUP BY split")
def v1_splits(spark, sf_dir):
    """E-c, R3: line-packed rows split by note; here the notes of each split."""
    rows = jobs.build_v1(note_records(spark, sf_dir))
    return rows.groupBy("split").agg(F.count_distinct("id").alias("notes"))


@query(f"WITH RECURSIVE {oracles.OCCURRENCES.removeprefix('WITH ').replace('SELECT * FROM report', '')} SELECT file, count(*) AS surfaces, sum(occurrence_count)::BIGINT AS occurrences FROM report JOIN documents d ON d.doc_id::VARCHAR = file WHERE d.source = 'src0' GROUP BY file")
def occurrence_of_source(spark, sf_dir):
    """E-j, F8: the repeated-surface report of one source."""
    rows = jobs.occurrence_report(records(spark, sf_dir), "src0")["rows"]
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("surfaces"), F.sum("occurrence_count").alias("occurrences"))


_SIEVE = "lower(regexp_replace(x, '^[" + oracles.WS + "]+|[" + oracles.WS + "]+$', '', 'g')) NOT IN ('the', 'of')"
_SIEVED = (
    oracles.SCORES.replace("FROM spans p JOIN documents d USING (doc_id))", "FROM spans p JOIN documents d USING (doc_id) WHERE " + _SIEVE.replace("(x,", "(substr(d.text, p.\"start\" + 1, p.\"end\" - p.\"start\"),") + ")", 1)
    .replace("FROM fresh p JOIN documents d USING (doc_id))", "FROM fresh p JOIN documents d USING (doc_id) WHERE " + _SIEVE.replace("(x,", "(substr(d.text, p.\"start\" + 1, p.\"end\" - p.\"start\"),") + ")", 1)
)


@query(_SIEVED)
def sieved_scores(spark, sf_dir):
    """E-e, F7, A5, A6: the score table after block-listed surfaces have left both sides."""
    from .queries import predicted_files, span_files

    blocked = spark.createDataFrame([("the",), ("Of ",)], "surface string")
    return jobs.score(span_files(spark, sf_dir, "g"), predicted_files(spark, sf_dir), blocked)


@query(f"WITH {_DRAFTS}, m AS (SELECT label, j FROM d) SELECT CASE WHEN j % 4 = 0 THEN 'repeat_omitted' WHEN j % 4 = 1 THEN 'covered_by_longer' ELSE 'intentional_o' END AS role, count(*) AS n FROM m WHERE NOT label GROUP BY 1")
def declared_roles(spark, sf_dir):
    """Roles that plans declare for unlabelled mentions."""
    rows = draft_rows(spark, sf_dir).select(F.col("draft_id"), F.explode("mentions").alias("m"))
    j = F.substring_index("draft_id", ":", -1).cast("int")
    mentions = rows.select(F.col("draft_id").alias("seed_id"), F.col("m.should_label").alias("should_label"))
    plan = rows.select(F.col("draft_id").alias("seed_id"), F.when(j % 4 == 0, "repeat_omitted").when(j % 4 == 1, "covered_by_longer").alias("occurrence_role"))
    return stats.declared_roles(mentions, plan)


@query(
    f"""WITH {_DRAFTS}, w AS (SELECT count(*) AS n, sum(length(text)) AS chars, count(*) FILTER (WHERE label) AS lab FROM d)
SELECT 'total' AS what, k AS key, n, CASE k WHEN 'chars' THEN chars WHEN 'labelled' THEN lab WHEN 'unlabelled' THEN n - lab ELSE 1000::DOUBLE * lab / chars END::DOUBLE AS value FROM w, (SELECT unnest(['chars', 'labelled', 'unlabelled', 'per_1k']) AS k)
UNION ALL SELECT 'type', t, count(*), NULL FROM d WHERE label GROUP BY t UNION ALL SELECT 'format', 'note', n, NULL FROM w UNION ALL SELECT 'status', 'valid', n, NULL FROM w"""
)
def draft_distribution(spark, sf_dir):
    """Size, labels, density, types, formats and status of drafts."""
    return contract.draft_distribution(draft_rows(spark, sf_dir))


@query(f"WITH {NOTES_SQL} SELECT replace(id, ':', '_') || '#0' AS key, '{{\"verdict\": \"keep\"' AS reply FROM notes WHERE x = substr(text, s + 1, e - s)")
def adjudicated(spark, sf_dir):
    """E-k, X2, V9: replies of the offline judge to all deletion candidates, a third of them from a cache."""
    from .streaming import external

    found = jobs.audit_screen(named_notes(spark, sf_dir), "delete")
    cache = external.run_stage(audit.payload(found.filter("entity_index = 0 AND file LIKE '1%'")))
    got = jobs.audit_adjudicate(found, cache)
    return got.select("key", F.substring_index("reply", ",", 1).alias("reply"))


@query(f"WITH {NOTES_SQL} SELECT replace(id, ':', '_') || '#0' AS key, CASE WHEN t <> '{vocab.SYMPTOM}' OR len(marks) > 0 THEN 'reject' ELSE 'accept' END AS decision FROM notes WHERE x = substr(text, s + 1, e - s)")
def decided(spark, sf_dir):
    """E-l, J7, V8, A11: automatic decisions over fixes and deletions; here a deletion of every right entity."""
    recs = named_notes(spark, sf_dir)
    fix = audit.screen_all(recs).filter("kind <> 'offset_mismatch'")
    return jobs.audit_decide(fix, audit.delete_candidates(recs)).select("key", "decision")
