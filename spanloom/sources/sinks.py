"""Writers; Spark's committer makes every one of them atomic per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import empty
from . import files


def write_jsonl(df: DataFrame, path: str, overwrite: bool = True, one_file: bool = False) -> None:
    """K1, K2: JSON lines; a failed job leaves the old data."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def append_journal(df: DataFrame, path: str) -> None:
    """K4: append rows; each batch is committed as a whole."""
    df.write.mode("append").json(path)


def app_entities(entities: Column) -> Column:
    """Entities as label files hold them."""
    one = lambda e: F.struct(e["text"].alias("text"), F.array(e["start"], e["end"]).alias("position"), e["type"].alias("type"), e["assertions"].alias("assertions"), F.coalesce(e["candidates"], empty("array<string>")).alias("candidates"))
    return F.transform(entities, one)


def write_label_files(records: DataFrame, path: str, stem: str = "id") -> None:
    """K3: one JSON array for each note, in a folder ``stem=<name>``; executors write in parallel."""
    order = F.array_sort(F.transform("entities", lambda e: F.struct(e["start"].alias("a"), e["end"].alias("b"), e.alias("e"))))
    rows = records.select(F.col(stem).alias("stem"), F.to_json(app_entities(F.transform(order, lambda x: x["e"]))).alias("value"))
    rows.write.mode("overwrite").partitionBy("stem").text(path)


def in_place(entities: Column) -> Column:
    """Entities as label files hold them, by start, end and type."""
    order = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("a"), e["end"].alias("b"), e["type"].alias("t"), e.alias("e"))))
    return app_entities(F.transform(order, lambda x: x["e"]))


def note_files(records: DataFrame, path: str, stem: str = "id", overwrite: bool = True) -> int:
    """S13's input: ``<stem>.txt`` for each note."""
    return files.write_named(records.select(F.concat(F.col(stem), F.lit(".txt")).alias("name"), F.col("text").alias("value")), path, overwrite)


def label_files(records: DataFrame, path: str, stem: str = "id", overwrite: bool = True) -> int:
    """K2, K3: ``<stem>.json`` for each note, each written whole under another name first."""
    return files.write_named(records.select(F.concat(F.col(stem), F.lit(".json")).alias("name"), F.to_json(in_place(F.col("entities"))).alias("value")), path, overwrite)


def corrected_tree(records: DataFrame, changed: DataFrame, decisions: DataFrame, path: str) -> dict:
    """K5: ``<source>/notes/<id>.txt`` and ``<source>/labels/<id>.json`` of the changed sources, and ``manifest.json``.

    Entities keep their order. The originals are not touched. Returns the manifest.
    """
    import json

    own = records.join(changed.select("source"), "source", "left_semi")
    label = F.to_json(app_entities(F.col("entities")))
    named = own.select("source", F.explode(F.array(F.struct(F.concat_ws("/", "source", F.lit("notes"), F.concat("id", F.lit(".txt"))).alias("name"), F.col("text").alias("value")), F.struct(F.concat_ws("/", "source", F.lit("labels"), F.concat("id", F.lit(".json"))).alias("name"), label.alias("value")))).alias("f"))
    files.write_named(named.select("f.*"), path)
    written = {r["source"]: r["n"] for r in own.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source").toLocalIterator()}
    counts = {r["decision"]: r["n"] for r in decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).collect()}
    manifest = {"stage": "label_audit_applied", "accepted": counts.get("accept", 0), "rejected": counts.get("reject", 0), "files_written": written}
    files.put(f"{path}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2).encode())
    return manifest


def write_corrected(records: DataFrame, changed: DataFrame, path: str) -> None:
    """K5: notes and labels of changed sources only, by source; the originals are not touched."""
    own = records.join(changed, "source", "left_semi")
    own.select("source", "id", "text").write.mode("overwrite").partitionBy("source").json(f"{path}/notes")
    own.select("source", "id", app_entities(F.col("entities")).alias("entities")).write.mode("overwrite").partitionBy("source").json(f"{path}/labels")


def write_occurrence_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """K6: seven columns; commas in values become spaces. ``one_file`` is for reports of a size that one task can write."""
    clean = lambda c: F.translate(c, ",", " ").alias(c)
    out = rows.select(clean("file"), clean("surface"), clean("type"), "occurrence_count", "selected_count", "omitted_count", "covered_count")
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).csv(path)


def markdown_report(flags: DataFrame, show: int = 25) -> str:
    """K7: the lint report; only counts and ``show`` examples of each flag reach the driver."""
    from ..operators.stats import lint_summary

    lines, last = ["# Lint report"], None
    for r in sorted(lint_summary(flags, show).collect(), key=lambda r: (r["grp"], r["tag"], r["rank"])):
        if (r["grp"], r["tag"]) != last:
            last = (r["grp"], r["tag"])
            lines += ["", f"## {r['grp']} / {r['tag']}: {r['n']}", ""]
        lines.append(f"- {r['file']} [{r['start']}, {r['end']}) {r['detail']}")
    return "\n".join(lines) + "\n"


def write_manifest(facts: DataFrame, path: str) -> None:
    """One row of facts as one JSON document."""
    facts.limit(1).coalesce(1).write.mode("overwrite").json(path)


def write_stages(stages: list[tuple[str, DataFrame]], path: str) -> None:
    """K9: every intermediate result in a folder of its own."""
    for name, df in stages:
        df.write.mode("overwrite").json(f"{path}/{name}")


def export_splits(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """Records by split, and ``_manifest`` with their counts; an existing export is an error unless it may be replaced."""
    mode = "overwrite" if overwrite else "errorifexists"
    records.write.mode(mode).partitionBy("split").json(path)
    # a name with an underscore is no data to readers of the export
    records.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode(mode).json(f"{path}/_manifest")


def export_review(drafts: DataFrame, path: str) -> None:
    """A review packet; never replaces one."""
    from ..operators.contract import review_packet

    review_packet(drafts).write.mode("errorifexists").json(path)


def export_app(records: DataFrame, path: str, reviewed: DataFrame | None = None) -> None:
    """Notes, sorted labels and metadata with a digest under padded numbers; refuses reviewed sets."""
    from ..operators.audit import numbered

    if reviewed is not None and reviewed.limit(1).count():
        raise ValueError("already reviewed")
    rows = numbered(records, "id")
    label = F.to_json(in_place(F.col("entities")))
    if files.exists(f"{path}/notes"):
        raise FileExistsError(path)
    note_files(rows, f"{path}/notes", "doc", False)
    label_files(rows, f"{path}/labels", "doc", False)
    facts = rows.select(F.col("doc").alias("file_id"), "id", F.size("entities").alias("initial_label_count"), F.sha2("text", 256).alias("note_sha256"), F.sha2(label, 256).alias("initial_labels_sha256"))
    facts.write.mode("errorifexists").json(f"{path}/metadata")
    whole = facts.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("initial_label_count"), F.lit(0)).alias("initial_entities"), F.lit(0).alias("reviewed_files"))
    files.put(f"{path}/manifest.json", whole.select(F.to_json(F.struct("*"))).first()[0].encode())
    files.put(f"{path}/_reviewed.json", b"[]")
