"""Readers: notes, label files, archives, JSON lines and small lists, all with explicit schemas."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..functions.core import empty
from ..functions.spans import clean_entities
from ..functions.text import RUN_KEPT, collapse_plan, collapse_shift, collapse_text, strip

#: A label file's entity, as written: position is [start, end].
RAW_ENTITY = "struct<text:string,position:array<int>,type:string,assertions:array<string>,candidates:array<string>>"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a path; only its analysis runs."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def entities_of(raw: Column) -> Column:
    """Entities of the engine from those of a label file."""
    one = lambda e: vocab.entity(e["text"], e["position"][0], e["position"][1], e["type"], F.coalesce(e["assertions"], empty("array<string>")), F.coalesce(e["candidates"], empty("array<string>")))
    return F.transform(raw, one)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """One note for each text file: id, stem, text; order them with ``by_stem``."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select(F.url_decode(stem(F.col("path"))).alias("id"), F.url_decode(stem(F.col("path"))).alias("stem"), F.col("value").alias("text"))


def by_stem(df: DataFrame, column: str = "stem", numeric: bool = True) -> DataFrame:
    """Numbers by value first, then names; else by length and name."""
    if numeric:
        return df.orderBy(F.expr(f"try_cast({column} as int)").asc_nulls_last(), column)
    return df.orderBy(F.length(column), column)


def read_label_dir(spark: SparkSession, path: str) -> DataFrame:
    """Stem and entities of every ``<stem>.json`` with a list of entities (or an object with entities)."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    listed = F.from_json("value", f"array<{RAW_ENTITY}>")
    held = F.from_json("value", f"struct<entities:array<{RAW_ENTITY}>,labels:array<{RAW_ENTITY}>>")
    raw = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(held["entities"], held["labels"]))
    return files.select(F.url_decode(stem(F.col("path"))).alias("stem"), entities_of(raw).alias("entities"))


def read_zip(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """Member name, stem and text of every member with the suffix, from any file system."""
    schema = "member string, stem string, text string"

    def members(frames):
        for frame in frames:
            rows = []
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.endswith(suffix) and not name.endswith("/"):
                            rows.append((name, name.rsplit("/", 1)[-1][: -len(suffix)], z.read(name).decode("utf-8")))
            yield pd.DataFrame(rows, columns=["member", "stem", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, schema)


def read_label_zip(spark: SparkSession, path: str) -> DataFrame:
    """Stem and entities of the archive's label files."""
    return read_zip(spark, path).select("stem", entities_of(F.from_json("text", f"array<{RAW_ENTITY}>")).alias("entities"))


def _record(notes: DataFrame, labels: DataFrame, source: str, kind: str) -> DataFrame:
    """Notes with labels; notes without are dropped."""
    rows = notes.join(labels, "stem")
    return rows.select(
        F.concat_ws(":", F.lit(source), "stem").alias("id"), "text", "entities", F.lit(kind).alias("record_kind"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("genre"), F.lit(None).cast("string").alias("source_case_id")
    )


def read_labelled_dir(spark: SparkSession, notes: str, labels: str, source: str, clean: bool = True, mask: bool = False, kind: str = "gold_document") -> DataFrame:
    """Records of a notes folder and a labels folder; ``clean`` collapses long runs and cleans entities.

    With ``clean`` the reasons of dropped entities stand in ``reasons``.
    """
    rows = _record(read_notes(spark, notes), read_label_dir(spark, labels), source, kind)
    return cleaned(collapsed(rows), mask) if clean else rows


def read_zipped(spark: SparkSession, notes: str, labels_zip: str, source: str, kind: str = "gold_document", collapse: bool = False) -> DataFrame:
    """S3: notes with labels from an archive; long runs stay unless ``collapse``."""
    rows = _record(read_notes(spark, notes), read_label_zip(spark, labels_zip), source, kind)
    return cleaned(collapsed(rows) if collapse else rows)


def collapsed(records: DataFrame) -> DataFrame:
    """Long runs that touch no entity are cut and offsets move along."""
    rows = records.withColumn("runs__", collapse_plan(F.col("text"), F.col("entities")))
    moved = F.transform("entities", lambda e: e.withField("start", collapse_shift(F.col("runs__"), e["start"]).cast("int")).withField("end", collapse_shift(F.col("runs__"), e["end"]).cast("int")))
    rows = rows.withColumn("entities", moved).withColumn("text", collapse_text(F.col("text"), F.col("runs__")))
    return rows.drop("runs__")


def cleaned(records: DataFrame, mask: bool = False) -> DataFrame:
    """F1, F2, O1: records with clean entities and the reasons of what was dropped or repaired."""
    rows = records.withColumn("clean__", clean_entities(F.col("text"), F.col("entities"), mask))
    return rows.withColumn("entities", F.col("clean__.entities")).withColumn("reasons", F.col("clean__.reasons")).drop("clean__")


def drop_reasons(records: DataFrame) -> DataFrame:
    """How often each reason dropped or repaired an entity; an aggregation, exact under task retries."""
    return records.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, a missing path is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; the first bad line in each file is an error that names file and line."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    lines = lines.filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema))
    text = F.concat(F.lit("bad JSON at "), "path", F.lit(":"), F.col("line") + 1)
    # a malformed line has no field at all, while valid JSON has an object around it
    good = F.when(F.expr("json_object_keys(value)").isNotNull(), F.col("row")).otherwise(F.raise_error(text).cast(parsed.schema["row"].dataType))
    return parsed.select(good.alias("row")).select("row.*")


def read_drafts(spark: SparkSession, path: str, mask: bool = False) -> DataFrame:
    """Records of drafts; only mentions that should be labelled become entities."""
    rows = read_jsonl(spark, path, vocab.DRAFT)
    labelled = F.filter(F.coalesce("mentions", empty(f"array<{vocab.MENTION}>")), lambda m: F.coalesce(m["should_label"], F.lit(False)))
    one = lambda m: vocab.entity(m["text"], m["position"][0], m["position"][1], m["type"], F.coalesce(m["assertions"], empty("array<string>")))
    kind = F.when(F.col("track") == "section", "segment").otherwise("document")
    records = rows.select(
        F.concat_ws(":", F.lit("synthetic"), "draft_id").alias("id"), "text", F.transform(labelled, one).alias("entities"), kind.alias("record_kind"), F.lit("synthetic").alias("source"), F.col("document_format").alias("genre"), "source_case_id"
    )
    return cleaned(records, mask)


def read_evidence(spark: SparkSession, path: str, schema: str = "id string, text string", most: int = 10, chars: int = 20_000) -> DataFrame:
    """One to ten examples from JSON (a list or an object with examples) or JSON lines, of bounded size."""
    whole = "".join(r["value"] + "\n" for r in spark.read.text(path).limit(100_000).collect())
    if len(whole) > 4 * chars:
        raise ValueError(f"{path}: more than {chars} characters")
    try:
        data = json.loads(whole)
        rows = data["examples"] if isinstance(data, dict) and "examples" in data else data if isinstance(data, list) else [data]
    except json.JSONDecodeError:
        rows = [json.loads(x) for x in whole.splitlines() if x.strip()]
    if not 1 <= len(rows) <= most or sum(len(json.dumps(r, ensure_ascii=False)) for r in rows) > chars:
        raise ValueError(f"{path}: 1 to {most} examples of at most {chars} characters are wanted")
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_lint_jsonl(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Records of a corpus split with ids ``name:id``; None if the rows are windows without text."""
    found = spark.read.json(path)
    if "text" not in found.columns:
        return None
    rows = spark.read.schema(vocab.RECORD).json(path)
    return rows.withColumn("id", F.concat_ws(":", F.lit(name), "id"))


def read_lint_labels(spark: SparkSession, notes: str, labels: str) -> DataFrame:
    """Notes with labels; files whose stem starts with an underscore are no labels."""
    own = read_label_dir(spark, labels).filter(~F.col("stem").startswith("_"))
    return _record(read_notes(spark, notes), own, "labels", "gold_document")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-empty lines of a list, stripped, in file order for one file."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), strip(F.col("value")).alias("value"))
    return rows.filter("value <> ''").orderBy("line").select("value")


def read_block_list(spark: SparkSession, path: str) -> DataFrame:
    """Surfaces to leave out, lower-cased."""
    return read_lines(spark, path).select(F.lower("value").alias("surface")).distinct()


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Key and decision rows of a JSON object."""
    if not _exists(spark, path):
        return spark.createDataFrame([], vocab.DECISION)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "decision"))


def read_occurrences(spark: SparkSession, jsonl: str | None = None, notes: str | None = None, labels_dir: str | None = None, labels_zip: str | None = None, drafts: str | None = None) -> DataFrame:
    """Records for the repeated-surface report from exactly one kind of input."""
    given = [x for x in (jsonl, labels_dir, labels_zip, drafts) if x]
    if len(given) != 1:
        raise ValueError("give exactly one of jsonl, labels_dir, labels_zip, drafts")
    if jsonl:
        return read_jsonl(spark, jsonl, vocab.RECORD)
    if drafts:
        return read_drafts(spark, drafts)
    labels = read_label_dir(spark, labels_dir) if labels_dir else read_label_zip(spark, labels_zip)
    return _record(read_notes(spark, notes), labels, "labels", "gold_document")


#: T14's kept length, for callers that check collapsed texts.
KEPT = RUN_KEPT
