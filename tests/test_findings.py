"""Findings of round 2: spans longer than the windows' overlap, numbering, steps made once."""

import time
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from spanloom import queries
from spanloom.functions import spans as S
from spanloom.functions import vocab
from spanloom.operators import audit, contract, match, postprocess, stats, windows
from spanloom.plans import jobs
from spanloom.sources import sinks
from spanloom.streaming import external


def test_numbers_stay_when_rows_are_read_again(spark):
    # more rows in a partition than Spark's sample for range bounds holds
    rows = spark.range(60000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
    got = audit.numbered(rows, "id")
    for _ in range(2):
        assert got.agg(F.count_distinct("doc"), F.max(F.col("doc").cast("int"))).first()[:] == (60000, 60000)
    both = got.select("id", "doc").join(got.select("id", F.col("doc").alias("again")), "id")
    assert both.filter("doc <> again").count() == 0


def test_numbered_sorts_once(spark):
    plan = audit.numbered(spark.range(10).select(F.col("id").cast("string").alias("id")), "id")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_span_longer_than_the_overlap_is_one(spark):
    text = " ".join(["x"] * 100 + ["the"] + ["of"] * 400 + ["x", "and", "the", "of"])
    notes = spark.createDataFrame([("a", text), ("b", "the of and"), ("c", None)], "id string, text string")
    scorer = external.pattern_scorer({"the": f"B-{vocab.SYMPTOM}", "of": f"I-{vocab.SYMPTOM}", "and": f"B-{vocab.DRUG}"})
    got = {r.id: [(text[x.start : x.end], x.type) for x in r.spans] for r in jobs.predict(notes, scorer, header=False).collect()}
    assert [(len(t.split()), k) for t, k in got["a"]] == [(401, vocab.SYMPTOM), (1, vocab.DRUG), (2, vocab.SYMPTOM)]
    assert len(got["b"]) == 2 and got["c"] == []


def test_flags_and_scores_read_their_input_once(spark, sf):
    """the plans draw the derived spans of a document no more than once."""
    read = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert read(stats.lint(queries.faulty_records(spark, sf))) == 1
    assert read(windows.training_rows(queries.records(spark, sf))) == 1
    plan = queries.QUERIES["label_validation"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") <= 2


def test_baseline_stages_hold_no_whole_text(spark):
    text = "ab cd    ef\ngh, ij"
    rows = [(1, text, [(0, 2, "DRUGCHEMICAL"), (3, 5, "UNITCALIBRATOR"), (9, 11, "X"), (12, 15, "X"), (16, 18, "X")])]
    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,end:int,type:string>>")
    stages = dict(jobs.baseline_labels(df))
    assert all("raw" not in d.columns and d.filter(F.length("text") > 6).count() == 0 for d in stages.values())
    got = sorted((r.start, r.end, r.type, r.n_merged, r.text) for r in stages["merged"].collect())
    flat = df.select("id", F.col("text").alias("raw"), F.explode(S.strip_spans(F.col("text"), F.col("spans"))).alias("x")).select("id", "raw", "x.start", "x.end", "x.type")
    assert got == sorted((r.start, r.end, r.type, r.n_merged, r.text) for r in postprocess.merge_runs(flat).collect())
    assert [r.n for r in match.funnel(list(stages.items())).collect()] == [5, 5, 4, 1]


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_bio_spans_of_null_and_empty(spark, mode):
    df = spark.createDataFrame([(["I-A", "I-A", "B-A", "I-B", "O"],), ([],), (None,), (["I-A"],)], "x array<string>").coalesce(1)
    got = [None if r.s is None else [tuple(s) for s in r.s] for r in df.select(S.bio_spans(F.col("x"), mode).alias("s")).collect()]
    assert got == [[(0, 1, "A"), (2, 2, "A"), (3, 3, "B")], [], None, [(0, 0, "A")]]


def test_tag_scores_of_one_long_row(spark):
    gold = ["B-X", "I-X", "O"] * 3000
    df = spark.createDataFrame([(gold, [*gold[:-3], "O", "O", "O"]), ([], []), (None, None)], "gold_tags array<string>, pred_tags array<string>")
    got = {r.key: (r.tp, r.pred, r.gold) for r in match.tag_scores(df).collect()}
    assert got == {"X": (2999, 2999, 3000), "all": (2999, 2999, 3000)}


def test_negative_spans_touch_no_positive(spark):
    df = spark.createDataFrame([(20, [(3, 5), (9, 9)], "a"), (2, [(0, 1)], "b"), (0, [], "c")], "n int, p array<struct<first:int,last:int>>, id string")
    got = [[tuple(x) for x in r.s] for r in df.coalesce(1).select(S.negative_spans(F.col("n"), F.col("p"), F.col("id")).alias("s")).collect()]
    assert len(set(got[0])) == 4 and got[1:] == [[], []]
    assert all(not (a <= y and x <= b) and 0 <= x <= y < 20 and y - x < 5 for x, y in got[0] for a, b in [(3, 5), (9, 9)])


def test_label_checks_do_not_count_from_the_start_of_a_long_text(spark):
    """where a span lies in its text costs nothing; this took minutes when every check walked there."""
    n, k = 2_000_000, 3000
    text = "﻿" + "a\U0001f600 b" * (n // 4)  # offsets of code points, not of bytes or UTF-16 units
    spans = [(n - 8 * i - 3, "b") for i in range(k)]  # text[s : s + 1]: its own sign stands behind a blank
    spans += [(0, "﻿"), (4, "x"), (len(text) - 1, "b"), (len(text), "")]
    rows = [("long", text, [(t, s, s + 1, vocab.DRUG, [], [], True) for s, t in spans]), ("empty", "", []), ("null", None, [("a", 0, 1, vocab.DRUG, [], [], True)])]
    df = spark.createDataFrame(rows, f"id string, text string, entities {vocab.ENTITIES}").coalesce(1)
    began = time.time()
    got = {r.id: Counter(r.errors) for r in contract.validate_labels(df).collect()}
    took = time.time() - began
    own = [(s, t, text[s : s + 1]) for s, t in spans]
    wrong = sum(x != t for s, t, x in own[:-1])
    word = [c in "ab" for c in text]
    cut = sum((s > 0 and word[s - 1] and word[s]) or (s + 1 < len(text) and word[s] and word[s + 1]) for s, _, _ in own[:-1])
    assert got == {"long": Counter({k: v for k, v in {"bad_position": 1, "text_mismatch": wrong, "cut_word": cut}.items() if v}), "empty": Counter(), "null": Counter({"bad_position": 1})}
    assert took < 30


def test_baseline_stages_do_not_count_from_the_start_of_a_long_text(spark):
    """where a span lies in its text costs nothing, nor do repeated surfaces grow with their square."""
    n, k = 2_000_000, 6000
    text = "﻿" + "(a\U0001f600, bB)\n" * (n // 9)
    names = [*vocab.LABEL_MAP, "X"]
    spans = [(9 * i + 1, 9 * i + 4 + (i % 2) * 5, names[i % 5]) for i in range(len(text) // 9 - k, len(text) // 9)]
    df = spark.createDataFrame([(1, text, spans), (2, "", []), (3, None, [(0, 1, "X")])], "id int, text string, spans array<struct<start:int,end:int,type:string>>").coalesce(1)
    began = time.time()
    stages = dict(jobs.baseline_labels(df))
    got = {name: sorted(tuple(r)[1:] for r in d.collect()) for name, d in stages.items()}
    took = time.time() - began
    bare = [(text[s:e].strip("(,) "), s, e, t) for s, e, t in spans]
    want = [(x, s + text[s:e].index(x), s + text[s:e].index(x) + len(x), t) for x, s, e, t in bare]
    assert got["trimmed"] == got["unblocked"] == sorted(want)
    assert got["merged"] == sorted((s, e, t, 1, x) for x, s, e, t in want)
    kept = {}
    for x, s, e, t in sorted(want, key=lambda y: y[1:]):
        if t in vocab.LABEL_MAP:
            kept.setdefault((x.lower(), vocab.LABEL_MAP[t]), (s, e, vocab.LABEL_MAP[t], 1, x))
    assert got["final"] == sorted(kept.values())
    assert took < 30


def test_training_windows_are_cut_before_they_are_exploded(spark, sf):
    """Round 3, F1: no row of a window waits for Python with its tokens, which took over 3 GB of an executor or its disk."""
    plan = windows.training_rows(queries.records(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("Generate ") < plan.index("ArrowEvalPython ") and plan.count("ArrowEvalPython ") == 2


def test_training_windows_of_odd_records(spark):
    text = "1. Mục a\nx đau bụng\nTiêu đề\n" + "t " * 9
    ents = [("đau bụng", 11, 19, vocab.SYMPTOM, ["isNegated"], [], None), ("bụng", 15, 19, None, None, [], True), ("x", -5, 900, vocab.DRUG, [], [], True)]
    rows = [("a", text, ents), ("b", None, ents), ("c", "", None), (None, "x", None)]
    df = spark.createDataFrame([(*r, "document", "s", "g") for r in rows], f"id string, text string, entities {vocab.ENTITIES}, record_kind string, source string, genre string")
    got = {r.id: r for r in windows.training_rows(df, size=6, overlap=2, context=1, header_dropout=0.0, empty_keep=1.0, o_keep=0.0).collect()}
    assert sorted(got) == ["0", "a#0", "a#1", "a#2", "a#3"]
    for r in got.values():
        assert len(r.tokens) == len(r.char_offsets) == len(r.ner_tags) == len(r.token_loss_mask)
        assert [(r.ner_tags[x.start], r.tokens[x.start : x.end + 1]) for x in r.spans if x.type_id] == [(f"B-{vocab.SYMPTOM}", ["đau", "bụng"]) for x in r.spans if x.type_id]
        assert sum(r.token_loss_mask) == sum(t != "O" for t in r.ner_tags)
    assert sum(len(r.spans) for r in got.values()) >= 2
    last = got["a#3"]
    assert last.n_prefix == 3 and last.tokens[:3] == ["Tiêu", "đề", "t"] and [tuple(x) for x in last.char_offsets[:2]] == [(0, 4), (5, 7)]


def test_negative_spans_of_a_positive_before_the_row(spark):
    df = spark.createDataFrame([(10, [(-9, -4), (5, 3), (9, 40)], "a")], "n int, p array<struct<first:int,last:int>>, id string")
    got = [tuple(x) for x in df.select(S.negative_spans(F.col("n"), F.col("p"), F.col("id")).alias("s")).first().s]
    assert len(set(got)) == 6 and all(0 <= x <= y < 9 for x, y in got)


def test_exported_app_keeps_empty_and_null_notes(spark, tmp_path):
    """Round 3, F2: Spark's readers skip files of no length, and with them these rows were lost."""
    from spanloom import queries_io

    text = "x\r\n﻿the of"
    one = [("the", 4, 7, vocab.DRUG, [], [], True), ("x", 0, 1, vocab.DRUG, [], [], True)]
    df = spark.createDataFrame([("c", text, one), ("a", "", []), ("b", None, [])], f"id string, text string, entities {vocab.ENTITIES}")
    sinks.export_app(df, str(tmp_path / "app"))
    digest = lambda x: sha256(x.encode()).hexdigest()
    got = sorted(tuple(r) for r in queries_io.exported_app(spark, str(tmp_path / "app")).collect())
    assert got == [("001", "a", digest(""), 0, True), ("002", "b", None, 0, True), ("003", "c", digest(text), 2, True)]
    (tmp_path / "app" / "notes" / "002.txt").unlink()
    with pytest.raises(Exception, match="002.txt"):
        queries_io.exported_app(spark, str(tmp_path / "app")).collect()


def test_app_export_of_a_table_with_empty_texts(spark, tmp_path):
    rows = [(i, t, "en", "src0") for i, t in enumerate(["a b", "", None, "c " * 300])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.sha for r in queries.QUERIES["app_export"](spark, str(tmp_path)).collect()}
    assert got == {str(i): None if t is None else sha256(t.encode()).hexdigest() for i, t, *_ in rows}
