"""Text functions against Python restatements."""

import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import cues, text as T, vocab
from spanloom.functions.core import regex_spans, running_sums

TEXTS = ["", " ", "a b", "Bệnh nhân: không đau bụng, 37.5 độ C!", "x\u00a0y\u2003z", "😀 ok😀.\nnew  line", "a\u0300 à _9", "t0 " * 700, "1. Mục\n2) Hai\r\n"]


def one(spark, values, *cols):
    schema = ", ".join(f"c{i} {'int' if isinstance(v, int) else 'string'}" for i, v in enumerate(values))
    return spark.createDataFrame([tuple(values)], schema).select(*[f(*[F.col(f"c{i}") for i in range(len(values))]) for f in cols]).first()


def test_tokens_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", T.tokens(F.col("t")).alias("k"))
    for r in df.collect():
        want = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", TEXTS[r.i])]
        if "\u0300" in TEXTS[r.i]:
            want = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W]+|[^\w\s]", TEXTS[r.i])]
        assert [tuple(x) for x in r.k] == want


def test_running_sums_over_blocks(spark):
    n = 1000
    got = spark.range(1).select(running_sums(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 7)).alias("x")).first().x
    want, s = [], 0
    for i in range(1, n + 1):
        want.append(s)
        s += i % 7
    assert got == want


@pytest.mark.parametrize("text", ["a.b 😀 c.d", "", "....", "no hit"])
def test_regex_spans(spark, text):
    got = one(spark, [text], lambda c: regex_spans(c, r"\.").alias("x")).x
    assert [(x.s, x.e, x.hit) for x in got] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\.", text)]


def test_occurrences_are_word_bounded(spark):
    got = one(spark, ["ho khan, khoho, ho. x.ho", "ho"], lambda t, s: T.occurrences(t, s).alias("x"), lambda t, s: T.nth_occurrence(t, s, F.lit(1)).alias("n")).asDict()
    assert got == {"x": [0, 16, 22], "n": 16}


def test_sentences(spark):
    r = one(spark, ["A b. C d!\nE… f"], lambda t: T.sentence_breaks(t).alias("b"), lambda t: T.sentence_index(T.sentence_breaks(t), F.lit(5)).alias("i"))
    assert (r.b, r.i) == ([5, 10, 13], 1)


def test_collapse(spark):
    for n, kept in ((99, 99), (100, 30), (350, 30)):
        assert len(one(spark, ["y" * n], lambda c: T.collapse_runs(c).alias("x")).x) == kept


def test_collapse_leaves_touched_runs(spark):
    df = spark.createDataFrame([("a" * 120 + " " + "b" * 120 + " end", [(125, 130)])], "t string, s array<struct<start:int,end:int>>")
    runs = T.collapse_plan(F.col("t"), F.col("s"))
    r = df.select(T.collapse_text(F.col("t"), runs).alias("x"), T.collapse_shift(runs, F.lit(125)).alias("a")).first()
    assert r.x == "a" * 30 + " " + "b" * 120 + " end" and r.a == 35


def test_marks(spark):
    r = one(spark, ['Người <E id="core:d1">đau ngực</E> từ <E id="x"> a </E>. đau ngực'], lambda c: T.parse_marks(c).alias("x")).x
    assert r.raw == "Người đau ngực từ  a . đau ngực"
    assert [(m.id, r.raw[m.s : m.e]) for m in r.marks] == [("core:d1", "đau ngực"), ("x", " a ")]
    assert r.errors == ["outer_whitespace:x"]


def test_headings_and_headers(spark):
    text = "TIỀN SỬ BỆNH\nho\nKhám:\nsốt cao"
    r = one(spark, [text], lambda t: T.nearest_heading(T.headings(t), F.lit(len(text) - 3)).alias("a"), lambda t: T.nearest_header(t, F.lit(15)).alias("b"), lambda t: T.nearest_heading(T.headings(t), F.lit(2)).alias("c"))
    assert (r.a, r.b, r.c) == ("Khám", "TIỀN SỬ BỆNH", None)


def test_layout_strips_only_white_space(spark):
    r = one(spark, ["Column x\n  short \n\n" + "z" * 41], lambda c: T.layout(c).alias("x")).x
    assert (r.lines, r.short_lines) == (3, 2)


def test_small_scalars(spark):
    r = one(
        spark,
        ["  TIỀN SỬ: "],
        lambda c: T.natural_heading(c).alias("a"),
        lambda c: T.leading_negation(F.lit("Không đau")).alias("b"),
        lambda c: F.size(T.measurements(F.lit("uống 5 mg, 3gx, 37,5 °C"))).alias("m"),
        lambda c: T.trim_span(F.lit("(đau bụng), x"), F.lit(0), F.lit(11), T.EDGE_CHARS).alias("t"),
        lambda c: T.genre(F.lit("1. Tiền sử\nCâu hỏi từ người dùng")).alias("g"),
        lambda c: T.has_table(F.lit("| a | b |")).alias("h"),
        lambda c: T.nfc(F.lit("a\u0300")).alias("n"),
    )
    assert r.a == "Tiền sử" and r.b == "Không " and r.m == 2 and r.t.text == "đau bụng" and (r.t.start, r.t.end) == (1, 9) and r.g == "MIXED" and r.h and r.n == "à"


def test_shingles_need_enough_words(spark):
    r = one(spark, ["A b c d"], lambda c: T.shingles(c, 3).alias("a"), lambda c: T.shingles(c, 5).alias("b"))
    assert r.a == ["a b c", "b c d"] and r.b == []


CUES = [
    ("Người bệnh không có đau ngực trong đợt này.", "đau ngực", ["isNegated"], ["isNegated"]),
    ("Hiện tại người bệnh vàng da và mệt nhiều.", "vàng da", [], []),
    ("Tiền sử: người bệnh từng mắc viêm phổi năm 2019.", "viêm phổi", ["isHistorical"], ["isHistorical"]),
    ("điều trị từng đợt đau lưng", "đau lưng", ["isHistorical"], []),
    ("bàng quang đau bụng", "đau bụng", [], []),
    ("Bố bị hen suyễn", "hen suyễn", ["isFamily"], []),
    ("sốt không có", "sốt", ["isNegated"], []),
]


@pytest.mark.parametrize("text,surface,support,conflict", CUES)
def test_cues(spark, text, surface, support, conflict):
    s = text.index(surface)
    r = one(spark, [text], lambda t: cues.support(t, F.lit(s), F.lit(s + len(surface))).alias("a"), lambda t: cues.conflict(t, F.lit(s)).alias("b"))
    assert (r.a, r.b) == (support, conflict)


def test_repair(spark):
    text = "Người bệnh từng đau ngực nhiều"
    s = text.index("đau ngực")
    call = lambda kind, marks: cues.repaired(F.lit(text), F.lit(s), F.lit(s + 8), F.lit(kind), marks)
    none = F.array().cast("array<string>")
    r = spark.range(1).select(call(vocab.SYMPTOM, none).alias("a"), call(vocab.DRUG, none).alias("b"), call(vocab.SYMPTOM, F.array(F.lit("isNegated"))).alias("c"), cues.discourse_bias(F.lit("x"), F.lit("Tiền sử gia đình")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (["isHistorical"], [], ["isHistorical"], "isFamily")


def test_evidence(spark):
    text = "đau ngực sáng nay, sau đó đau ngực lại"
    second = text.rindex("đau ngực")
    ok = lambda at, e: cues.evidence_supports(F.lit(text), F.lit("đau ngực"), F.lit(at), F.lit(e))
    r = spark.range(1).select(ok(0, "đau ngực sáng … nay"), ok(second, "đau ngực sáng"), ok(0, "đau ngực")).first()
    assert list(r) == [True, False, False]
