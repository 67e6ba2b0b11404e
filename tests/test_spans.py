"""Span folds, matching and windows against brute force."""

import random

from pyspark.sql import functions as F

from spanloom.functions import spans as S, vocab
from spanloom.operators import match, postprocess, stats, windows

KIND = "struct<start:int,end:int,type:string,confidence:double>"


def random_spans(rng, n):
    out = []
    for _ in range(rng.randint(0, n)):
        s = rng.randint(0, 25)
        out.append((s, s + rng.randint(1, 9), rng.choice("AB"), rng.choice([0.3, 0.5, 0.5, 0.9])))
    return out


def frame(spark, seed, rows=120):
    rng = random.Random(seed)
    data = [(i, random_spans(rng, 8)) for i in range(rows)]
    return data, spark.createDataFrame(data, f"i int, x array<{KIND}>")


def test_keep_longest(spark):
    data, df = frame(spark, 1)
    got = {r.i: r.y for r in df.select("i", S.keep_longest(F.col("x"), KIND).alias("y")).collect()}
    for i, xs in data:
        kept, dropped = [], 0
        for x in sorted(range(len(xs)), key=lambda k: (xs[k][0], xs[k][1], k)):
            x = xs[x]
            if kept and x[0] < kept[-1][1]:
                dropped += 1
                if x[1] - x[0] > kept[-1][1] - kept[-1][0]:
                    kept[-1] = x
            else:
                kept.append(x)
        assert [tuple(k) for k in got[i].kept] == kept and got[i].dropped == dropped


def test_suppress(spark):
    data, df = frame(spark, 2)
    got = {r.i: [tuple(x) for x in r.y] for r in df.select("i", S.suppress(F.col("x"), KIND).alias("y")).collect()}
    for i, xs in data:
        best = {}
        for x in xs:
            if x[:3] not in best or x[3] > best[x[:3]][3]:
                best[x[:3]] = x
        kept = []
        for x in sorted(best.values(), key=lambda x: (-x[3], x[0] - x[1], x[0], x[2])):
            if all(x[1] <= k[0] or k[1] <= x[0] for k in kept):
                kept.append(x)
        assert got[i] == sorted(kept)


def test_greedy_match(spark):
    rng = random.Random(3)
    data = [(i, random_spans(rng, 6), random_spans(rng, 6)) for i in range(150)]
    df = spark.createDataFrame(data, f"i int, g array<{KIND}>, p array<{KIND}>")
    for r in df.select("i", match.greedy_match(F.col("g"), F.col("p")).alias("m")).collect():
        _, g, p = data[r.i]
        pairs = sorted((-(min(a[1], b[1]) - max(a[0], b[0])), x, y) for x, a in enumerate(g) for y, b in enumerate(p) if a[2] == b[2] and min(a[1], b[1]) > max(a[0], b[0]))
        want, used_g, used_p = [], set(), set()
        for _, x, y in pairs:
            if x not in used_g and y not in used_p:
                want.append((x, y))
                used_g.add(x)
                used_p.add(y)
        assert [tuple(m) for m in r.m] == want


def files(spark, rows):
    return spark.createDataFrame(rows, f"file string, spans array<{match.SPAN}>")


def span(text, s, kind, *marks):
    return (text, s, s + len(text), kind, list(marks))


def test_score_report(spark):
    gold = files(spark, [("a", [span("đau", 0, vocab.SYMPTOM, "isNegated"), span("ho khan", 10, vocab.SYMPTOM)]), ("b", [span("sốt", 0, vocab.SYMPTOM)])])
    pred = files(spark, [("a", [span("đau", 0, vocab.SYMPTOM), span("ho", 10, vocab.SYMPTOM), span("ho", 30, vocab.DRUG)]), ("z", [span("x", 0, vocab.DRUG)])])
    got = {(r.scope, r.key): (r.tp, r.pred, r.gold) for r in match.score_report(gold, pred).collect()}
    assert got["micro", "all"] == (2, 3, 3) and got["exact", "all"] == (1, 3, 3)
    assert got["type", vocab.SYMPTOM] == (2, 2, 3) and got["type", vocab.DRUG] == (0, 1, 0)
    assert got["assertion", "isNegated"] == (0, 0, 1)
    assert match.boundary_report(gold, pred).first().extra_words == -1


def test_confusion_and_sieve(spark):
    gold = files(spark, [("a", [span("đau ngực", 0, vocab.SYMPTOM)])])
    pred = files(spark, [("a", [span("đau", 0, vocab.DIAGNOSIS)])])
    assert [tuple(r) for r in match.confusion(gold, pred).collect()] == [(vocab.SYMPTOM, vocab.DIAGNOSIS, 1)]
    blocked = spark.createDataFrame([("Thuốc ",)], "surface string")
    rows = spark.createDataFrame([("a", "thuốc"), ("a", "ho")], "file string, text string")
    assert [r.text for r in match.sieve(rows, blocked).collect()] == ["ho"]


def test_word_errors_and_jaccard(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(4)
    data = [([rng.choice("abc") for _ in range(rng.randint(0, 6))], [rng.choice("abc") for _ in range(rng.randint(0, 6))]) for _ in range(60)]
    df = spark.createDataFrame(data, "a array<string>, b array<string>")
    for r in df.select("a", "b", match.word_errors(F.col("a"), F.col("b")).alias("d"), match.jaccard(F.col("a"), F.col("b")).alias("j")).collect():
        assert r.d == distance(r.a, r.b)
        assert r.j == (1.0 if not r.a and not r.b else len(set(r.a) & set(r.b)) / len(set(r.a) | set(r.b)))


def test_bio_decoders(spark):
    labels = ["O", "I-X", "I-X", "B-X", "I-Y", "0", "I-Y", "E-X"]
    df = spark.createDataFrame([(labels,)], "x array<string>")
    strict, lenient = df.select(S.bio_spans(F.col("x")), S.bio_spans(F.col("x"), "lenient")).first()
    assert [tuple(s) for s in lenient] == [(1, 2, "X"), (3, 3, "X"), (4, 4, "Y"), (6, 6, "Y")]
    assert [tuple(s)[:2] for s in strict] == [(1, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)]


def test_arbitration(spark):
    rows = [("X", 0.9, None, 0.7), ("X", 0.9, None, 0.5), ("X", 0.8, "X", 0.6), ("X", 0.8, "Y", 0.84), ("X", 0.8, "Y", 0.9)]
    df = spark.createDataFrame(rows, "a string, b double, c string, d double")
    got = [r.v for r in df.select(S.arbitrate(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("v")).collect()]
    assert got[0] is None and tuple(got[1]) == ("X", 0.9) and tuple(got[2]) == ("X", 0.7) and got[3] is None and tuple(got[4]) == ("Y", 0.9)


def test_merge_runs(spark):
    raw = "ab cd    ef\ngh, ij"
    rows = [(1, raw, 0, 2, "DRUGCHEMICAL"), (1, raw, 3, 5, "UNITCALIBRATOR"), (1, raw, 9, 11, "X"), (1, raw, 12, 14, "X"), (1, raw, 16, 18, "X")]
    df = spark.createDataFrame(rows, "id int, raw string, start int, end int, type string")
    got = sorted((r.start, r.end, r.type, r.n_merged, r.text) for r in postprocess.merge_runs(df).collect())
    assert got == [(0, 5, "DRUGCHEMICAL", 2, "ab cd"), (9, 11, "X", 1, "ef"), (12, 14, "X", 1, "gh"), (16, 18, "X", 1, "ij")]


def entity(text, surface, kind, *marks, at=None):
    s = text.index(surface) if at is None else at
    return (surface, s, s + len(surface), kind, list(marks), [], True)


def test_clean_entities(spark):
    text = "đau bụng và\nho khan "
    rows = [("đau bụng", 0, 8, vocab.SYMPTOM, ["isNegated", "zzz"], [], True), ("đau bụng", 0, 8, vocab.SYMPTOM, [], [], True), ("x", 0, 1, "NO", [], [], True), ("và\nho", 9, 14, vocab.SYMPTOM, [], [], True), (" khan ", 14, 20, vocab.TEST, ["isFamily"], [], True), ("bụng", 4, 8, vocab.DRUG, [], [], True), ("q", 50, 51, vocab.DRUG, [], [], True)]
    df = spark.createDataFrame([(text, rows)], f"t string, e {vocab.ENTITIES}")
    r = df.select(S.clean_entities(F.col("t"), F.col("e")).alias("x")).first().x
    assert [(e.text, e.start, e.end, e.assertions) for e in r.entities] == [("đau bụng", 0, 8, ["isNegated"]), ("khan", 15, 19, [])]
    assert sorted(r.reasons) == sorted(["duplicate", "bad_type", "line_break", "bad_offset", "assertion_repaired", "assertion_repaired", "overlap"])


def notes(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")


def test_sliding_windows(spark):
    ws = windows.sliding_windows(notes(spark, " ".join(f"t{i}" for i in range(50)), ""), 12, 3, 5, header=False).orderBy("id", "w").collect()
    assert [t.tok for t in ws[1].prefix] == [f"t{i}" for i in range(4, 9)]
    assert [len(w.content) for w in ws] == [12, 12, 12, 12, 12, 5] and {w.id for w in ws} == {"0"}


def test_header_is_prepended_unless_visible(spark):
    text = "1. Khám bệnh\n" + " ".join(f"t{i}" for i in range(30))
    ws = windows.sliding_windows(notes(spark, text), 12, 2, 3).orderBy("w").collect()
    assert ws[0].prefix == [] or ws[0].prefix[0].tok != "1"
    assert [t.tok for t in ws[1].prefix][:4] == ["1", ".", "Khám", "bệnh"]


def test_section_windows(spark):
    text = "intro a b c\n1. Head\n" + " ".join(["w"] * 25) + "\n2) Next\nx y z"
    df = notes(spark, text)
    ws = windows.section_windows(df, 10).orderBy("w").collect()
    assert all(len(w.content) <= 10 for w in ws)
    assert [t.tok for t in ws[2].prefix] == ["1", ".", "Head"]
    assert windows.window_check(df, windows.section_windows(df, 10), 10).first().complete


def test_coverage_and_rows(spark):
    text = "Bệnh nhân không đau bụng hôm nay."
    e = entity(text, "đau bụng", vocab.SYMPTOM, "isNegated")
    df = spark.createDataFrame([("a", text, [e], "document", "s", "g")], f"id string, text string, entities {vocab.ENTITIES}, record_kind string, source string, genre string")
    row = windows.training_rows(df, o_keep=0.0).first()
    assert list(row.spans[0].assertions) == [1, 0, 0] and row.ner_tags.count(f"B-{vocab.SYMPTOM}") == 1 and sum(row.token_loss_mask) == 2
    spans = spark.createDataFrame([("a", e[1], e[2]), ("a", 0, 2)], "id string, start int, end int")
    left = windows.uncovered(spans, windows.sliding_windows(df, header=False)).collect()
    assert [(r.start, r.end) for r in left] == [(0, 2)]
    v1 = windows.training_rows_v1(df).first()
    assert v1.ner_tags.count(f"I-{vocab.SYMPTOM}") == 1 and [1, 0, 0] in v1.assert_tags


def test_chunks(spark):
    df = spark.createDataFrame([([3, 3, 3, 9, 1],)], "c array<int>")
    got = df.select(windows.chunks_by_budget(F.col("c"), 6).alias("x")).first().x
    assert [tuple(x) for x in got] == [(0, 1), (2, 2), (3, 3), (4, 4)]
    assert windows.encoder_capacity(258, 1) == 256 and windows.encoder_capacity(512, 0) == 511


def test_overlap_pairs(spark):
    rng = random.Random(5)
    rows = [(str(rng.randint(0, 3)), s := rng.randint(0, 40), s + rng.randint(1, 8)) for _ in range(60)]
    df = spark.createDataFrame(rows, "file string, start int, end int")
    got = {r.file: r.pairs for r in stats.full_overlaps(df).collect()}
    for f in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == f]
        assert got[f] == sum(a[1] < b[2] and b[1] < a[2] for i, a in enumerate(own) for b in own[:i])


def test_occurrence_rows(spark):
    text = "đau ngực, rồi đau ngực. Sau đó đau ngực vì viêm phổi nặng"
    at = [i for i in range(len(text)) if text.startswith("đau ngực", i)]
    es = [entity(text, "đau ngực", vocab.SYMPTOM, at=at[0]), entity(text, "đau ngực", vocab.SYMPTOM, at=at[1]), entity(text, "viêm phổi nặng", vocab.DIAGNOSIS)]
    df = spark.createDataFrame([("r", text, es)], f"id string, text string, entities {vocab.ENTITIES}")
    got = {r.surface: r for r in stats.occurrence_rows(df).collect()}
    r = got["đau ngực"]
    assert (r.occurrence_count, r.selected_count, r.omitted_count, r.near_same_sentence_taken, r.first_only) == (3, 2, 1, 1, False)
    s = stats.occurrence_summary(stats.occurrence_rows(df), F.lit(1)).first()
    assert (s.groups, s.mixed_pct) == (1, 100.0)
