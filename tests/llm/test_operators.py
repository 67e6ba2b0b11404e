"""The corpus operators against brute force, and on awkward inputs."""

import collections
import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, html_extract, langid, mixing, near_dedup, pii, quality, secret_scan, substring_dedup, topk
from spanloom.llm.queries import QUERIES, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word" + "x" * 30_000 + " " + "der die das und ist nicht " * 3000
ROWS = [
    (1, "the cat and the dog of it is on a mat for you " * 8, "en", "s0"),
    (2, None, "en", None),
    (3, "", None, "s1"),
    (4, "  \n\t ", "fr", "s1"),
    (5, LONG, "de", "s0"),
    (6, "the cat and the dog of it is on a mat for you " * 8, "en", "s0"),
    (6, "the cat and the dog of it is on a mat for you " * 8, "en", "s0"),
    (7, "😀 !!! 123", "xx", "s2"),
    (None, "the cat and the dog", "en", "s0"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, token_ids string, score string, quality string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    return collections.Counter(map(tuple, df.collect()))


# --- personal data and secrets


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def luhn(d):
    return 12 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text, table):
    out = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(table.items()) for m in re.finditer(p, text or "") if ok(m.group())]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_pii_base_spans(spark):
    rng = random.Random(1)
    pieces = ["a@b.c", "x.y@z-1.com_q@r.s", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é😀", "1.2.3.4.5", " ", "-", "@", "7" * 30, "00255.0.0.1"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "", "9" * 20_000, "a" * 50_000 + "@", "1.2.3.4 " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.summary(df).collect():
        want = base_spans(texts[r.doc_id], BASE)
        assert r.base_sha256 == digest(want), texts[r.doc_id]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_pii_checks_and_context(spark):
    df = spark.createDataFrame([(1, "GB82WEST12345698765432 and GB82WEST12345698765433"), (2, "ssn 219-09-9999, then 219-09-9999"), (3, "order 219-09-9999")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.summary(df).collect()}
    assert got == {1: "iban:0:22", 2: "ssn:4:15", 3: ""}


SECRETS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", None),
    "access": (r"AKIA[A-Z0-9]+", None),
    "hex": (r"[0-9a-f]+", None),
}


def secret_spans(text):
    out = []
    for k, kind in enumerate(SECRETS):
        for m in re.finditer(SECRETS[kind][0], text or ""):
            if len(m.group(1)) >= 6 if kind == "assign" else len(m.group()) >= (20 if kind == "access" else 24):
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_secret_base_spans(spark):
    rng = random.Random(2)
    pieces = ["password", "API_KEY", "token", "=", ": ", "'", '"', "abc123", "AKIA", "ABCDEFGH12345678", "0f" * 12, "deadbeef", " ", "é", "=="]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "", "a" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.summary(df).collect():
        assert r.base_sha256 == digest(secret_spans(texts[r.doc_id])), texts[r.doc_id]


def test_secret_links(spark):
    tok = "aB3" + "xY9z" * 9
    far = "z " * 200
    df = spark.createDataFrame([(1, f"user: bob {tok}"), (2, f"user: bob {far}{tok}"), (3, f"{tok}"), (4, f"https://a.b {tok}"), (5, "user: bob https://a.b"), (5, "user: bob https://a.b")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, "token" in r.spans, "identifier" in r.spans, "endpoint" in r.spans) for r in secret_scan.summary(df).collect())
    assert got == {(1, True, True, False): 1, (2, False, False, False): 1, (3, False, False, False): 1, (4, True, False, False): 1, (5, False, False, False): 2}


def test_redaction_keeps_rows(spark, docs):
    df = docs.unionByName(docs.limit(1).withColumn("text", F.lit("é token = abcdefgh!")))
    got = by_id(secret_scan.redact(df).select("text"))
    assert got[("é [SECRET]!",)] == 1 and sum(got.values()) == len(ROWS) + 1 and got[(None,)] == 1


# --- quality


def test_quality_counts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n#|x\n#|x\n\n"]) for _ in range(200)] + [LONG, "\x0b\x0ca b\r\nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.assess(df).select("doc_id", "quality.*").collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {z for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for z in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(hit))


# --- tokens


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    alphabet = list("  \n\t'sdtrelv.,!?aZ09é 　\u0085中😀ß<|>") + ["<|endoftext|>", "'re", " the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["", LONG, "a" * 5000]
    ref = Tokenizer.from_file(vocabulary_path())
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in bpe.decode(bpe.encode(df, vocabulary_path(), keep=["i"]), vocabulary_path()).collect():
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert ids == ref.encode(texts[r.i], add_special_tokens=False).ids
        assert r.decoded == texts[r.i]


# --- near duplicates and substrings


def brute_classes(rows):
    first, sets, of = {}, {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = tuple(WORD.findall(t or ""))
        if not w:
            of.append((i, i, i))
            continue
        rep = first.setdefault(w, i)
        sets.setdefault(rep, {w[k : k + 5] for k in range(len(w) - 4)} or {w})
        of.append((i, rep, None))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return collections.Counter((i, rep, c if c is not None else root(rep)) for i, rep, c in of)


@pytest.mark.parametrize("tile", [4, 100])
def test_near_duplicates(spark, tile):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        words = [rng.choice(vocab) for _ in range(120)]
        for copy in range(12):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((base * 100 + copy, " ".join(own)))
    rows += [(900 + i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(20)] + [(950, ""), (951, None), (952, "one two"), (953, "one  two"), (None, "x y z"), (953, "one  two")]
    got = collections.Counter(tuple(r) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect())
    assert got.pop((None, None, None)) == 1
    assert got == brute_classes(rows)


def test_near_duplicates_with_repeats_on_one_side(spark):
    rng = random.Random(8)
    rows = []
    for pair in range(40):
        words = [f"p{pair}w{rng.randint(0, 9999)}" for _ in range(104)]
        rows.append((2 * pair, " ".join(words)))
        # a few new shingles, and twenty words a thousand times
        rows.append((2 * pair + 1, " ".join(words + words[:20] * 1000)))
    rows += [(900, "no words of those above at all in this one"), (901, "")]
    got = collections.Counter(tuple(r) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_classes(rows)
    assert sum(c == i - 1 for i, _, c in got) == 40


def test_near_duplicate_stage_keeps_the_texts_of_a_repeated_id(spark):
    import corpus_pipeline

    copied, apart, last = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, copied), (2, copied), (2, apart), (2, apart), (2, last), (3, last), (4, None), (None, copied)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(1, copied), (2, apart), (2, last), (4, None), (None, copied)])


def brute_kept(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = collections.Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {z for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for z in range(k, k + window)}
        out[i, len(w), len(gone), " ".join(x for z, x in enumerate(w) if z not in gone)] += 1
    return out


@pytest.mark.parametrize("window,block", [(10, 5), (13, 5), (50, 25)])
def test_substrings(spark, window, block):
    rng = random.Random(window)
    shared = [[f"s{rng.randint(0, 9)}" for _ in range(rng.randint(window - 3, 3 * window))] for _ in range(5)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice([rng.choice(shared), [f"u{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))], ["the"] * rng.randint(0, 2 * window)])
        rows.append((i, "  ".join(words)))
    rows += [(100, None), (101, ""), (5, rows[5][1]), (None, rows[7][1]), (102, rows[8][1])]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=window, block=block, bits=16, keep=["doc_id"])
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_kept(rows, window)


def test_substring_rounds(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(k * 7) % 50}" for k in range(i, i + 150))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "BITS_EACH", 5000)
    got = substring_dedup.dedup(df, bits=16, keep=["doc_id"])
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_kept(rows, 50)


def test_beyond_the_broadcast_bound(spark, monkeypatch, sf):
    """With every side too large to broadcast, shuffled joins give the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(40)
    calls = (
        (substring_dedup, lambda: substring_dedup.dedup(docs, bits=16, keep=["doc_id"])),
        (near_dedup, lambda: near_dedup.classes(docs, tile=3)),
        (html_extract, lambda: html_extract.main_text(pages, keep=["page_id"])),
    )
    for module, call in calls:
        want = by_id(call())
        monkeypatch.setattr(module, "BROADCAST", -1)
        assert by_id(call()) == want


# --- search and mix


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.1, -0.2, 0.0, 0.31]) for _ in range(6)]) for i in range(900)]
    rows += [(1000, None), (1001, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [0.1] * 6), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, lambda v: v % 20 == 0, k=7).orderBy("query_id", "rank").collect()]
    v = {i: np.floor(64 * np.array(e, np.float32).astype(float)).astype(int) for i, e in rows[:900]}
    want = []
    for q in sorted(i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:7]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want


def test_top_k_small_and_huge(spark):
    df = spark.createDataFrame([(20, [1e15, 2.0]), (21, [1e15, 3.0]), (22, [])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, lambda v: v % 20 == 0).collect()]
    assert got[0][:3] == (20, 1, 21) and got[0][3] == 2**63 - 1 and got[1] == (20, 2, 22, 0)
    assert topk.top_k(df.limit(0), lambda v: v % 20 == 0).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, frozen = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in frozen]
        rest, mass = total - sum(frozen.values()), sum(w[s] for s in free)
        now = {s: rest * w[s] / mass for s in free} if free else {}
        over = [s for s in free if now[s] > most * sizes[s] + 1e-9]
        if not over:
            return frozen | now
        frozen |= {s: most * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(7)
    rows, i = [], 0
    for s, n in (("a", 3), ("b", 400), ("Z", 30), ("é", 5), (None, 50), ("empty", 2), ("c", 0)):
        for _ in range(n):
            i += 1
            rows.append((i, None if s == "empty" else " ".join(["w"] * rng.randint(0, 60)), s))
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes) | {"empty": 0})
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= max(60, 0.05 * want[s])
    assert sorted(map(str, mixing.mix(df.repartition(3)).collect())) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0
    # the mixed corpus repeats rows as told, nulls included
    took = collections.Counter(r.doc_id for r in mixing.take(df).collect())
    assert took == collections.Counter({r.doc_id: sum(x.copies for x in got if x.doc_id == r.doc_id) for r in got if r.copies})


# --- language


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    got = langid.predict(docs, model, keep=["doc_id", "lang"]).filter(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert {k[0] for k in model["machines"]} == {"family", "language"}


def test_language_learns_from_no_held_out_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    lied = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert "zz" not in langid.fit(lied)["languages"]


def test_language_sample_is_bounded_under_a_repeated_id(spark):
    rows = [(0, f"words of copy {i}", "en") for i in range(2000)] + [(None, "no id", "en")] * 500 + [(i, f"own words {i}", "en") for i in range(1, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, each = langid.sample_rows(docs, "doc_id", "text", "lang", 100)
    drawn = [r.id for r in sample.collect()]
    assert each == 100 and 100 <= len(drawn) <= 300 and len(set(drawn)) == len(drawn)


def test_language_edges(spark, docs, none):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model, keep=["doc_id"]).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 7))
    assert langid.fit(none)["languages"] == [] and langid.predict(none, langid.fit(none)).count() == 0


def test_language_stage_rejects_what_it_has_not_learnt(spark, sf):
    import corpus_pipeline

    clean = spark.read.parquet(f"{sf}/documents.parquet")
    strange = ["Вчера вечером мы пошли в театр и смотрели новую пьесу", "Wczoraj wieczorem poszliśmy do teatru obejrzeć nową sztukę", "昨日の夜は友達と一緒に映画を見に行きました", "xkqj zzvw qpfk wvxz jjkq", "### 7 %% w", "12 34", None]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    docs = clean.unionByName(rows, allowMissingColumns=True)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, sf).collect()}
    had = {r.doc_id for r in clean.filter("text RLIKE '\\\\p{L}'").collect()}
    assert min(kept) >= 0 and set(kept) == had


# --- pages


PAGE = (
    "<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t='</p><article>'</script></head><body>"
    "<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class='ad-box'>buy</div><div id=\"cookie-notice\">we</div>"
    "<article class='post'><h1>T&amp;A</h1><p>one <b>bo</b>ld&nbsp;x<br>two<aside>side</aside><p>&lt;three&gt;<form>f</form>"
    "<div class=comments><article>first!</article></div></article><footer>&copy; foot</footer></body></html>"
)


def test_page_text():
    assert html_extract.extract(PAGE, set()) == "T&A one bold x two <three>"
    assert html_extract.extract("<main><p>a<p>b</main><p>c", set()) == "a b"
    assert html_extract.extract("<p>a</p><div class=sidebar>b</div>c < d", set()) == "a c < d"


def test_pages(spark, sf):
    rows = [(1, "http://a.b/1", PAGE), (1, "http://a.b/1", PAGE), (2, None, None), (3, "::bad", ""), (4, "http://a.b/2", "<p>" * 3000 + "x")]
    rows += [(10 + i, "http://t.x/", f"<div>Menu of site</div><p>body {i}</p><div>The end</div>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = collections.Counter((r.page_id, r.text) for r in html_extract.main_text(df).collect())
    assert got[1, "T&A one bold x two <three>"] == 2 and got[2, ""] == 1 and got[3, ""] == 1 and got[4, "x"] == 1
    # without article or main, short texts of the host's template go
    assert got[13, "body 3"] == 1
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in pages.join(html_extract.main_text(pages, keep=["page_id"]), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())


def page_texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extract.main_text(df).orderBy("page_id").collect()]


def test_template_text_inside_an_article_goes(spark):
    own = [f"story {i} of its own words" for i in range(12)]
    pages = [("in.x", f"<body><article><p>{t}</p><div class=zz><a>Send by mail</a></div><p>more {t}</p></article></body>") for t in own]
    # a sentence that some articles share is theirs
    pages += [("some.x", f"<body><main><p>{t}</p><p>{'a common line' if i < 4 else 'line ' + str(i)}</p></main></body>") for i, t in enumerate(own)]
    # copies of an article are no template
    pages += [("copy.x", f"<body><article><h1>one</h1><p>the same words</p></article>{i}</body>") for i in range(5)]
    got = page_texts(spark, pages)
    assert got[:12] == [f"{t} more {t}" for t in own]
    assert got[12:16] == [f"{t} a common line" for t in own[:4]]
    assert got[24:] == ["one the same words"] * 5


def test_template_text_of_any_length_and_layout_goes(spark):
    notice = "Our pages set small files on your machine and you agree to all of it by reading on, whatever you may think."
    layouts = ("<div><p>{t}</p></div><div>{n}</div><div>end {k}</div>", "<section><p>{t}</p><div>{n}</div></section><section>end {k}</section>", "<div>{n}</div><p>{t}</p><div>end {k}</div>")
    own = [f"page {i} has words of its own, which are not those of any other page of this host, number {i}, and they go on for longer than what frames them does" for i in range(12)]
    pages = [("three.x", layouts[i % 3].format(t=t, n=f"{notice} Form {i % 3}.", k=f"of form {i % 3}")) for i, t in enumerate(own)]
    # a page that is there several times makes no template
    pages += [("again.x", "<div>word</div><div>and more words</div>")] * 4
    got = page_texts(spark, pages)
    assert got[:12] == own
    assert got[12:] == ["word and more words"] * 4


# --- all of them on awkward tables


CALLS = {
    "pii": lambda d: pii.summary(d),
    "secrets": lambda d: secret_scan.summary(d),
    "quality": lambda d: quality.assess(d),
    "bpe": lambda d: bpe.encode(d, vocabulary_path()),
    "near": lambda d: near_dedup.classes(d),
    "substrings": lambda d: substring_dedup.dedup(d, bits=16),
    "mixing": lambda d: mixing.mix(d),
    "langid": lambda d: langid.predict(d, langid.fit(d)),
}


@pytest.mark.parametrize("name", CALLS)
def test_every_row_has_a_result(docs, none, name):
    got = CALLS[name](docs)
    assert got.count() == len(ROWS)
    assert len(set(got.columns)) == len(got.columns)
    assert CALLS[name](none).count() == 0


def test_registered_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


def test_empty_batches():
    assert html_extract.page_tokens("") == {}
    assert bpe.encode_rows(*__import__("spanloom.llm.vec", fromlist=["utf8_column"]).utf8_column(pa.array([], pa.string())), bpe.load_vocabulary(vocabulary_path())) == []
