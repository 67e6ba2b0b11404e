"""The corpus operators on inputs that their methods are about: colliding words, layouts, rounds, distances."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import html_extract, langid, mixing, near_dedup, quality, secret_scan, substring_dedup, topk, vec
from spanloom.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- hashes


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n]


def flipped(s):
    return s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [256, 1024, 4096])
def test_words_that_defeat_polynomial_hashes(n):
    word = thue_morse(n)
    data, offsets = vec.utf8_column(pa.array([f"{word} {flipped(word)}"]))
    starts, ends, first = vec.word_bounds(data, offsets)
    for seed in (1, 99):
        a, b = vec.word_hashes(data, starts, ends, seed)
        assert a != b
    # the same order of words in a text, and in all windows of it
    data, offsets = vec.utf8_column(pa.array([" ".join(word), " ".join(flipped(word))]))
    starts, ends, first = vec.word_bounds(data, offsets)
    words = vec.word_hashes(data, starts, ends)
    assert len(set(vec.sequence_hashes(words, first).tolist())) == 2
    tokens = word + flipped(word)
    for size in (1, 5, 25, 50, 75):
        of = {}
        row, at = vec.window_starts(first, size)
        for h, i in zip(vec.window_hashes(words, at, size).tolist(), at.tolist()):
            assert of.setdefault(tokens[i : i + size], h) == h
        assert len(set(of.values())) == len(of)


def test_colliding_words_do_not_join_texts(spark):
    rows = []
    for k, n in enumerate((1024, 4096)):
        word = thue_morse(n)
        words = [f"w{i}" for i in range(60)]
        rows += [(4 * k, " ".join([*words[:30], word, *words[31:]])), (4 * k + 1, " ".join([*words[:30], flipped(word), *words[31:]])), (4 * k + 2, word), (4 * k + 3, flipped(word))]
    rows = [r for r in rows if r[0] in (0, 1, 2, 3)] + [(10 + i, t) for i, t in rows[4:]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.dedup(df.filter("doc_id < 2"), bits=16, keep=["doc_id"]).collect()}
    assert got[1].n_removed == 0 and got[0].n_removed == 0
    found = {r.doc_id: r for r in near_dedup.classes(df).collect()}
    assert all(r.text_id == r.doc_id for r in found.values())


def test_substrings_by_a_shuffled_index(spark, monkeypatch):
    rng = random.Random(1)
    shared = [f"s{rng.randint(0, 9)}" for _ in range(80)]
    rows = [(i, " ".join([f"u{i}-{k}" for k in range(rng.randint(0, 20))] + (shared if i % 3 == 0 else []))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, substring_dedup.dedup(df, bits=16, keep=["doc_id"]).collect()))
    monkeypatch.setattr(substring_dedup, "MOST_ROUNDS", 0)
    assert sorted(map(tuple, substring_dedup.dedup(df, bits=16, keep=["doc_id"]).collect())) == want
    assert sum(r[2] for r in want) == 9 * 80


# --- families that are large and loose


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize("copies", [0, 8])
def test_families_around_a_common_passage(spark, monkeypatch, copies):
    """Texts that a common passage joins, with groups of near copies among them; hubs and cells find the same classes."""
    monkeypatch.setattr(near_dedup, "COPIES", copies)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for group in range(12):
        own = [f"g{group}-{i}" for i in range(50)]
        for copy in range(4):
            words = list(own)
            words[rng.randrange(50)] = f"x{group}-{copy}"
            rows.append((len(rows), " ".join(passage + words)))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), tile=6).collect()}
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in sets}


# --- pages


WRAPPED = [
    ('<article class="post tag-social"><p>Real text here.</p></article>', "Real text here."),
    ('<div id="wrap" class="has-sidebar"><main><p>x y</p></main><div class=sidebar>no</div></div>', "x y"),
    ('<article class="post comments-open"><p>z</p></article>', "z"),
    ("<main><p>Intro</p><article><p>card</p></article><p>Rest</p></main>", "Intro card Rest"),
    ("<main><article><p>long article text</p></article><div>rel</div></main>", "long article text"),
    ('<body class="has-sidebar"><div class="page has-sidebar"><p>all</p><p>text</p></div></body>', "all text"),
    ('<div class="has-sidebar"><article><p>art</p></article></div><div class=comments><article>c</article></div>', "art"),
    ("<article>one</article><div class=comments><article>first</article></div>", "one"),
    ("", ""),
    ("<nav>a</nav><footer>b</footer>", ""),
]


@pytest.mark.parametrize("page,text", WRAPPED)
def test_no_name_empties_a_wrapper(page, text):
    assert html_extract.extract(page, set()) == text


def pages_of(spark, pages):
    return spark.createDataFrame([(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)], "page_id long, url string, html string")


def test_neutral_hosts_extract_exactly(spark):
    """Hosts without any telling name: what is left is each page's own text."""
    rng = random.Random(3)
    pages, want = [], []
    for host, layout in enumerate(("<div class=a1>{m}</div><div class=b2><p>{t}</p></div><div class=c3>{n}</div>", "<section>{t}</section><section class=q>{m}<br>{n}</section>", "<div><div>{m}</div><div>{t}</div><div>{n}</div></div>")):
        menu, note = f"Start Shop{host} Contact us", f"All rights of host {host} are kept and " * 4
        for i in range(8):
            own = " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}" for _ in range(60))
            pages.append((f"h{host}.x", layout.format(m=menu, n=note, t=own)))
            want.append(own)
    got = [r.text for r in html_extract.main_text(pages_of(spark, pages)).orderBy("page_id").collect()]
    assert got == want


def test_template_is_ordered_and_nested(spark):
    """Texts that change places form chains of their own; a frame around a frame is kept."""
    pages = []
    for i in range(10):
        items = ["<p>alpha fixed</p>", f"<p>own {i} words</p>"]
        if i % 2:
            items.reverse()
        pages.append(("n.x", f"<div class=o>outer top</div><div class=i>inner top</div>{items[0]}{items[1]}<div class=i2>inner end</div><div class=o2>outer end</div>"))
    df = pages_of(spark, pages).select("url", "html")
    rows = html_extract.templates(df).collect()
    chains = collections.defaultdict(list)
    for r in rows:
        chains[r.chain].append((r["at"], r.token, r.place, r.slots))
    texts = [c for c in chains.values() if any(place for _, _, place, _ in c)]
    # one chain holds the four fixed frame texts in order; the moving one is in none with them
    assert max(sum(place != 0 for _, _, place, _ in c) for c in texts) >= 4
    assert all(sorted(a for a, *_ in c) == list(range(1, len(c) + 1)) for c in chains.values())
    assert html_extract.crossings([1, 2, 3, 4], {1: (1, 1, 2), 3: (1, 2, 2), 2: (2, 1, 2), 4: (2, 2, 2)}) == {1: [0, 0], 2: [2, html_extract.crossings([1, 2], {1: (1, 1, 2), 2: (2, 1, 2)})[2][1]]}


def test_pages_with_clashing_columns_and_long_text(spark):
    long_ = "word " * 60_000
    df = spark.createDataFrame([(1, "http://a/1", f"<article>{long_}</article>", "u", "h"), (2, None, None, "u", None)], "page_id long, url string, html string, host string, k0 string")
    got = {r.page_id: r for r in html_extract.main_text(df).collect()}
    assert got[1].text == long_.strip() and got[2].text == "" and got[1].host == "u" and got[1].k0 == "h"


# --- search


def test_top_k_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "FIRST", 2)
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.1, -0.2, 0.0, 0.31]) for _ in range(5)]) for i in range(900)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, row string, shard int")
    got = sorted(map(tuple, topk.top_k(df, lambda v: v % 50 == 0, k=9).collect()))
    v = {i: np.floor(64 * np.array(e, np.float32).astype(float)).astype(int) for i, e in rows}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:9]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_keeps_every_row_of_an_id(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [2.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, lambda v: v % 20 == 0, k=5).collect()))
    # both rows of id 20 are queries, and candidates of each other
    assert got == sorted([(20, 1, 21, 128 * 64), (20, 2, 20, 0)] * 2)


# --- mix


def test_rates_solve_the_clipped_dual(spark):
    rng = random.Random(5)
    rows = []
    for source, n, top in (("a", 40, 30), ("b", 300, 200), ("c", 200, 50), (None, 20, 9)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randint(0, top)), source) for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for own in by.values():
        size, rate = np.array([r["size"] for r in own], float), np.array([r.rate for r in own])
        assert abs((size * rate).sum() - own[0].target) <= 1e-5 * own[0].target
        assert rate.max() <= 3 and rate.min() >= 0
        if own[0].target < 3 * size.sum() * (1 - 1e-9):
            # one multiplier for the source: ln(rate) is linear in the size where the limit does not hold
            free = (rate < 3 * (1 - 1e-12)) & (size > 0)
            tilt = np.log(rate[free]) / size[free]
            assert np.allclose(tilt, tilt[0], rtol=1e-6)
            low, high = -50.0, 50.0
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if (size * np.minimum(3, np.exp(np.minimum(700, mid * size)))).sum() < own[0].target else (low, mid)
            assert tilt[0] == pytest.approx(mid, rel=1e-4, abs=1e-9)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(210, 0.05 * own[0].target)


def test_taken_rows_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 7, 8, "r"), (1, "a b", "s", 7, 8, "r"), (None, None, None, 1, 1, None)], "doc_id long, text string, source string, size__mix int, copies int, row string")
    got = mixing.take(df)
    assert got.columns == df.columns and got.count() >= 3
    assert mixing.take(df.limit(0)).count() == 0


# --- secrets


def test_links_at_every_distance(spark):
    """Random parts at all distances around the scope, over the edges of its bins, against brute force."""
    rng = random.Random(6)
    scope = secret_scan.SCOPE
    rows = []
    for i in range(400):
        base = rng.randint(0, 3 * scope)
        kinds = rng.sample(["token", "identifier", "endpoint", "access"], rng.randint(2, 4))
        at, parts = base, []
        for kind in kinds:
            parts.append((i, kind, {"token": "secret", "identifier": "identifier", "endpoint": "endpoint", "access": "identifier"}[kind], at, at + 5, kind == "access"))
            at += rng.choice([1, 5, scope - 1, scope, scope + 1, rng.randint(0, 2 * scope)])
        rows += parts
    df = spark.createDataFrame(rows, "key int, kind string, role string, start int, end int, base boolean")
    got = {(r.key, r.kind, r.start) for r in secret_scan.link(df, ["key"]).collect()}
    want = set()
    for i, kind, role, start, _, base in rows:
        if not base:
            near = {r for k, _, r, s, _, _ in rows if k == i and abs(s - start) <= scope and r != role}
            if any(set(needed) <= near for needed in secret_scan.LINKS[kind]):
                want.add((i, kind, start))
    assert got == want and len(want) > 100


def test_redaction_of_clashing_columns(spark):
    df = spark.createDataFrame([("key token = abcdefgh!", "mine"), (None, "x")], "text string, spans__found string")
    got = {tuple(r) for r in secret_scan.redact(df).collect()}
    assert got == {("key [SECRET]!", "mine"), (None, "x")}
    assert secret_scan.redact(df.limit(0)).count() == 0


# --- the pipeline


DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus(spark, sf):
    """Documents of the smallest scale with nulls, empty, long and repeated rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit("e"))
    odd = [(-1, None, None, None, None, None), (-2, "", "en", "src0", 0, "x"), (-3, "word " * 30_000, "en", None, 150_000, "x"), (None, "the cat sat on the mat of the house and it was the end of that", "en", "src1", 20, None)]
    return docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "extra").unionByName(spark.createDataFrame(odd, DOCS)).unionByName(docs.limit(3).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "extra"))


def test_pipeline_stages_one_by_one(spark, sf):
    """Every stage on odd rows against what its brute-force version keeps."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = corpus(spark, sf).persist()
    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "bpe"]
    kept = p.identify_language(spark, docs, sf).persist()
    assert kept.columns == docs.columns
    rows = [r.text for r in kept.collect()]
    assert None not in rows and "" not in rows and all(any(map(str.isalpha, t)) for t in rows)
    clean = docs.filter("text IS NOT NULL").filter(F.col("text").rlike(r"\p{L}")).count()
    assert kept.count() >= clean - 2  # a text of one word, repeated, may be like no language

    lone = p.drop_near_duplicates(spark, kept, sf).persist()
    by_id = collections.defaultdict(list)
    for r in kept.collect():
        by_id[r.doc_id].append(r.text)
    left = {r.doc_id for r in lone.collect()}
    sets = {i: shingles(ts[0]) or {tuple(WORD.findall(ts[0]))} for i, ts in by_id.items() if i is not None}
    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            assert b not in left or a not in left
    alone = {i for i in sets if not any(i != j and jaccard(sets[i], sets[j]) >= 0.8 for j in sets)}
    assert alone <= left and None in left and lone.columns == docs.columns

    safe = p.remove_secrets(spark, lone, sf).persist()
    pattern = re.compile(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    assert safe.count() == lone.count() and not any(pattern.search(r.text) for r in safe.collect())
    assert all(r.n_chars == len(r.text) for r in safe.collect())

    mixed = p.mix_sources(spark, safe, sf).persist()
    sizes = {tuple(r): len(WORD.findall(r.text)) for r in safe.collect()}
    taken = collections.Counter(tuple(r) for r in mixed.collect())
    assert set(taken) <= set(sizes) and max(taken.values()) <= 3 * max(collections.Counter(tuple(r) for r in safe.collect()).values())

    coded = p.encode_texts(spark, mixed, sf).collect()
    ref = Tokenizer.from_file(vocabulary_path())
    texts = collections.Counter((r.doc_id, tuple(ref.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist())) for r in coded) == texts


def test_pipeline_on_an_empty_table(spark, sf):
    import corpus_pipeline as p

    docs = corpus(spark, sf).limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_values_on_very_long_texts(spark):
    """Long rows through the row-wise operators, by value."""
    text = "Alpha beta, gamma. " * 20_000
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    q = quality.assess(df).select("quality.*").first()
    assert q.n_words == 60_000 and q.n_repeat_words == 60_000 and q.n_dup_lines == 0
    packed = langid.sparse_counts(pa.array([text, text[: len(text) // 2]]))
    one, two = (langid.unpack(x) for x in packed.to_pylist())
    assert np.array_equal(one[0], two[0]) and np.allclose(one[1], two[1], atol=1e-4)
