"""Language identification: family first, then one-versus-one machines within it.

Features are relative frequencies of hashed byte n-grams (one to three bytes) of the
letters of a text, lower-cased, with every run of other characters as one space. A
first layer of linear support vector machines tells the language families apart,
one machine for each pair of families; within the family that wins, one machine for each
pair of its languages votes. Machines are linear and features are frequencies, so
a score is the mean of one weight for each n-gram: a gather and a sum over the whole
text, of any length.

The machines learn from a bounded sample of labelled rows. Its features are
computed on the executors and only their bounded sparse counts reach the driver,
where stochastic subgradient steps in a fixed order fit the weights.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, quoted
from .vec import row_chunks, utf8_column

#: Hash buckets of the n-grams, and the bounds on the sample: rows for each language, languages, all rows.
BUCKETS, PER_LANGUAGE, MOST_LANGUAGES, MOST_ROWS = 1 << 14, 400, 200, 10_000
#: Passes over the sample, and the strength of the regulariser.
PASSES, STRENGTH = 6, 1e-4
UNKNOWN = "und"
#: Least and largest bound on the share of three-byte n-grams that a text of a language may have and its sample not.
UNSEEN_LEAST, UNSEEN_MOST = 0.3, 0.9

# Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz tk",
    "indo-aryan": "hi bn ur mr gu pa ne",
    "semitic": "ar he mt am",
}


def family_of(language: str) -> str:
    for family, codes in FAMILIES.items():
        if language.split("-")[0].lower() in codes.split():
            return family
    return language


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case with spaces for what is no letter.

    Two-byte letters of Latin, Greek and Cyrillic are lowered by their second byte;
    other bytes of 0x80 and more stay.
    """
    table = np.full(256, 0x20, np.uint8)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    out = table[data]
    upper = np.zeros(len(data), bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[upper] += 0x20
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram, the first n-gram of each row (n + 1 long), and the letters of each row.

    Each row is followed by one space, and runs of spaces are one.
    """
    n = len(offsets) - 1
    sized = np.diff(offsets)
    # every row gets a space before and behind it
    total = len(data) + 2 * n
    place = offsets + 2 * np.arange(n + 1)
    text = np.full(total, 0x20, np.uint8)
    shift = np.repeat(2 * np.arange(n) + 1, sized)
    text[np.arange(len(data)) + shift] = folded(data)
    blank = text == 0x20
    keep = np.ones(total, bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[place[:-1]] = True  # each row starts with its own space
    row_of = np.cumsum(keep)
    first = np.concatenate([[0], row_of[place[1:] - 1]]) if n else np.zeros(1, np.int64)
    text, blank = text[keep], blank[keep]
    solid = np.concatenate([[0], np.cumsum(~blank)])
    letters = solid[first[1:]] - solid[first[:-1]]
    a = text.astype(np.uint32)
    b = np.append(a[1:], np.uint32(0x20))
    c = np.append(b[1:], np.uint32(0x20))
    mix = lambda x: ((x * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int32)
    assert BUCKETS == 1 << 14
    return np.stack([mix(a + np.uint32(1 << 24)), mix((a << 8) + b + np.uint32(2 << 24)), mix((a << 16) + (b << 8) + c)]), first, letters


def has_letter(column) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    found = pc.match_substring_regex(column, r"\p{L}")
    return found.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def sparse_counts(column) -> pa.Array:
    """Frequencies of each text as (bucket, share) pairs packed in binary; at most BUCKETS pairs."""
    data, offsets = utf8_column(column)
    out = []
    for i, j in row_chunks(offsets):
        codes, first, _ = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for x, y in zip(first[:-1], first[1:]):
            count = np.bincount(codes[:, x:y].ravel(), minlength=BUCKETS)
            at = np.flatnonzero(count)
            share = (count[at] / max(1, count.sum())).astype("<f4")
            out.append(at.astype("<u2").tobytes() + share.tobytes())
    return pa.array(out, pa.binary())


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 6
    return np.frombuffer(packed, "<u2", n).astype(np.int64), np.frombuffer(packed, "<f4", n, 2 * n).astype(np.float64)


def fit_machine(samples: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, passes: int = PASSES, strength: float = STRENGTH) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine; the same sample gives the same machine.

    Subgradient steps on the hinge loss of unit-length rows, averaged over the
    last half of the steps; each side weighs one half however many rows it has.
    """
    w, total, scale = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 1.0
    order = np.random.default_rng(7)
    weight = {s: len(signs) / (2 * max(1, int((signs == s).sum()))) for s in (1, -1)}
    unit = [(np.append(at, BUCKETS), np.append(x / max(1e-12, float(np.sqrt(x @ x))), 0.2)) for at, x in samples]
    steps, t = passes * len(unit), 0
    kept = 0
    for _ in range(passes):
        for i in order.permutation(len(unit)).tolist():
            t += 1
            rate = 1.0 / (strength * (t + 1.0 / strength))
            at, x = unit[i]
            margin = signs[i] * scale * float(w[at] @ x)
            scale *= 1 - rate * strength
            if margin < 1:
                w[at] += rate * signs[i] * weight[int(signs[i])] / scale * x
            if 2 * t > steps and t % 16 == 0:
                total += scale * w
                kept += 1
    mean = total / max(1, kept)
    return mean[:BUCKETS], 0.2 * float(mean[BUCKETS])


def sample_rows(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> tuple[DataFrame, int] | None:
    """(id, lang, draw, text) of about twice the rows wanted, and how many of each language to take by ``draw``.

    A null id draws by its text. Rows of one draw are one row, so that a repeated id
    cannot swell the sample; the rate rests on distinct draws for the same reason.
    """
    c = lambda name: F.col(quoted(name))
    usable = docs.filter(c(lang).isNotNull() & c(text).isNotNull() & ~held_out(c(doc_id)))
    seed = F.when(c(doc_id).isNotNull(), F.xxhash64(c(doc_id), F.lit("sample"))).otherwise(F.xxhash64(c(text), F.lit("sample")))
    drawn = usable.select(F.pmod(seed, F.lit(1 << 30)).alias("draw"), c(lang).alias("lang"), c(doc_id).alias("id"), c(text).alias("text"))
    counts = drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("draw").alias("draws"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    per_language = max(20, min(per_language, MOST_ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * per_language / r["draws"]))])
    wanted = drawn.filter(F.col("draw") < share[F.col("lang")] * (1 << 30))
    rows = wanted.groupBy("lang", "draw").agg(F.min(F.struct("id", "text")).alias("x"))
    return rows.select("x.id", "lang", "draw", "x.text"), per_language


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> dict:
    """The model: languages by family and a machine for each pair.

    Learns from rows with a text and a language that are not held out, at most
    ``per_language`` of each language, drawn by the hash of their id, and the
    MOST_LANGUAGES most frequent languages; with many languages fewer rows of each,
    MOST_ROWS in all. Rows of one language that share an id, and copies among rows
    without an id, enter once. Without such rows the model is empty.
    """
    sample = sample_rows(docs, doc_id, text, lang, per_language)
    if sample is None:
        return {"languages": [], "machines": {}, "seen": {}, "limits": {}}
    sample, per_language = sample
    packed = map_columns(sample, lambda x: [sparse_counts(x)], ["text"], [T.StructField("packed", T.BinaryType())], ["id", "lang", "draw"])
    rows = sorted(packed.collect(), key=lambda r: (r["lang"], r["draw"], str(r["id"]), r["packed"]))
    chosen = [r for _, group in itertools.groupby(rows, key=lambda r: r["lang"]) for r in itertools.islice(group, per_language)]
    languages = sorted({r["lang"] for r in chosen})
    families = sorted({family_of(x) for x in languages})
    samples = [unpack(r["packed"]) for r in chosen]
    tongue = np.array([r["lang"] for r in chosen], object)
    kin = np.array([family_of(r["lang"]) for r in chosen], object)

    def machine(labels: np.ndarray, one: str, other: str):
        own = np.flatnonzero((labels == one) | (labels == other))
        return fit_machine([samples[i] for i in own], np.where(labels[own] == one, 1, -1))

    machines: dict = {}
    for a, b in itertools.combinations(families, 2):
        machines["family", a, b] = machine(kin, a, b)
    for family in families:
        for a, b in itertools.combinations([x for x in languages if family_of(x) == family], 2):
            machines["language", a, b] = machine(tongue, a, b)
    seen, limits = {}, {}
    for x in languages:
        own = [samples[i] for i in np.flatnonzero(tongue == x)]
        rows_with = np.bincount(np.concatenate([at for at, _ in own]), minlength=BUCKETS)
        seen[x] = rows_with > 0
        limits[x] = unseen_limit(own, rows_with)
    return {"languages": languages, "families": families, "machines": machines, "seen": seen, "limits": limits}


def unseen_limit(samples: list[tuple[np.ndarray, np.ndarray]], rows_with: np.ndarray) -> float:
    """The bound for a language: from what each row of its sample has that no other row has.

    The shares cover n-grams of three lengths, nearly all new ones are of the longest.
    """
    alone = [3 * float(x[rows_with[at] == 1].sum()) for at, x in samples]
    return float(np.clip(1.5 * np.quantile(alone, 0.99), UNSEEN_LEAST, UNSEEN_MOST))


def vote(scores: Callable[[str, str], np.ndarray], labels: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The label index that wins most duels (margins break ties) and its weakest duel's margin."""
    if len(labels) < 2:
        return np.zeros(n, int), np.full(n, np.inf)
    wins, sums = np.zeros((len(labels), n)), np.zeros((len(labels), n))
    least = np.full((len(labels), n), np.inf)
    for (i, a), (j, b) in itertools.combinations(enumerate(labels), 2):
        s = scores(a, b)
        for own, margin in ((i, s), (j, -s)):
            wins[own] += margin > 0 if own == i else margin >= 0
            sums[own] += np.tanh(margin)
            least[own] = np.minimum(least[own], margin)
    best = np.argmax(wins + sums / (4 * len(labels)), axis=0)
    return best, least[best, np.arange(n)]


def classify(column, model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and whether the sample of some language has its n-grams."""
    data, offsets = utf8_column(column)
    labels, scores, typical = [], [], []
    machines = list(model["machines"])
    weights = {m: model["machines"][m][0].astype(np.float32) for m in machines}
    for i, j in row_chunks(offsets):
        codes, first, letters = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n, size = j - i, np.diff(first)
        rows = np.repeat(np.arange(n), size)
        # length of the frequency vector, from the counts of distinct (row, bucket) pairs
        length = np.empty(n)
        for r in range(n):
            own = np.bincount(codes[:, first[r] : first[r + 1]].ravel(), minlength=1).astype(np.float64)
            length[r] = np.sqrt(own @ own)
        margins = {}
        for m in machines:
            w = weights[m]
            per = w[codes[0]] + w[codes[1]] + w[codes[2]]
            total = np.bincount(rows, per, n) if len(rows) else np.zeros(n)
            margins[m] = total / np.maximum(length, 1e-12) + model["machines"][m][1]
        if model["languages"]:
            family, firm = vote(lambda a, b: margins["family", a, b], model["families"], n)
            tongue, sure = np.empty(n, object), np.empty(n)
            for f, name in enumerate(model["families"]):
                own = [x for x in model["languages"] if family_of(x) == name]
                best, least = vote(lambda a, b: margins["language", a, b], own, n)
                mine = family == f
                tongue[mine] = np.array(own, object)[best[mine]]
                sure[mine] = np.minimum(firm, least)[mine]
            score = 1 / (1 + np.exp(-2 * np.clip(sure, -30, 30)))
        else:
            tongue, score = np.full(n, UNKNOWN, object), np.zeros(n)
        for r, x in enumerate(tongue.tolist()):
            own = codes[2, first[r] : first[r + 1] - 2]  # those that run into the next row are not its own
            # mostly the first decides; a text given to a wrong language is still one of a learnt language
            typical.append(len(own) > 0 and any(1 - model["seen"][y][own].mean() <= model["limits"][y] for y in (x, *model["languages"]) if y in model["seen"]))
        labels.extend(tongue.tolist())
        scores.append(np.where(letters > 0, score, 0.0))
    known = has_letter(column)
    score = np.concatenate(scores) if scores else np.zeros(0)
    return [x if k else UNKNOWN for x, k in zip(labels, known)], np.where(known, score, 0.0), known & np.array(typical, bool)


def predict(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None, typical: str | None = None) -> DataFrame:
    """Append lang_pred and score (0 to 1) of each whole text.

    A text that is null or has no letter gets ``und`` and score 0, as does every
    text if the model is empty. Rows are independent: repeated rows give repeated
    results, an empty table an empty one. A very long text counts whole; ties between
    languages go to the first by name. Columns with these names are replaced.
    ``typical`` names a further column: whether the n-grams of the text are those of
    some language's sample. The score only compares languages with each other, so a
    text in none of them can score high.
    """

    def run(column):
        labels, scores, known = classify(column, model)
        return [pa.array(labels, pa.string()), pa.array(scores, pa.float64()), *([pa.array(known, pa.bool_())] if typical else [])]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    fields += [T.StructField(typical, T.BooleanType())] if typical else []
    return map_columns(docs, run, [text], fields, docs.columns if keep is None else keep)
