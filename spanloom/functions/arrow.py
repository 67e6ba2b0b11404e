"""Tokens of whole Arrow batches.

The character classes of a batch are looked up in one table, and starts, ends and token
texts follow from where the class changes; nothing loops over tokens. Spark has no running
sum over an array, so the same in built-in expressions copies arrays token by token.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from itertools import groupby

try:  # the built-in digest starts faster on short inputs
    from _sha2 import sha256
except ImportError:
    from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKENS = "array<struct<tok:string,s:int,e:int>>"
LINES = f"array<{TOKENS}>"
WINDOWS = "array<struct<w:int,n_prefix:int,own:array<struct<k:int,first:int,last:int>>,tags:array<int>,mask:array<int>{}>>"
HITS = "array<struct<start:int,end:int,term:string>>"
SPACE, WORD, SIGN = 0, 1, 2
#: Most rows and bytes of one Arrow batch: tokens take many times the room of their texts.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

# White space is Unicode's White_Space property and U+001C to U+001F.
_SPACES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_TABLE: list[np.ndarray] = []
_NUMBERS: list[bytes] = []


def classes() -> np.ndarray:
    """The class of every code point; made once in a worker."""
    if not _TABLE:
        table = np.full(sys.maxunicode + 1, SIGN, np.uint8)
        letters = np.frombuffer("".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))).encode(), np.uint8)[::2]
        table[(letters == ord("L")) | (letters == ord("N"))] = WORD
        table[ord("_")] = WORD
        table[list(_SPACES)] = SPACE
        _TABLE.append(table)
    return _TABLE[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and the byte at which each begins."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if len(starts) == len(data):
        return data.astype(np.uint32), starts
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4"), starts


def split_tokens(column: pa.Array, by_line: bool = False) -> pa.Array:
    """Tokens of every text, or of every line of every text; offsets count code points of the text."""
    column = column.cast(pa.large_string())
    n = len(column)
    filled = column.fill_null("") if column.null_count else column
    if n == 0:
        bounds, data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
    else:
        _, off, raw = filled.buffers()
        bounds = np.frombuffer(off, np.int64, n + 1, filled.offset * 8)
        data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
    points, at = code_points(data)
    rows = np.searchsorted(at, bounds)  # the first code point of each text
    kind = classes()[points] if len(points) else np.zeros(0, np.uint8)
    same = np.zeros(len(kind), bool)
    same[1:] = (kind[1:] == WORD) & (kind[:-1] == WORD)
    same[rows[:-1][rows[:-1] < len(kind)]] = False
    begins = np.flatnonzero((kind != SPACE) & ~same)
    goes_on = np.zeros(len(kind), bool)
    goes_on[:-1] = same[1:]
    ends = np.flatnonzero((kind != SPACE) & ~goes_on) + 1
    first = np.searchsorted(begins, rows)
    base = np.repeat(rows[:-1], np.diff(first))
    # token texts are all bytes that are not white space, in order
    edges = np.append(at, len(data))
    solid = np.repeat(kind != SPACE, np.diff(edges))
    sizes = edges[ends] - edges[begins]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[solid].tobytes()))
    made = pa.StructArray.from_arrays([text, pa.array((begins - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], names=["tok", "s", "e"])
    null = np.asarray(column.is_null())
    if not by_line:
        return listed(first, null, made)
    breaks = np.flatnonzero(points == 0x0A)
    # a line begins with its text or behind a line break
    lines = np.sort(np.concatenate([rows[:-1], breaks + 1]), kind="stable")
    held = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(begins, lines), len(begins)).astype(np.int32)), made)
    per_row = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(breaks, rows)) + 1)]) if n else np.zeros(1, np.int64)
    return listed(per_row, null, held)


def listed(first: np.ndarray, null: np.ndarray, values: pa.Array) -> pa.Array:
    """A list array whose null rows are null."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values, mask=pa.array(null) if null.any() else None)


def limit_batches() -> None:
    """Lower the active session's limits on an Arrow batch to ours; lower ones stay.

    Plans read these settings when they run, so they cannot be set back here.
    """
    spark = SparkSession.getActiveSession()
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)) if spark is not None else ():
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name)).strip()
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def tokens(text: Column) -> Column:
    """Tokens of each text; null for null."""
    limit_batches()
    return F.arrow_udf(lambda c: split_tokens(c), TOKENS)(text)


def line_tokens(text: Column) -> Column:
    """Tokens of each line of each text; null for null."""
    limit_batches()
    return F.arrow_udf(lambda c: split_tokens(c, True), LINES)(text)


def label_runs(column: pa.Array, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, first and last label and type of every span of BIO label lists (``spans.bio_spans``)."""
    bounds = np.asarray(column.offsets).astype(np.int64)
    coded = column.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    # the few different labels are read once, a null label is outside
    read = [(None, "") if x is None or (mode == "strict" and x in ("O", "")) or (mode != "strict" and x[:2] not in ("B-", "I-")) else (x[:2], _type_of(x, mode)) for x in [*coded.dictionary.to_pylist(), None]]
    names = sorted({t for _, t in read})
    code = np.asarray(coded.indices.fill_null(len(read) - 1)).astype(np.int64)
    live = np.array([p is not None for p, _ in read])[code]
    inner = np.array([p == "I-" for p, _ in read])[code]
    kind = np.array([names.index(t) for _, t in read])[code]
    goes_on = np.zeros(len(code), bool)
    goes_on[1:] = live[1:] & inner[1:] & live[:-1] & (kind[1:] == kind[:-1])
    heads = (bounds[:-1] - bounds[0])[np.diff(bounds) > 0]
    goes_on[heads] = False
    first = np.flatnonzero(live & ~goes_on)
    breaks = np.append(np.flatnonzero((live & ~goes_on) | ~live | np.isin(np.arange(len(code)), heads)), len(code))
    last = breaks[np.searchsorted(breaks, first, "right")] - 1
    row = np.searchsorted(bounds - bounds[0], first, "right") - 1
    base = (bounds - bounds[0])[row]
    return row, first - base, last - base, pa.array(names, pa.string()).take(pa.array(kind[first]))


def _type_of(label: str, mode: str) -> str:
    return label[2:] if mode != "strict" or (len(label) > 1 and "A" <= label[0] <= "Z" and label[1] == "-") else label


def bio_spans(labels: Column, mode: str) -> Column:
    """``label_runs`` of each row as array<struct<first,last,type>>; null for null."""

    def run(column: pa.Array) -> pa.Array:
        null = np.asarray(column.is_null())
        row, first, last, kind = label_runs(column, mode)  # a null list is empty here
        made = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), kind], names=["first", "last", "type"])
        return listed(np.searchsorted(row, np.arange(len(column) + 1)), null, made)

    limit_batches()
    return F.arrow_udf(run, "array<struct<first:int,last:int,type:string>>")(labels)


def tag_counts(batches):
    """Of batches (gold labels, predicted labels): key, tp, pred, gold by type; the spans meet within their rows."""
    names: list[str] = []
    for batch in batches:
        sides = []
        for c in batch.columns:
            row, first, last, kind = label_runs(c, "strict")
            coded = kind.dictionary_encode()
            names += [t for t in coded.dictionary.to_pylist() if t not in names]
            code = np.array([names.index(t) for t in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)]
            sides.append(((row << 32) + first, last, code))
        (place, last, code), (place_p, last_p, code_p) = sides
        # spans of one sequence begin at different places, in rising order
        at = np.minimum(np.searchsorted(place_p, place), max(0, len(place_p) - 1))
        same = (place_p[at] == place) & (last_p[at] == last) & (code_p[at] == code) if len(place_p) else np.zeros(len(place), bool)
        counts = [np.bincount(x, minlength=len(names)) for x in (code[same], code_p, code)]
        keys = list(names)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=["key", "tp", "pred", "gold"])


def negative_spans(n_tokens: Column, positive: Column, seed: Column, longest: int, ratio: float) -> Column:
    """Of the token spans of a row that touch no positive one the first max(2, ceil(ratio * positives)) by a digest of seed and place."""

    def some(n: np.ndarray, sizes: np.ndarray, begin: np.ndarray, end: np.ndarray, keys: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first and last token of the drawn spans; the rows are laid out behind each other, so nothing loops over them."""
        base = np.concatenate([[0], np.cumsum(n)])
        row, place = np.repeat(np.arange(len(n)), n), np.arange(base[-1])
        owner = np.repeat(np.arange(len(n)), sizes)
        begin, end = np.clip(begin, 0, n[owner]), np.clip(end + 1, 0, n[owner])
        long = end > begin
        change = np.bincount(base[owner[long]] + begin[long], minlength=base[-1] + 1) - np.bincount(base[owner[long]] + end[long], minlength=base[-1] + 1)
        taken = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
        first = (place - base[row])[:, None]
        at = first * longest + np.arange(longest)
        until = place[:, None] + np.arange(longest) + 1
        free = until <= base[row + 1][:, None]
        free &= taken[np.minimum(until, base[-1])] == taken[place][:, None]
        # the seed's digest, mixed with the place (splitmix64)
        h = np.array([int.from_bytes(sha256((k or "").encode()).digest()[:8]) for k in keys], np.uint64)[row][:, None] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        count = np.bincount(row, free.sum(axis=1), minlength=len(n))
        wanted = np.minimum(np.maximum(2, np.ceil(sizes * ratio)), count)
        # only digests below a bound that nearly always lets enough through are sorted
        bound = np.minimum((wanted * 3 + 20) / np.maximum(count, 1), 1.0)
        while True:
            low = free & (h.astype(np.float64) <= (bound * 2.0**64)[row][:, None])
            short = np.bincount(row, low.sum(axis=1), minlength=len(n)) < wanted
            if not short.any():
                break
            bound[short] = 1.0
        x, size = np.nonzero(low)
        order = np.lexsort((h[x, size], row[x]))
        x, size = x[order], size[order]
        rank = np.arange(len(x)) - np.searchsorted(row[x], row[x])
        own = rank < wanted[row[x]]
        x, size = x[own], size[own]
        return row[x], x - base[row[x]], x - base[row[x]] + size

    def run(counts: pa.Array, positives: pa.Array, seeds: pa.Array) -> pa.Array:
        n, sizes, held = np.asarray(counts.fill_null(0)).astype(np.int64), lengths(positives), positives.flatten()
        begin, end = (np.asarray(c.fill_null(0)).astype(np.int64) for c in held.flatten())
        edges, keys, out = np.concatenate([[0], np.cumsum(sizes)]), seeds.to_pylist(), []
        with np.errstate(over="ignore"):
            for i in range(0, len(n), 256):
                part = slice(edges[i], edges[min(i + 256, len(n))])
                row, first, last = some(n[i : i + 256], sizes[i : i + 256], begin[part], end[part], keys[i : i + 256])
                out.append((row + i, first, last))
        row, first, last = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in out]]).astype(np.int32) for k in range(3))
        made = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], names=["first", "last"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)), made)

    limit_batches()
    return F.arrow_udf(run, "array<struct<first:int,last:int>>")(n_tokens, positive, seed)


def find_terms(texts: list[str | None], lexicon: tuple[str, ...], most: int, least: int = 3) -> list[list[dict] | None]:
    """Word-bounded hits of a lexicon's terms, in the order of the lexicon, none touching an earlier one.

    One automaton finds all places of all terms in one pass. A place that begins
    inside the last one of the same term is none, even where that was no whole word.
    """
    if _AUTOMATON.get("lexicon") != lexicon:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, term in enumerate(lexicon):
            if term and len(term) >= least:
                machine.add_word(term, (i, len(term)))
        if len(machine):
            machine.make_automaton()
        _AUTOMATON.update(lexicon=lexicon, machine=machine)
    machine, table, out = _AUTOMATON["machine"], classes(), []
    word = lambda c: table[ord(c)] == WORD
    for text in texts:
        if text is None:
            out.append(None)
            continue
        places: dict[int, list[tuple[int, int]]] = {}
        for last, (i, n) in machine.iter(text) if len(machine) else ():
            places.setdefault(i, []).append((last + 1 - n, last + 1))
        taken: list[tuple[int, int, str]] = []
        for i in sorted(places):
            if len(taken) >= most:
                break
            before, end = len(taken), -1
            for s, e in places[i]:
                if s < end:
                    continue
                end = e
                cut = (s > 0 and word(text[s - 1]) and word(text[s])) or (e < len(text) and word(text[e - 1]) and word(text[e]))
                if not cut and not any(a < e and s < b for a, b, _ in taken[:before]):
                    taken.append((s, e, lexicon[i]))
        out.append([{"start": s, "end": e, "term": t} for s, e, t in taken[:most]])
    return out


_AUTOMATON: dict = {}


def lexicon_hits(text: Column, terms: Column, most: int) -> Column:
    """``find_terms`` of each row's text and terms; a lexicon that does not change is prepared once."""

    def run(texts: pa.Array, lexicons: pa.Array) -> pa.Array:
        rows, out, a = lexicons.to_pylist(), [], 0
        values = texts.to_pylist()
        while a < len(rows):
            b = a + 1
            while b < len(rows) and rows[b] == rows[a]:
                b += 1
            out += find_terms(values[a:b], tuple(rows[a] or ()), most)
            a = b
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))
        return pa.array(out, kind)

    limit_batches()
    return F.arrow_udf(run, HITS)(text, terms)


def digests(prefix: str, n: int) -> np.ndarray:
    """For i below n the first 8 hex digits of sha256 of ``prefix:i`` as a number, as ``core.hash_int`` gives them."""
    start = f"{prefix}:".encode()
    if not _NUMBERS:
        _NUMBERS.extend(b"%d" % i for i in range(1 << 15))
    made = b"".join([sha256(start + x).digest() for x in _NUMBERS[:n]] + [sha256(start + b"%d" % i).digest() for i in range(len(_NUMBERS), n)])
    return np.frombuffer(made, ">u4").reshape(-1, 8)[:, 0].astype(np.int64)


def hash_ints(prefix: Column, n: Column) -> Column:
    """``digests`` of each row as array<long>; drawn once, also where a plan names the result more often."""

    def run(prefixes: pa.Array, counts: pa.Array) -> pa.Array:
        sizes = counts.fill_null(0).to_pylist()
        made = [digests(p, k) for p, k in zip(prefixes.to_pylist(), sizes)]
        values = np.concatenate(made) if made else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))

    limit_batches()
    return F.arrow_udf(run, "array<long>").asNondeterministic()(prefix, n)


def lengths(lists: pa.Array) -> np.ndarray:
    """The sizes of lists, 0 for null."""
    return np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64)


def numbers(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of groups of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def headers(text: str, ats: list[int]) -> list[tuple[int, int] | None]:
    """``text.nearest_header`` before each offset: where its line begins and ends."""
    if not _HEADER:
        blank = "".join(map(chr, _SPACES))
        _HEADER.append(re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"))
        _HEADER.append(re.compile(rf"[{blank}]*(?:\d+[{blank}]*[.)]|[A-ZÀ-Ỹ][^.!?]{{0,80}}:?[{blank}]*\Z)"))
    breaks, opens = _HEADER
    begins, titles = [0], []
    for m in breaks.finditer(text):
        if opens.match(text, begins[-1], m.start()):
            titles.append((begins[-1], m.start()))
        begins.append(m.end())
    ends, out = [x[1] for x in titles], []
    for at in ats:
        begin, before = begins[bisect_right(begins, at) - 1], bisect_left(ends, at)
        out.append((begin, at) if opens.match(text, begin, at) else titles[before - 1] if before else None)
    return out


#: The patterns of ``headers``, made once in a worker: line breaks, and lines that open a section or look like a title.
_HEADER: list[re.Pattern] = []


def training_windows(text: Column, places: Column, id: Column, seed: int, o_keep: float, header_dropout: float, empty_keep: float, size: int, overlap: int, context: int, words: bool) -> Column:
    """The windows of each text that training keeps (``windows.training_rows``), cut where the text is split into tokens.

    places: array<struct<start,end,named>> of the entities. A window has its number ``w``, the size
    of its prefix, its ``own`` entities (number in the record, first and last token in the window), for
    each token the number of its entity in ``own`` (0 for none, 2k + 1 where entity k begins, 2k + 2
    inside) and its loss; with ``words`` also tokens and offsets, those of the prefix first. A header's
    offsets count from where it begins.
    """
    unit = lambda key: int.from_bytes(sha256(key.encode()).digest()[:4]) / 4294967295.0
    step = size - overlap

    def run(texts: pa.Array, entities: pa.Array, ids: pa.Array) -> pa.Array:
        toks = split_tokens(texts)
        bounds = np.asarray(toks.offsets).astype(np.int64)
        s, e = (np.asarray(toks.values.field(x)).astype(np.int64) for x in ("s", "e"))
        n, rows = np.diff(bounds), np.arange(len(texts))
        count = np.where(n > 0, np.maximum(0, -((size - n) // step)) + 1, 0)
        row, w = np.repeat(rows, count), numbers(count)
        first = w * step
        here, before = np.minimum(size, n[row] - first), np.minimum(context, first)
        # entities whose edges are edges of tokens, in each window that holds them whole
        sizes = lengths(entities)
        begin, end, named = (np.asarray(c.fill_null(x)) for c, x in zip(entities.flatten().flatten(), (-1, -1, False)))
        of, k, tok_row = np.repeat(rows, sizes), numbers(sizes), np.repeat(rows, n) << 32

        def found(edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, wanted = tok_row + edges, (of << 32) + at
            i = np.searchsorted(keys, wanted)
            return i - bounds[of], np.append(keys, -1)[i] == wanted if len(keys) else np.zeros(len(wanted), bool)

        (a, has_a), (b, has_b) = found(s, begin), found(e, end)
        low, high = np.maximum(0, -((size - 1 - b) // step)), np.minimum(a // step, count[of] - 1)
        times = np.where(has_a & has_b & (b >= a), np.maximum(0, high - low + 1), 0)
        x = np.repeat(np.arange(len(of)), times)
        window = (np.cumsum(count) - count)[of[x]] + low[x] + numbers(times)
        order = np.lexsort((k[x], window))
        x, window = x[order], window[order]
        per_window = np.bincount(window, minlength=len(row))
        names = ids.to_pylist()
        keys = [f"{seed}:{y}" if names[r] is None else f"{seed}:{names[r]}:{y}" for r, y in zip(row.tolist(), w.tolist())]
        kept = np.flatnonzero([c > 0 or unit(f"{key}:empty") < empty_keep for c, key in zip(per_window.tolist(), keys)])
        own_at = np.searchsorted(kept, window)  # windows with an entity are all kept
        row, w, first, here, before, per_window, keys = row[kept], w[kept], first[kept], here[kept], before[kept], per_window[kept], [keys[i] for i in kept.tolist()]
        own_first, own_last = a[x] - first[own_at], b[x] - first[own_at]
        # the first entity of a token gives its tag: written last
        edges = np.concatenate([[0], np.cumsum(here)])
        spread = (own_last - own_first + 1)[::-1]
        inside = numbers(spread)
        code = np.where(np.repeat(named[x][::-1], spread), np.repeat(2 * numbers(per_window)[::-1], spread) + np.where(inside == 0, 1, 2), 0)
        tags = np.zeros(edges[-1], np.int32)
        tags[np.repeat((edges[own_at] + own_first)[::-1], spread) + inside] = code
        mask = tags > 0
        for i, key in enumerate(keys):
            mask[edges[i] : edges[i + 1]] |= digests(key, int(here[i])) / 4294967295.0 < o_keep
        # the first window has no line before it
        head, n_head = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        asked = [i for i in np.flatnonzero(w > 0).tolist() if unit(f"{keys[i]}:header") >= header_dropout]
        said = pc.binary_join(pa.ListArray.from_arrays(toks.offsets, toks.values.field("tok")), "\x1f") if asked else None
        for r, group in groupby(asked, lambda i: row[i]):
            group, own, joined = list(group), s[bounds[r] : bounds[r + 1]], said[r].as_py()
            at = np.concatenate([[0], np.cumsum(e[bounds[r] : bounds[r + 1]] - own + 1)])
            for i, line in zip(group, headers(texts[r].as_py(), own[first[group]].tolist())):
                if line is not None:
                    h, until = np.searchsorted(own, line)
                    seen = joined[at[first[i] - before[i]] : at[first[i] + here[i]] - 1]
                    if f"\x1f{joined[at[h] : at[until] - 1]}\x1f" not in f"\x1f{seen}\x1f":
                        head[i], n_head[i] = h, until - h
        int_ = lambda c: pa.array(c.astype(np.int32))
        own_list = pa.ListArray.from_arrays(int_(np.concatenate([[0], np.cumsum(per_window)])), pa.StructArray.from_arrays([int_(k[x]), int_(own_first), int_(own_last)], names=["k", "first", "last"]))
        flat = [pa.ListArray.from_arrays(int_(edges), int_(c)) for c in (tags, mask)]
        names = ["w", "n_prefix", "own", "tags", "mask"]
        if words:
            sizes, begins = (np.stack(c, axis=1).ravel() for c in ((n_head, before + here), (bounds[row] + head, bounds[row] + first - before)))
            i, edges = np.repeat(begins, sizes) + numbers(sizes), int_(np.concatenate([[0], np.cumsum(n_head + before + here)]))
            base = np.repeat(np.where(np.arange(len(sizes)) % 2 == 0, np.append(s, 0)[begins], 0), sizes)
            pairs = pa.ListArray.from_arrays(int_(np.arange(len(i) + 1) * 2), int_(np.stack((s[i] - base, e[i] - base), axis=1).ravel()))
            flat += [pa.ListArray.from_arrays(edges, c) for c in (toks.values.field("tok").take(pa.array(i)), pairs)]
            names += ["tokens", "char_offsets"]
        made = pa.StructArray.from_arrays([int_(w), int_(n_head + before), own_list, *flat], names=names)
        return pa.ListArray.from_arrays(int_(np.searchsorted(row, np.arange(len(texts) + 1))), made)

    limit_batches()
    kind = WINDOWS.format(",tokens:array<string>,char_offsets:array<array<int>>" if words else "")
    return F.arrow_udf(run, kind).asNondeterministic()(text, places, id)


# workers get this module by value and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
