"""Substring dedup with fixed-block anchors.

A window is ``window`` consecutive words of one document. A word goes when a window
that covers it also starts in a document with a smaller id. Any window holds a whole
reference block of ``block`` words (window >= 2 * block - 1), where reference blocks
do not overlap and start at every document's first word. So:

1. Every document's blocks enter the index.
2. Every rolling window of ``block`` words of every document probes it. Probes that
   cannot hit are held back by a bit array of fixed size (a Bloom filter; it lets
   some misses pass and never holds back a hit). If the blocks are too many for one
   array, the index is probed in several rounds, each over a part of the hashes; if they
   are too many for ``MOST_ROUNDS`` arrays, all probes are joined with the index instead.
3. Hits that blocks of several documents share are extended: the words around them,
   ``window - block`` on either side, form their context. A hit whose whole context
   also stands in a smaller document is a repeat as it is. Where contexts differ,
   all windows through the hit are compared one by one.
4. The windows found cover the words that go.

Hashes of blocks and of contexts are independent, each built by a pseudo-random
function of every byte and its place, so equality rests on 128 bits without algebra
between them that some texts could undo.
Text never travels through a shuffle unless the removed places outgrow ``BROADCAST``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import limit_batches, map_columns, materialise, quoted, released, size_of
from .vec import range_hashes, row_chunks, utf8_column, window_hashes, window_starts, word_bounds, word_hashes

#: Words of a window and of a block; log2 of the bits of the filter and its segments.
WINDOW, BLOCK, FILTER_BITS, SEGMENT_BITS = 50, 25, 28, 20
#: Filter bits wanted for each block, most rounds, and bytes in memory up to which a side is broadcast.
BITS_EACH, MOST_ROUNDS, BROADCAST = 8, 16, 64 << 20
_SECOND_SEED = 99


def filter_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in the filter."""
    low = np.uint64((1 << bits) - 1)
    return h & low, (h >> np.uint64(64 - bits)) ^ ((h * np.uint64(0x9E3779B97F4A7C15)) & low)


def chunks_of(column):
    """Word hashes and first-word indexes of the rows, chunk by chunk."""
    data, offsets = utf8_column(column)
    for a, b in row_chunks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_bounds(part, own)
        yield a, part, own, starts, ends, first


def build_filter(docs: DataFrame, bits: int, block: int, part: int, parts: int) -> np.ndarray:
    """The bit array of the hashes of all blocks in one part of the hash space.

    Executors set the bits segment by segment; the driver only joins the segments
    of the one fixed-size array.
    """
    segment = min(SEGMENT_BITS, bits)

    def collect_bits(batches):
        for batch in batches:
            segs, packed = [], []
            for _, data, own, starts, ends, first in chunks_of(batch.column(0)):
                words = word_hashes(data, starts, ends)
                h = window_hashes(words, window_starts(first, block, block)[1], block)
                if parts > 1:
                    h = h[(h >> np.uint64(20)) % np.uint64(parts) == np.uint64(part)]
                at = np.unique(np.concatenate(filter_places(h, bits)))
                if not len(at):
                    continue
                seg = (at >> np.uint64(segment)).astype(np.int32)
                inner = (at & np.uint64((1 << segment) - 1)).astype("<u4")
                cuts = np.flatnonzero(np.diff(seg)) + 1
                segs.extend(seg[np.concatenate([[0], cuts])].tolist())
                packed.extend(x.tobytes() for x in np.split(inner, cuts))
            yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int32()), pa.array(packed, pa.binary())], names=["seg", "at"])

    def set_bits(rows: pd.DataFrame) -> pd.DataFrame:
        array = np.zeros(1 << segment, bool)
        for x in rows["at"]:
            array[np.frombuffer(x, "<u4")] = True
        return pd.DataFrame({"seg": rows["seg"].iloc[:1], "bits": [np.packbits(array, bitorder="little").tobytes()]})

    sent = docs.select("text").mapInArrow(released(collect_bits), "seg int, at binary")
    made = sent.groupBy("seg").applyInPandas(set_bits, "seg int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (segment - 3)
    for row in made.toLocalIterator():
        out[row["seg"] * step : (row["seg"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return out


def block_index(docs: DataFrame, block: int) -> DataFrame:
    """(h): the hash of every block, once."""

    def run(batches):
        for batch in batches:
            for _, data, own, starts, ends, first in chunks_of(batch.column(0)):
                h = window_hashes(word_hashes(data, starts, ends), window_starts(first, block, block)[1], block)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(released(run), "h long").distinct()


def in_filter(h: np.ndarray, array: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for at in filter_places(h, bits):
        ok &= (array[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def probe(docs: DataFrame, array, bits: int, window: int, block: int, part: int, parts: int) -> DataFrame:
    """(h, context, doc_id, tkey, at, lead, tail) of every rolling block that may be in the index; all of them without an array.

    at: the block's first word; lead, tail: words of context before and behind it.
    """
    reach = window - block
    schema = "h long, context long, doc_id long, tkey long, at int, lead int, tail int"

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, data, own, starts, ends, first in chunks_of(batch.column(2)):
                words = word_hashes(data, starts, ends)
                row, at = window_starts(first, block)
                h = window_hashes(words, at, block)
                keep = in_filter(h, array.value, bits) if array is not None else np.ones(len(h), bool)
                if parts > 1:
                    keep &= (h >> np.uint64(20)) % np.uint64(parts) == np.uint64(part)
                row, at, h = row[keep], at[keep], h[keep]
                lead = np.minimum(reach, at - first[row])
                tail = np.minimum(reach, first[row + 1] - at - block)
                other = word_hashes(data, starts, ends, _SECOND_SEED)
                around = range_hashes(other, at - lead, at + block + tail, _SECOND_SEED) + lead.astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)),
                        pa.array(around.view(np.int64)),
                        pa.array(ids[a + row]),
                        pa.array(keys[a + row]),
                        pa.array((at - first[row]).astype(np.int32)),
                        pa.array(lead.astype(np.int32)),
                        pa.array(tail.astype(np.int32)),
                    ],
                    names=["h", "context", "doc_id", "tkey", "at", "lead", "tail"],
                )

    return docs.select("doc_id", "tkey", "text").mapInArrow(released(run), schema)


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Documents with their row of ``places`` (doc_id, tkey, packed), if they have one.

    The places are broadcast while their measured size allows it; beyond that both
    sides are shuffled by the document.
    """
    side = F.broadcast(places) if size_of(places) <= BROADCAST else places
    return docs.join(side, ["doc_id", "tkey"], "left")


def windows_at(docs: DataFrame, places: DataFrame, window: int, block: int) -> DataFrame:
    """(k1, k2, doc_id, tkey, at) of every window through the given blocks, once for each document."""
    schema = "k1 long, k2 long, doc_id long, tkey long, at int"

    def run(batches):
        for batch in batches:
            ids, keys, packed = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for a, data, own, starts, ends, first in chunks_of(batch.column(2)):
                one, two = word_hashes(data, starts, ends), word_hashes(data, starts, ends, _SECOND_SEED)
                found = []
                for r in range(len(own) - 1):
                    blocks = np.frombuffer(packed[a + r], "<i4")
                    n = int(first[r + 1] - first[r])
                    if n < window:
                        continue
                    edge = np.zeros(n + 2, np.int64)
                    np.add.at(edge, np.maximum(0, blocks - (window - block)), 1)
                    np.add.at(edge, np.minimum(blocks, n - window) + 1, -1)
                    found.append((r, np.flatnonzero(np.cumsum(edge[: n - window + 1]) > 0)))
                if not found:
                    continue
                row = np.repeat([r for r, _ in found], [len(at) for _, at in found])
                at = np.concatenate([x for _, x in found])
                k1 = window_hashes(one, first[row] + at, window)
                k2 = window_hashes(two, first[row] + at, window, _SECOND_SEED)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(ids[a + row]), pa.array(keys[a + row]), pa.array(at.astype(np.int32))],
                    names=["k1", "k2", "doc_id", "tkey", "at"],
                )

    return with_places(docs.filter(F.col("doc_id").isNotNull()), places).filter("packed IS NOT NULL").select("doc_id", "tkey", "text", "packed").mapInArrow(released(run), schema)


def packed(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each document with the given ints of all its rows as little-endian binary."""

    def run(batches):
        for batch in batches:
            out = [np.array([list(x.values()) for x in row], "<i4").tobytes() for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "tkey", "packed"])

    # a set: rows of equal documents bring the same places, which each task counts once
    grouped = rows.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct(*columns)).alias("all"))
    return grouped.mapInArrow(released(run), "doc_id long, tkey long, packed binary")


def removal(column, ranges: Sequence[bytes | None], window: int):
    """Words, removed words and kept text of each row; ranges: pairs (first word, words) in each row's binary."""
    total, removed, kept = [], [], []
    for a, data, own, starts, ends, first in chunks_of(column):
        raw = data.tobytes()
        gone = np.zeros(len(starts) + 1, np.int64)
        for r in range(len(own) - 1):
            if ranges[a + r]:
                pairs = np.frombuffer(ranges[a + r], "<i4").reshape(-1, 2)
                np.add.at(gone, first[r] + pairs[:, 0], 1)
                np.add.at(gone, first[r] + pairs[:, 0] + pairs[:, 1], -1)
        stay = np.cumsum(gone[:-1]) == 0
        # kept words with one space behind each, cut from the text in one gather
        s, e = starts[stay], ends[stay]
        size = e - s + 1
        place = np.concatenate([[0], np.cumsum(size)])
        out = np.full(int(place[-1]), 0x20, np.uint8)
        inner = np.ones(int(place[-1]), bool)
        inner[place[1:] - 1] = False
        source = np.flatnonzero(cover(s, e, len(data)))
        out[inner] = data[source]
        text = out.tobytes()
        before = np.concatenate([[0], np.cumsum(stay)])
        counts = np.diff(first)
        left = before[first[1:]] - before[first[:-1]]
        total.append(counts)
        removed.append(counts - left)
        for r in range(len(own) - 1):
            i, j = int(place[before[first[r]]]), int(place[before[first[r + 1]]])
            kept.append(text[i : max(i, j - 1)].decode("utf-8"))
        del raw
    whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return whole(total), whole(removed), kept


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, tkey, packed): the word ranges (first, length) of each document that go.

    docs: doc_id, tkey, text, without null ids.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    n_words = docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    rounds = max(1, math.ceil(n_words / block * BITS_EACH / (1 << bits)))
    if rounds > MOST_ROUNDS:
        # too many blocks for filters of this size: the probes meet the index in a shuffle
        index = materialise(block_index(docs, block), "index")
        probed = probe(docs, None, bits, window, block, 0, 1).join(index, "h", "left_semi")
    else:
        probed = None
        for part in range(rounds):
            array = spark.sparkContext.broadcast(build_filter(docs, bits, block, part, rounds))
            one = probe(docs, array, bits, window, block, part, rounds)
            probed = one if probed is None else probed.unionByName(one)
    hits = materialise(probed, "hits")
    # hashes that several documents hold; a hash of one document alone proves nothing
    shared = hits.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("context").alias("c1"), F.max("context").alias("c2"))
    # written before the join: a hot hash may then be split over tasks, as nothing below the join needs it whole
    shared = materialise(shared.filter("lo < hi").select("h", (F.col("c1") != F.col("c2")).alias("mixed")), "shared_hashes")
    hits = materialise(hits.join(shared, "h"), "shared")
    least = materialise(hits.groupBy("h", "context").agg(F.min("doc_id").alias("least")), "least")
    hits = hits.join(least, ["h", "context"])
    again = hits.filter("least < doc_id AND lead + tail >= {}".format(window - block))
    done = again.select("doc_id", "tkey", (F.col("at") - F.col("lead")).alias("first"), (F.col("lead") + F.col("tail") + F.lit(block)).alias("size"))
    # contexts that differ: the windows through the hit decide
    open_ = hits.filter("least = doc_id AND mixed").select("doc_id", "tkey", "at")
    places = materialise(packed(open_, "at"), "places")
    windows = materialise(windows_at(docs, places, window, block), "windows")
    twice = materialise(windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi"), "twice")
    more = windows.join(twice, ["k1", "k2"]).filter("doc_id > lo").select("doc_id", "tkey", F.col("at").alias("first"), F.lit(window).alias("size"))
    return materialise(packed(done.unionByName(more), "first", "size"), "ranges")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, bits: int = FILTER_BITS, keep: Sequence[str] | None = None) -> DataFrame:
    """Append n_words, n_removed and kept_text, the words that stay joined by one space.

    Windows are judged on the input, not on what is left. A null or empty text has
    no words. Rows with one id are one side: neither is smaller than the other, so
    repeated rows keep what no smaller id has. A row with a null id keeps all its
    words and takes none from others. An empty table gives an empty one; columns
    that have the new names are replaced.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block: window >= 2 * block - 1")
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    known = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.xxhash64(t).alias("tkey"), t.alias("text"))
    ranges = repeats(known.filter("doc_id IS NOT NULL"), window, block, bits)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_removed", "kept_text")]
    named = [F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)]
    joined = with_places(docs.select(*named, F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.xxhash64(t).alias("tkey"), t.alias("text")), ranges)

    def run(column, found):
        n, gone, kept = removal(column, found.to_pylist(), window)
        return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    made = map_columns(joined, run, ["text", "packed"], fields, [f"k{i}" for i in range(len(keep))])
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", "kept_text")


def duckdb_sql(window: int = WINDOW) -> str:
    """Every window of every document by its words."""
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM w WHERE len(w) >= {window}),
k AS (SELECT rid, doc_id, i, sha256(array_to_string(w[i:i + {window - 1}], ' ')) AS k FROM p),
b AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM k) WHERE lo < doc_id),
c AS (SELECT DISTINCT rid, i + d AS i FROM b, (SELECT unnest(range(0, {window})) AS d)),
g AS (SELECT rid, list(i) AS gone FROM c GROUP BY rid),
x AS (SELECT rid, doc_id, i, w[i] AS word FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
s AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.rid = c.rid AND x.i = c.i GROUP BY x.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (rid)
"""
