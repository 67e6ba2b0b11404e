"""Near-duplicate documents by ProbMinHash sketches, banding and verification.

Documents with the same words, by a cryptographic digest of them, form one text and go on as their smallest id. Each
text is sketched over its weighted word shingles; texts that agree in all registers
of a band meet in a bucket. Links are verified by sets of shingles, from which weights
lead away where a shingle repeats, so a text with repeats brings the bands of
its set too; those of a text without repeats are the same for both. Texts that buckets connect, directly or over others,
form a family, and no link leaves a family. Links are then verified exactly by the
Jaccard similarity of the shingle sets:

* a family of at most ``TILE`` texts is one cell, verified in one task;
* a larger one first measures all its texts against a hub, the text that shares most
  buckets. Texts linked to the hub are connected with each other. As 1 - Jaccard
  is a metric, a text can only be linked to one of them if its own distance from the
  hub is at most twice that of a link; such texts meet them in cells of bounded size. All
  texts that are not linked to the hub form families anew, by the buckets that they
  share with each other, and are verified in the same way with hubs of their own. So
  large groups of copies of one text cost one comparison each, and families that only
  common passages hold together come apart;
* where the texts not linked to their hubs are so few that meeting their whole families in
  cells copies each text at most ``COPIES`` times on average, or so many, over half, that
  hubs gather little, they do that instead, block by block;
* so do all texts of a family that is still large after ``HUBS`` rounds.

No step loses a link between two texts that share a bucket.

A cell returns links that connect what it found connected, not all pairs. Classes are
the connected components of the links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, materialise, quoted, released, size_of
from .vec import mix64, range_hashes, row_chunks, utf8_column, window_hashes, window_starts, word_bounds, word_hashes

#: Words of a shingle, least similarity, registers of a sketch and registers of a band.
SHINGLE, SIMILARITY, REGISTERS, BAND = 5, 0.8, 80, 4
#: Texts on one side of a cell; bytes up to which a side is broadcast; rounds of hubs; copies of a text for the cells of few texts;
#: edges that one task of the component search takes.
TILE, BROADCAST, HUBS, COPIES, EDGES = 100, 16 << 20, 3, 8, 200_000


def weighted_shingles(words: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of every distinct shingle; a row of fewer words is one shingle."""
    row, at = window_starts(first, size)
    h = window_hashes(words, at, size)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    if len(short):
        row, h = np.concatenate([row, short]), np.concatenate([h, range_hashes(words, first[short], first[short + 1])])
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(row)))


def sketches(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of n rows: for each register the shingle that arrives first.

    Every shingle is a Poisson process whose rate is its weight; each arrival falls
    into a random register. A shingle is given up once its latest arrival is later
    than the first arrival of every register of its row: later ones change nothing.
    Two rows agree in a register with their probability Jaccard similarity.
    """
    first = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, np.uint64)
    rate = 1.0 / weight
    time = np.zeros(len(row))
    live, arrival = np.arange(len(row)), 0
    while len(live):
        arrival += 1
        r = mix64(h[live] + np.uint64((arrival * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        time[live] += -np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) * rate[live]
        place = row[live] * registers + (mix64(r) % np.uint64(registers)).astype(np.int64)
        now = time[live]
        np.minimum.at(first, place, now)
        won = first[place] == now
        owner[place[won]] = h[live][won]
        last = first.reshape(n, registers).max(axis=1)
        live = live[now <= last[row[live]]]
    return owner.reshape(n, registers)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """The key of each band of each sketch."""
    bands = REGISTERS // BAND
    keys = np.zeros((len(sketch), bands), np.uint64)
    for i in range(BAND):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + sketch[:, i::BAND][:, :bands] + np.arange(bands, dtype=np.uint64))
    return keys.view(np.int64)


def content_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit cryptographic digest of the words of each row, joined by one space."""
    raw, at = data.tobytes(), offsets.tolist()
    # bytes split at the white space of the operators' word class
    digests = b"".join(hashlib.blake2b(b" ".join(raw[i:j].split()), digest_size=16).digest() for i, j in zip(at, at[1:]))
    both = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def sketch_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, c1, c2, n_words, bands): content key and band keys of every document; docs: doc_id, text."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            data, offsets = utf8_column(batch.column(1))
            for a, b in row_chunks(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = word_bounds(part, own)
                words = word_hashes(part, starts, ends)
                row, h, count = weighted_shingles(words, first)
                keys = band_keys(sketches(row, h, 1.0 + np.log(count), b - a))
                n = np.diff(first)
                repeats = np.zeros(b - a, bool)
                repeats[row[count > 1]] = True
                # texts without repeats have the same bands either way
                place = np.cumsum(repeats) - 1
                again = repeats[row]
                plain = band_keys(sketches(place[row[again]], h[again], np.ones(int(again.sum())), int(repeats.sum())))
                of = np.concatenate([np.arange(b - a), np.flatnonzero(repeats)])
                by = np.argsort(of, kind="stable")
                bands = REGISTERS // BAND
                ends_at = np.concatenate([[0], np.cumsum((1 + repeats) * bands)])
                listed = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(np.concatenate([keys, plain])[by].ravel()))
                c1, c2 = content_keys(part, own)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(c1), pa.array(c2), pa.array(n.astype(np.int64)), listed], names=["doc_id", "c1", "c2", "n_words", "bands"])

    return docs.mapInArrow(released(run), "doc_id long, c1 long, c2 long, n_words long, bands array<long>")


def joined_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each is connected with by them."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        # labels of labels, until they are their own
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (a, b) from nodes to smaller ones that connect what the given edges connect, and the tasks that made them.

    Each task takes about ``EDGES`` edges as they lie and leaves one for each of its
    nodes: nothing is shuffled, and with one task the result is final.
    """

    def run(batches):
        rows = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if rows:
            nodes, label = joined_labels(*(np.concatenate(x) for x in zip(*rows)))
            own = nodes != label
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(label[own])], names=["a", "b"])

    tasks = max(1, -(-edges.count() // EDGES))
    made = edges.select("a", "b").coalesce(tasks).mapInArrow(released(run), "a long, b long")
    return materialise(made, "edges"), tasks


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) is connected with.

    Tasks contract the edges that they hold; what several tasks leave goes through
    alternating large-star and small-star steps and is contracted again. Nothing is
    collected, and hot nodes only meet their minimum. Minima are written before they are
    joined: nothing below the join then needs a hot node's rows in one task, so that they
    may be split. Every round lowers labels of a finite set, and the number of rounds
    grows with the logarithm of the nodes.
    """
    e, tasks = contracted(materialise(edges.select("a", "b").filter("a <> b"), "edges"))
    while tasks > 1:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # here a node has one row for each smallest neighbour only, so none is hot
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e, tasks = contracted(materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges"))
        # done when every node but the labels themselves has one edge, to a label
        ends = e.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("b", F.lit(0), F.lit(1)))
        loose = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR out = 1 AND into = 1")
        if tasks > 1 and loose.limit(1).count() == 0:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select("b", "b").distinct())


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (node and more) with the sorted distinct shingles of the node's text."""
    side = F.broadcast(wanted) if size_of(wanted) <= BROADCAST else wanted
    found = docs.withColumnRenamed("doc_id", "node").join(side, "node")
    keep = wanted.columns

    def run(batches):
        for batch in batches:
            data, offsets = utf8_column(batch.column(len(keep)))
            out = []
            for a, b in row_chunks(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = word_bounds(part, own)
                row, h, _ = weighted_shingles(word_hashes(part, starts, ends), first)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                out.extend(h[i:j].tobytes() for i, j in zip(cut, cut[1:]))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(out, pa.binary())], names=[*keep, "shingles"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    return found.select(*keep, "text").mapInArrow(released(run), f"{kinds}, shingles binary")


def unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column]


def jaccard_rows(one: np.ndarray, owners: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Similarity of one set with many, given as sorted hashes and the set each belongs to."""
    low, high = np.searchsorted(hashes, one, "left"), np.searchsorted(hashes, one, "right")
    n = high - low
    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    common = np.bincount(owners[at], minlength=len(sizes))
    return common / np.maximum(1, len(one) + sizes - common)


def cell_links(asked: list[np.ndarray], asked_ids: np.ndarray, sets: list[np.ndarray], ids: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between two blocks of texts that connect everything that is connected."""
    sizes = np.array([len(x) for x in sets])
    hashes = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[by], owners[by]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for one, own in zip(asked, asked_ids.tolist()):
        for j in np.flatnonzero(jaccard_rows(one, owners, hashes, sizes) >= least).tolist():
            a, b = root(own), root(int(ids[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((own, int(ids[j])))
    return out


def families(banded: DataFrame) -> DataFrame:
    """(node, family, size, hub) of all nodes that share a bucket with another; banded: node, key.

    family: the smallest node connected over buckets; hub: the node with most neighbours in them.
    """
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo")).filter("n > 1")
    # written before the join, so that a hot bucket may be split
    shared = materialise(banded.join(materialise(buckets, "buckets"), "key"), "shared")
    found = components(shared.filter("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b")))
    popular = shared.groupBy("node").agg(F.sum("n").alias("popular"))
    found = materialise(found.join(popular, "node"), "families")
    sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("size"), (-F.max(F.struct("popular", (-F.col("node")).alias("other")))["other"]).alias("hub"))
    return materialise(found.join(materialise(sizes, "sizes"), "label").select("node", F.col("label").alias("family"), "size", "hub"), "members")


def grid(asked: DataFrame, others: DataFrame, tile: int) -> DataFrame:
    """Cells (family, i, j, side, node, shingles) in which every row of ``asked`` meets every one of ``others`` of its family.

    asked, others: family, node, shingles. Both are dealt to blocks of about ``tile`` rows.
    """
    sizes = asked.groupBy("family").agg(F.count(F.lit(1)).alias("na")).join(others.groupBy("family").agg(F.count(F.lit(1)).alias("nb")), "family")
    sizes = materialise(sizes, "counts")
    side = F.broadcast(sizes) if size_of(sizes) <= BROADCAST else sizes
    blocks = lambda n: F.ceil(F.col(n) / tile).cast("int")
    block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), blocks(n)).cast("int")
    range_of = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = asked.join(side, "family").withColumn("i", block("na", 1)).withColumn("j", range_of("nb")).select("family", "i", "j", F.lit(0).alias("side"), "node", "shingles")
    right = others.join(side, "family").withColumn("j", block("nb", 2)).withColumn("i", range_of("na")).select("family", "i", "j", F.lit(1).alias("side"), "node", "shingles")
    return left.unionByName(right)


def hub_similarity(large: DataFrame) -> DataFrame:
    """(node, near): similarity of every text of the large families with its family's hub."""
    hubs = materialise(large.filter("node = hub").select("family", F.col("shingles").alias("hub_shingles")).dropDuplicates(["family"]), "hubs")

    def measure(batches):
        for batch in batches:
            a, b = unpacked(batch.column(1).to_pylist()), unpacked(batch.column(2).to_pylist())
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], float)
            whole = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(common / np.maximum(1.0, whole - common) if len(a) else np.zeros(0))], names=["node", "near"])

    beside = large.join(F.broadcast(hubs) if size_of(hubs) <= BROADCAST else hubs, "family")
    near = beside.select("node", "shingles", "hub_shingles").mapInArrow(released(measure), "node long, near double")
    # a repeated id has several texts, of which the nearest counts
    return materialise(near.groupBy("node").agg(F.max("near").alias("near")), "near")


def verified_links(docs: DataFrame, members: DataFrame, banded: DataFrame, least: float, tile: int) -> DataFrame:
    """Links (a, b) inside the families; members: node, family, size, hub; banded: node, key."""

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        q, m = part[part["side"] != 1], part[part["side"] != 0]
        links = cell_links(unpacked(q["shingles"]), q["node"].to_numpy(), unpacked(m["shingles"]), m["node"].to_numpy(), least) if len(q) and len(m) else []
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    sets = materialise(shingle_sets(docs, members), "sets")
    texts = sets.select("node", "shingles")
    whole = lambda rows: rows.filter(F.col("size") <= tile).select("family", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "node", "shingles")
    found = whole(sets).groupBy("family", "i", "j").applyInPandas(cell, "a long, b long")
    large = sets.filter(F.col("size") > tile)
    for round_ in range(1 + HUBS):
        if large.limit(1).count() == 0:
            break
        if round_ == HUBS:
            # no hub gathers these: every text meets its whole family
            pairs = large.select("family", "node", "shingles")
            return found.union(grid(pairs, pairs, tile).groupBy("family", "i", "j").applyInPandas(cell, "a long, b long"))
        near = hub_similarity(large)
        placed = materialise(large.select("node", "family", "size", "hub").distinct().join(near, "node"), "placed")
        found = found.union(placed.filter(F.col("near") >= least).filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        far = materialise(placed.filter(F.col("near") < least).select("node", "near"), "far")
        counts = placed.groupBy("family").agg(F.count_if(F.col("near") < least).alias("far"), F.count(F.lit(1)).alias("size"))
        copies = F.col("far") * F.ceil(F.col("size") / tile) + F.when(F.col("far") > 0, F.col("size") * F.ceil(F.col("far") / tile)).otherwise(0)
        cost = counts.agg(F.sum(copies).alias("copies"), F.sum("far").alias("far"), F.sum("size").alias("size")).first()
        if cost["copies"] <= COPIES * cost["size"] or 2 * cost["far"] > cost["size"]:
            # few texts are far from their hub, or hubs gather too little to go on with: these texts meet their whole family
            asked = large.join(F.broadcast(far.select("node")) if size_of(far) <= BROADCAST else far.select("node"), "node", "left_semi")
            pairs = grid(asked.select("family", "node", "shingles"), large.select("family", "node", "shingles"), tile)
            return found.union(pairs.groupBy("family", "i", "j").applyInPandas(cell, "a long, b long"))
        # 1 - Jaccard is a metric: a text that far from the hub has no link to one near it
        ring = large.join(far.filter(F.col("near") >= 2 * least - 1).select("node"), "node", "left_semi").select("family", "node", "shingles")
        core = large.join(placed.filter(F.col("near") >= least).select("node"), "node", "left_semi").select("family", "node", "shingles")
        found = found.union(grid(ring, core, tile).groupBy("family", "i", "j").applyInPandas(cell, "a long, b long"))
        # what is left falls into families of its own once the texts near the hubs are gone
        banded = materialise(banded.join(far.select("node"), "node", "left_semi"), "banded")
        again = families(banded)
        sets = materialise(texts.join(F.broadcast(again) if size_of(again) <= BROADCAST else again, "node"), "sets")
        found = found.union(whole(sets).groupBy("family", "i", "j").applyInPandas(cell, "a long, b long"))
        large = sets.filter(F.col("size") > tile)
    return found


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """One row for each input row: doc_id, text_id, class_id.

    text_id: the smallest id with the same words; class_id: the smallest id that is
    connected with it by links of similarity ``least`` or more between texts. A text
    without words, null included, is linked with nothing and is a class of its own.
    A text of fewer words than a shingle is one shingle; a very long one is taken whole.
    Rows that share an id are one document. A row with a null id has no class. An empty table gives an empty
    one. No other column is read.
    """
    limit_batches(docs.sparkSession)
    known = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    rows = materialise(sketch_rows(known), "sketches")
    texts = rows.filter("n_words > 0 AND doc_id IS NOT NULL").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "bands")).alias("x"))
    texts = materialise(texts.select("c1", "c2", F.col("x.doc_id").alias("text_id"), "x.bands"), "texts")
    banded = texts.select(F.col("text_id").alias("node"), F.explode(F.array_distinct("bands")).alias("key"))
    found = components(verified_links(known, families(banded), banded, least, tile))
    by_text = rows.select("doc_id", "c1", "c2", "n_words").join(texts.select("c1", "c2", "text_id"), ["c1", "c2"], "left")
    own = F.when(F.col("n_words") > 0, F.col("text_id")).otherwise(F.col("doc_id"))
    labelled = by_text.select("doc_id", F.when(F.col("doc_id").isNotNull(), own).alias("text_id"))
    labelled = labelled.join(materialise(found, "classes"), F.col("text_id") == F.col("node"), "left")
    return labelled.select("doc_id", "text_id", F.coalesce("label", "text_id").alias("class_id"))
