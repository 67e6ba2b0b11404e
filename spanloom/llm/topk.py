"""Exact top-k search by inner product with block-at-a-time pruning.

Components are terms. Candidates are ordered by their strongest term and then by id and
cut into document-range blocks; a block keeps the largest and smallest value of each
term and its forward index, the matrix of its vectors. For a query, the sum over its
terms of the best product that a block allows bounds all scores in that block. Blocks
are taken by falling bound and scored through their forward index until the next bound
is below the k-th score found so far.

The stated queries meet all rows in cells of bounded size, a shard of candidates and a
group of queries. Shards come in rounds, each ``GROWTH`` times as many as all before,
and the k-th score of a query after one round is its threshold in the next: a
shard whose bound lies below it is not sent the query, nor its rows to a group that has no
query for it, and a cell returns only rows that reach the threshold. So a query's partial
results grow with the number of rounds, the logarithm of the table, and not with the shards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import limit_batches, materialise, quoted, ranked, released

#: Rows of a block, candidates of a shard, queries of a group.
BLOCK, SHARD, GROUP = 256, 4096, 1024
#: Shards of the first round, growth of the rounds, and bytes up to which the bounds of a round's shards are broadcast.
FIRST, GROWTH, BROADCAST = 16, 3, 16 << 20
LEAST = np.iinfo(np.int64).min


def quantised(df: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """vec_id and the floored, scaled components; unusable vectors and null ids are left out.

    Rows that agree in id and vector are one row.
    """
    e = F.col(quoted(embedding))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = df.select(F.col(quoted(vec_id)).cast("long").alias("vec_id"), e.cast("array<double>").alias("e"))
    usable = usable.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter(F.forall("e", finite))
    return usable.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("v")).distinct()


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of vectors as a matrix; a shorter vector is filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; exact also where doubles would round."""
    most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * left.shape[1]
    if most < 2**53:
        return (left @ right.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in right] for x in left]
    return np.clip(np.array(exact, object), -(2**63), 2**63 - 1).astype(np.int64)


def bounds_of(queries: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """The most that any vector between lows and highs can score, for each query and block."""
    bounds = np.maximum(queries, 0) @ highs.T + np.minimum(queries, 0) @ lows.T
    # The slack covers what doubles round off; a bound may be too high, never too low.
    return bounds + np.abs(bounds) * 1e-9


def search_cell(queries: np.ndarray, query_rows: np.ndarray, least: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query index, candidate index and score of each query's k best rows among those that reach its ``least`` score.

    query_rows, row_ids: which row of the table each is; ids break ties.
    """
    n, m = len(queries), len(ids)
    starts = np.arange(0, m, block)
    highs = np.stack([rows[s : s + block].max(axis=0) for s in starts])
    lows = np.stack([rows[s : s + block].min(axis=0) for s in starts])
    bounds = bounds_of(queries, highs, lows)
    order = np.argsort(-bounds, axis=1, kind="stable")
    # k rows with at least this score are known from earlier rounds
    best = np.repeat(least[:, None], k, axis=1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(n)
    for rank in range(len(starts)):
        place = order[active, rank]
        kth = best[active, 0]
        going = bounds[active, place] >= kth
        active, place = active[going], place[going]
        if not len(active):
            break
        for b in np.unique(place):
            who = active[place == b]
            own = slice(starts[b], starts[b] + block)
            scores = products(queries[who], rows[own])
            apart = query_rows[who][:, None] != row_ids[own][None, :]
            q, c = np.nonzero(apart & (scores >= best[who, :1]))
            found.append((who[q], starts[b] + c, scores[q, c]))
            scores = np.where(apart, scores, LEAST)
            both = np.concatenate([best[who], scores], axis=1)
            best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            # partition leaves the k largest with the smallest of them first
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    who, cand, score = (np.concatenate(x) for x in zip(*found))
    keep = score >= best[who, 0]
    who, cand, score = who[keep], cand[keep], score[keep]
    # the bitwise complement falls as the score rises and cannot overflow
    by = np.lexsort((ids[cand], ~score, who))
    who, cand, score = who[by], cand[by], score[by]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return who[rank < k], cand[rank < k], score[rank < k]


def shard_bounds(vectors: DataFrame, width: int) -> DataFrame:
    """shard, highs, lows: the largest and smallest value of each term in a shard, as packed doubles."""

    def run(frames):
        for frame in frames:
            for shard, part in frame.groupby("shard", sort=False):
                rows = matrix(part["v"], width)
                yield pd.DataFrame({"shard": [shard], "highs": [rows.max(axis=0).tobytes()], "lows": [rows.min(axis=0).tobytes()]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        highs = np.max([np.frombuffer(x) for x in part["highs"]], axis=0)
        lows = np.min([np.frombuffer(x) for x in part["lows"]], axis=0)
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "highs": [highs.tobytes()], "lows": [lows.tobytes()]})

    schema = "shard long, highs binary, lows binary"
    return vectors.select("shard", "v").mapInPandas(released(run), schema).groupBy("shard").applyInPandas(merge, schema)


def meeting(asked: DataFrame, bounds: DataFrame | None, shards: list[int], width: int) -> DataFrame:
    """The queries (q, query_id, v, part, kth), once for each shard that may hold a row for them."""
    if bounds is None:
        return asked.withColumn("shard", F.explode(F.array(*[F.lit(x).cast("long") for x in shards])) if len(shards) < 64 else F.explode(F.lit(shards).cast("array<long>")))
    rows = bounds.collect()  # their size was checked
    own = asked.sparkSession.sparkContext.broadcast(
        (np.array([r["shard"] for r in rows], np.int64), np.stack([np.frombuffer(r["highs"]) for r in rows]), np.stack([np.frombuffer(r["lows"]) for r in rows]))
    )

    def run(frames):
        numbers, highs, lows = own.value
        for frame in frames:
            for a in range(0, len(frame), 256):
                part = frame.iloc[a : a + 256]
                q, s = np.nonzero(bounds_of(matrix(part["v"], width), highs, lows) >= part["kth"].to_numpy()[:, None])
                out = part.iloc[q].copy()
                out["shard"] = numbers[s]
                yield out[["q", "query_id", "v", "part", "kth", "shard"]]

    return asked.select("q", "query_id", "v", "part", "kth").mapInPandas(released(run), "q long, query_id long, v array<double>, part int, kth long, shard long")


def top_k(df: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    is_query: a function of the id column that tells the queries. Candidates are
    all rows but the query's own; ties go to the smaller vec_id; with fewer
    candidates than k, all are returned. A null vec_id, a null vector and one that
    holds a null or non-finite component take no part; an empty vector scores 0.
    Rows that agree in id and vector are one row; rows that only share an id are rows of
    their own, as queries and as candidates. A score beyond 64 bits stands at their
    limit. Other columns are not read. An empty table gives an empty result.
    """
    limit_batches(df.sparkSession)
    strongest = F.array_position(F.transform("v", lambda x: F.abs(x)), F.array_max(F.transform("v", lambda x: F.abs(x))))
    placed = ranked(quantised(df, vec_id, embedding, scale), [strongest, F.col("vec_id"), F.col("v")], "row")
    vectors = materialise(placed.withColumn("shard", F.expr(f"`row` div {SHARD}")), "vectors")
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("q"), F.max(F.size("v")).alias("w")).first()
    shards, groups, width = max(1, math.ceil(seen["n"] / SHARD)), max(1, math.ceil(seen["q"] / GROUP)), max(1, seen["w"] or 1)
    queries = vectors.filter(is_query(F.col("vec_id"))).select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part"))
    # a step without common divisor visits every shard once, in an order unlike that of the terms
    stride = next(x for x in range(max(1, int(shards * 0.618)), shards + 2) if math.gcd(x, shards) == 1)
    order = [(i * stride) % shards for i in range(shards)]
    bounds = materialise(shard_bounds(vectors, width), "bounds") if shards > FIRST else None

    def cell(asked: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(candidates):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("q", "query_id", "vec_id", "row", "score")})
        candidates = candidates.sort_values("row")
        ids, rows = candidates["vec_id"].to_numpy(), candidates["row"].to_numpy()
        who, cand, score = search_cell(matrix(asked["v"], width), asked["q"].to_numpy(), asked["kth"].to_numpy(), matrix(candidates["v"], width), rows, ids, k)
        return pd.DataFrame({"q": asked["q"].to_numpy()[who], "query_id": asked["query_id"].to_numpy()[who], "vec_id": ids[cand], "row": rows[cand], "score": score})

    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", "row")
    top, done, size = None, 0, FIRST
    while done < shards:
        now = order[done : done + size]
        if top is None:
            asked, own = queries.withColumn("kth", F.lit(LEAST)), None
        else:
            kth = top.filter(F.col("rank") == k).select("q", F.col("score").alias("kth"))
            asked = queries.join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(LEAST)))
            own = bounds.filter(F.col("shard").isin(now)) if len(now) * width * 16 <= BROADCAST else None
        asked = materialise(meeting(asked, own, now, width), "asked")
        cells = materialise(asked.select("shard", "part").distinct(), "meet")
        rows = vectors.join(cells, "shard")
        found = asked.groupBy("shard", "part").cogroup(rows.groupBy("shard", "part")).applyInPandas(cell, "q long, query_id long, vec_id long, row long, score long")
        found = found if top is None else found.unionByName(top.drop("rank"))
        top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        done, size = done + len(now), GROWTH * (done + len(now))
        if done < shards:
            top = materialise(top, "top")
    return top.select("query_id", "rank", "vec_id", "score")


def duckdb_sql(k: int = 20, step: int = 20) -> str:
    """Brute force over all pairs of a query and a row."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {step} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {k}
"""
