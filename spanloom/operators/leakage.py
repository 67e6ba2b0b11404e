"""Contamination between collections by word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import empty, let
from ..functions.text import WS
from .match import score_report

SIZE, MOST = 12, 0.10
#: Distinct shingles of the donors up to which they are broadcast (16 bytes each, and the table around them).
DONORS = 500_000


def hashed_shingles(text: Column, size: int = SIZE) -> Column:
    """T5: the distinct shingles of ``shingles`` as 64-bit hashes; no shingle's text is built.

    Hashes of 1, 2, 4, ... words come from each other, and those of ``size`` words from the
    powers of two that it is the sum of.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"[^{WS}]+"), F.lit(0))

    def grown(level: Column, n: Column, width: int, done: Column | None, at: int) -> Column:
        if size & width:
            if done is None:
                done, at = level, width
            else:
                count = n - at - width
                own = let(F.struct(done.alias("d"), level.alias("l")), lambda x: F.transform(F.sequence(F.lit(0), count), lambda i: F.xxhash64(F.get(x["d"], i), F.get(x["l"], i + at))))
                if at + width == size:
                    return F.array_distinct(own)
                return let(own, lambda d: grown_next(level, n, width, d, at + width))
        if at == size:
            return F.array_distinct(F.slice(done, F.lit(1), n - size + 1))
        return grown_next(level, n, width, done, at)

    def grown_next(level: Column, n: Column, width: int, done: Column | None, at: int) -> Column:
        longer = let(level, lambda x: F.transform(F.sequence(F.lit(0), n - 2 * width), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + width))))
        return let(longer, lambda x: grown(x, n, 2 * width, done, at))

    def made(w: Column) -> Column:
        first = F.transform(w, lambda x: F.xxhash64(x))
        return F.when(F.size(w) >= size, let(first, lambda x: grown(x, F.size(x), 1, None, 0))).otherwise(empty("array<bigint>"))

    return let(words, made)


def overlap(target: DataFrame, donor: DataFrame, size: int = SIZE, target_id: str = "id", target_text: str = "text", donor_text: str = "text") -> DataFrame:
    """Per target its distinct shingles, those a donor also has, and their share (0 without any).

    Shingles are 64-bit hashes. Up to ``DONORS`` distinct shingles of the donors are broadcast and
    each target is judged where it is read: only its sums are shuffled. Beyond that, both
    sides are shuffled by shingle, the donors' after a distinct, so that a hot one matches one row.
    """
    rows = target.select(F.col(target_id).alias("id"), hashed_shingles(F.col(target_text), size).alias("own"))
    own = rows.select("id", F.explode_outer("own").alias("k"))
    other = donor.select(F.explode(hashed_shingles(F.col(donor_text), size)).alias("k")).distinct()
    n = other.limit(DONORS + 1).count()
    other = other.withColumn("hit", F.lit(1))
    both = own.join(F.broadcast(other) if n <= DONORS else other, "k", "left")
    found = both.groupBy("id").agg(F.count("k").alias("n_shingles"), F.count("hit").alias("n_shared"))
    return found.withColumn("share", F.coalesce(F.try_divide("n_shared", "n_shingles"), F.lit(0.0)))


def clean_ids(shares: DataFrame, most: float = MOST) -> DataFrame:
    """Ids whose share of shared shingles is at most ``most``."""
    return shares.filter(F.col("share") <= most).select("id")


def subset(store: DataFrame, keep: DataFrame, on: str) -> DataFrame:
    """rows whose key is to be kept."""
    return store.join(keep, on, "left_semi")


def leakage_report(gold: DataFrame, preds: dict[str, DataFrame], shares: DataFrame, most: float = MOST) -> DataFrame:
    """M2: micro scores of every prediction set over all files and over clean files only."""
    clean = clean_ids(shares, most).withColumnRenamed("id", "file")
    out = None
    for name, pred in preds.items():
        for scope, g in (("full", gold), ("clean", subset(gold, clean, "file"))):
            row = score_report(g, pred).filter("scope = 'micro'").select(F.lit(name).alias("name"), F.lit(scope).alias("files"), "tp", "pred", "gold", "p", "r", "f1")
            out = row if out is None else out.unionByName(row)
    return out


def shared_share(n_shared: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(n_shared, n), F.lit(0.0))
