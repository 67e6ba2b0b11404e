"""Mixing sources to target weights by entropy balancing.

Rates w of documents minimise the relative entropy sum(w log w - w + 1) over all documents
under one token constraint for each source, sum(w * size) = target, and 0 <= w <= most.
The convex dual has one multiplier for each source, and its solution tilts the rate of a
document exponentially in what it adds to its source's constraint:
w = min(most, exp(multiplier * size)). So a source that has to grow repeats its longer
documents, and one that has to shrink gives them up first.

Newton iterations solve the dual: each is one aggregation of gradient and curvature over
the table of documents, which is summed up by source and size before, as documents of
one source and size weigh the same. Sums are exact integers, so that partitions and
reruns agree in every digit. Steps are held inside the bracket that the signs of
earlier gradients leave; multipliers live in a table, none is sent to the driver.

Rates become whole copies by error diffusion: in groups of documents of one
source, by falling size, each document takes the copies that bring the words taken
so far nearest to what is due, so that a group ends within half of its smallest
document. Groups are hash buckets of bounded size; a hot source has more of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, materialise, quoted, ranked, size_of

#: Weights of the sources in order, repeating, and most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: Share of a target by which the solution may miss it; units of one group of the rounding; bytes up to which sources are broadcast.
MISS, GROUP, BROADCAST = 1e-7, 2000, 8 << 20
#: Rates and curvatures count as whole multiples of these in exact sums.
RATE_UNIT, CURVE_UNIT = 2.0**-40, 2.0**-20


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small enough."""
    return F.broadcast(df) if size_of(df) <= BROADCAST else df


def source_targets(cells: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row for each source (key, source, source_rank, source_size, n, target); cells: source, size, n.

    Sources in code-point order, null last, take the weights in turn and share all
    tokens; a target stops at ``most`` times the source and the excess is shared
    again by weight. That ends with the targets min(most * size, weight * level); the
    level rises while sources that it fills are taken out of the sharing.
    """
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    rows = ranked(sums, [F.col("source").asc_nulls_last()], "source_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    rows = materialise(rows.withColumn("weight", weight).withColumn("cap", cap).withColumn("key", source_key(F.col("source"))), "sources")
    whole = rows.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    level = float(whole["s"] or 0) / float(whole["w"] or 1)
    while True:
        full = F.col("cap") < F.col("weight") * F.lit(level)
        # capacities are whole numbers, so their sum is exact in any order
        found = rows.agg(F.sum(F.when(full, F.col("cap").cast("decimal(38,0)"))).alias("held"), F.sum(F.when(~full, F.col("weight").cast("decimal(38,6)"))).alias("free")).first()
        if not found["free"]:
            break
        new = (float(whole["s"]) - float(found["held"] or 0)) / float(found["free"])
        if new <= level * (1 + 1e-15):
            break
        level = new
    return rows.select("key", "source", "source_rank", "source_size", "n", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def rate(tilt: Column, size: Column, most: float) -> Column:
    """The rate of a document: exponential in its size, at most ``most``."""
    return F.least(F.lit(float(most)), F.exp(F.least(tilt * size, F.lit(700.0))))


def multipliers(cells: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """source_rank, tilt: the dual's solution for every source; cells: key, size, n.

    A source whose target is ``most`` times its size has no finite multiplier; the
    largest number stands for it. One without words has 0.
    """
    own = targets.select("key", "source_rank", "source_size", F.col("n").alias("docs"), "target")
    rows = cells.filter("size > 0").join(small(own.select("key", "source_rank")), "key")
    rows = materialise(rows.select("source_rank", "size", "n"), "cells")
    mean = F.col("source_size") / F.col("docs")
    state = own.select(
        "source_rank",
        "target",
        F.when((F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size")), F.ln(F.col("target") / F.col("source_size")) / mean)
        .when(F.col("source_size") > 0, F.lit(1e300))
        .otherwise(F.lit(0.0))
        .alias("tilt"),
        F.lit(-1e300).alias("lo"),
        F.lit(1e300).alias("hi"),
        (1 / F.greatest(mean, F.lit(1.0))).alias("unit"),
        ((F.col("source_size") == 0) | (F.col("target") >= most * F.col("source_size"))).alias("done"),
    )
    state = materialise(state, "tilts")
    while state.filter("NOT done").limit(1).count():
        open_ = rows.join(small(materialise(state.filter("NOT done").select("source_rank", "tilt"), "open")), "source_rank")
        w = rate(F.col("tilt"), F.col("size"), most)
        words = (F.col("size") * F.col("n")).cast("decimal(19,0)")
        curve = F.when(w < most, F.least(F.col("size") * w, F.lit(1e9))).otherwise(F.lit(0.0))
        sums = open_.groupBy("source_rank").agg(
            F.sum(words * F.round(w / RATE_UNIT).cast("decimal(15,0)")).alias("took"),
            F.sum(words * F.round(curve / CURVE_UNIT).cast("decimal(18,0)")).alias("curve"),
        )
        g, h = F.col("took").cast("double") * RATE_UNIT - F.col("target"), F.col("curve").cast("double") * CURVE_UNIT
        tilt = F.col("tilt")
        lo, hi = F.when(g < 0, tilt).otherwise(F.col("lo")), F.when(g > 0, tilt).otherwise(F.col("hi"))
        longest = 2 * F.abs(tilt) + F.col("unit")
        step = F.when(h > 0, F.greatest(-longest, F.least(longest, -g / h))).otherwise(-F.signum(g) * longest)
        moved = F.when((tilt + step > lo) & (tilt + step < hi), tilt + step).otherwise((lo + hi) / 2)
        near = (F.abs(g) <= MISS * F.col("target")) | (hi - lo <= 1e-14 * F.abs(tilt))
        next_ = state.join(small(materialise(sums, "sums")), "source_rank", "left")
        stays = F.col("done") | near
        state = materialise(next_.select("source_rank", "target", F.when(stays, tilt).otherwise(moved).alias("tilt"), F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"), "unit", stays.alias("done")), "tilts")
    return state.select("source_rank", "tilt")


def diffuse(sizes: np.ndarray, rates: np.ndarray, most: int) -> np.ndarray:
    """Whole copies of units, given by falling size, whose running sum follows rate * size."""
    out = np.zeros(len(sizes), np.int64)
    due = 0.0
    for i, (size, own) in enumerate(zip(sizes.tolist(), rates.tolist())):
        if size <= 0:
            out[i] = min(most, int(own + 0.5))
            continue
        due += own * size
        copies = min(most, max(0, int(due / size + 0.5)))
        due -= copies * size
        out[i] = copies
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, rate, copies, taken.

    size counts words, 0 for a null or empty text; a null source is a source of its
    own; taken = copies * size and copies <= ``most``. Rows that agree in doc_id,
    source and size are one unit and get the same copies, so repeated rows and
    reruns agree. Documents without words add to no constraint and stay once. A very
    long text is one document like any other. An empty table gives an empty one. No
    other column is read, so extra ones cannot clash.
    """
    limit_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).cast("string").alias("source"), word_count(F.col(quoted(text))).alias("size"))
    units = materialise(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    cells = materialise(units.groupBy("source", "size").agg(F.sum("rows").alias("n")), "histogram")
    targets = materialise(source_targets(cells, weights, most), "targets")
    tilts = multipliers(cells.withColumn("key", source_key(F.col("source"))).drop("source"), targets, most)
    side = materialise(targets.drop("source").join(small(tilts), "source_rank"), "solved")
    placed = units.withColumn("key", source_key(F.col("source"))).join(small(side), "key")
    bucket = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n") / GROUP))
    placed = placed.withColumn("bucket", bucket).withColumn("rate", rate(F.col("tilt"), F.col("size"), most)).drop("key", "n", "tilt")
    schema = "doc_id long, source string, size long, rows long, source_size long, target double, rate double, copies int"

    def round_group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(unit=part["size"] * part["rows"]).sort_values(["unit", "doc_id", "size"], ascending=[False, True, True], kind="stable")
        part["copies"] = diffuse(part["unit"].to_numpy(), part["rate"].to_numpy(), most)
        return part[["doc_id", "source", "size", "rows", "source_size", "target", "rate", "copies"]]

    done = placed.groupBy("source_rank", "bucket").applyInPandas(round_group, schema)
    done = done.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("row", "rows")
    return done.withColumn("taken", F.col("copies") * F.col("size"))


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its copies say, all columns unchanged.

    Nulls in any column, repeated rows and columns of any name stay as they are;
    an empty table gives an empty one.
    """
    found = mix(docs, doc_id, text, source).select("doc_id", "source", "size", "copies").distinct()
    c = F.col
    # the row travels as one value, so that no name of it can clash
    here = docs.select(F.struct(*[c(quoted(x)) for x in docs.columns]).alias("row"), c(quoted(doc_id)).alias("id"), c(quoted(source)).cast("string").alias("from"), word_count(c(quoted(text))).alias("words"))
    joined = here.join(found, c("id").eqNullSafe(c("doc_id")) & c("from").eqNullSafe(c("source")) & (c("words") == c("size")))
    repeated = joined.filter(c("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), c("copies"))))
    return repeated.select("row.*")
