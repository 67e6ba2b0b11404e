"""Splits, samples and weights; every draw is a hash, so reruns and retries agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import hash_int, hash_unit

VALIDATION_DOCUMENTS, VALIDATION_SYNTHETIC, SEED = 15, 200, 20260730


def bernoulli(p: float | Column, *parts: Column) -> Column:
    """True with probability p, decided by the parts."""
    return hash_unit(*parts) < (F.lit(p) if isinstance(p, float) else p)


def hash_split(id: Column, test: float = 0.05, val: float = 0.05) -> Column:
    """Test, val or train by the first 8 hex digits of sha256 of the id."""
    u = hash_unit(id)
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def first_by_hash(df: DataFrame, k: int, seed: int, id: str = "id") -> DataFrame:
    """K rows in hash order of (seed, id): a take-ordered, not a full sort."""
    return df.withColumn("draw__", F.sha2(F.concat_ws(":", F.lit(seed), F.col(id)), 256)).orderBy("draw__", id).limit(k).drop("draw__")


def hold_out(records: DataFrame, kind: Column, documents: int = VALIDATION_DOCUMENTS, synthetic: int = VALIDATION_SYNTHETIC, seed: int = SEED, id: str = "id") -> DataFrame:
    """R2: adds split: the first documents and synthetic records by hash are val, the rest train.

    kind: ``document``, ``synthetic`` or anything else, which always trains.
    """
    df = records.withColumn("kind__", kind)
    val = first_by_hash(df.filter("kind__ = 'document'").select(id), documents, seed, id).unionByName(first_by_hash(df.filter("kind__ = 'synthetic'").select(id), synthetic, seed, id))
    return df.drop("kind__").join(F.broadcast(val.withColumn("val__", F.lit(True))), id, "left").withColumn("split", F.when(F.col("val__"), "val").otherwise("train")).drop("val__")


def ratio_split(df: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42, id: str = "id") -> DataFrame:
    """Splits whole notes by hash share; the number is exact in expectation."""
    u = hash_unit(F.lit(seed), F.col(id))
    return df.withColumn("split", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def oversample(df: DataFrame, times: Column, index: str = "copy") -> DataFrame:
    """Every row ``times`` times, numbered from 1."""
    return df.withColumn(index, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))


def leaked_ids(train: DataFrame, held: DataFrame, id: str = "id") -> DataFrame:
    """Ids in both; a correct split has none."""
    return train.select(id).distinct().join(held.select(id), id, "left_semi")


def assert_disjoint(train: DataFrame, held: DataFrame, id: str = "id") -> None:
    """Raise if an id is in both."""
    if leaked_ids(train, held, id).limit(1).count():
        raise ValueError(f"{id} is in the training split and in a held-out one")


def union_sources(sources: dict[str, DataFrame], exclude: Sequence[str] = ()) -> DataFrame:
    """All sources but the excluded; an unknown name is an error."""
    unknown = set(exclude) - set(sources)
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    out = None
    for name, df in sources.items():
        if name not in exclude:
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def id_set(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """L4: the union, intersection or difference (except) of two sets of ids, with the operation's name."""
    made = {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}
    if op not in made:
        raise ValueError(f"no such operation: {op}")
    return made[op]().withColumn("op", F.lit(op))


def stable_distinct(values: Column) -> Column:
    """The members of an array without repeats, each at its first place."""
    return F.array_distinct(values)


def mass_weights(windows: DataFrame, gold_mass: float = 0.5, standalone: float = 0.6, held_source: str = "part3") -> DataFrame:
    """Adds bucket and sample_weight; a bucket's windows share its mass, the sum is the number of windows.

    Buckets: segment and document share 1 - gold_mass; gold of the held source
    takes half of gold_mass where it exists, other gold the rest. Buckets without
    windows give their mass to nobody before the final scaling. Other kinds have
    weight 0 and are meant to be rejected before.
    """
    gold = F.col("record_kind").startswith("gold")
    bucket = (
        F.when(F.col("record_kind") == "segment", "segment")
        .when(F.col("record_kind") == "document", "document")
        .when(gold & (F.col("source") == held_source), "held_gold")
        .when(gold, "gold")
        .otherwise("none")
    )
    df = windows.withColumn("bucket", bucket)
    counts = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n__"))
    held = F.max(F.when(F.col("bucket") == "held_gold", 1).otherwise(0)).over(Window.partitionBy())
    mass = (
        F.when(F.col("bucket") == "segment", (1 - gold_mass) * standalone)
        .when(F.col("bucket") == "document", (1 - gold_mass) * (1 - standalone))
        .when(F.col("bucket") == "held_gold", gold_mass / 2)
        .when(F.col("bucket") == "gold", gold_mass - F.when(held == 1, gold_mass / 2).otherwise(0.0))
        .otherwise(0.0)
    )
    table = counts.withColumn("mass__", mass)
    whole = Window.partitionBy()
    table = table.withColumn("scale__", F.sum("n__").over(whole) / F.sum("mass__").over(whole))
    table = table.select("bucket", (F.col("mass__") / F.col("n__") * F.col("scale__")).alias("sample_weight"))
    return df.join(F.broadcast(table), "bucket")  # five rows at most


def weighted_sample(df: DataFrame, weight: str, k: int, seed: int, id: str = "id", bucket_rows: int = 100_000) -> DataFrame:
    """K draws with replacement by weight: a cumulative sum and a range join.

    The cumulative sum runs per hash bucket with the buckets' totals before it. There are
    at least 64 buckets and one for each ``bucket_rows`` rows, so no task sorts more than that.
    """
    buckets = max(64, -(-df.count() // bucket_rows))
    rows = df.withColumn("b__", (hash_int(F.col(id)) % buckets).cast("int"))
    totals = rows.groupBy("b__").agg(F.sum(weight).alias("t__"))
    order = Window.orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base__", F.coalesce(F.sum("t__").over(order), F.lit(0.0))).withColumn("all__", F.sum("t__").over(Window.partitionBy()))
    inner = Window.partitionBy("b__").orderBy(id)
    placed = rows.join(F.broadcast(totals), "b__")
    placed = placed.withColumn("hi__", F.col("base__") + F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("lo__", F.col("hi__") - F.col(weight))
    spark = df.sparkSession
    draws = spark.range(k).select(F.col("id").alias("draw"), hash_unit(F.lit(seed), F.col("id")).alias("u__"))
    edges = totals.select("b__", F.col("base__").alias("from__"), (F.col("base__") + F.col("t__")).alias("to__"), "all__")
    binned = draws.join(F.broadcast(edges), (F.col("u__") * F.col("all__") >= F.col("from__")) & (F.col("u__") * F.col("all__") < F.col("to__")))
    hit = binned.select("draw", "b__", (F.col("u__") * F.col("all__")).alias("x__"))
    out = placed.join(hit, "b__").filter((F.col("x__") >= F.col("lo__")) & (F.col("x__") < F.col("hi__")))
    return out.drop("b__", "t__", "base__", "all__", "hi__", "lo__", "x__")


def weighted_choice(names: Sequence[str], weights: Sequence[float], *parts: Column) -> Column:
    """One of the names by weight, decided by the parts."""
    u, total, out, at = hash_unit(*parts), float(sum(weights)), None, 0.0
    for name, w in list(zip(names, weights))[:-1]:
        at += w / total
        out = F.when(u < at, F.lit(name)) if out is None else out.when(u < at, F.lit(name))
    return F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1]))


def weighted_order(names: Sequence[str], weights: Sequence[float], *parts: Column) -> Column:
    """The names in a random order where heavier ones tend to come first (smallest -ln(u) / weight)."""
    keyed = [F.struct((-F.ln(F.greatest(hash_unit(*parts, F.lit(n)), F.lit(1e-12))) / F.lit(float(w))).alias("k"), F.lit(n).alias("n")) for n, w in zip(names, weights)]
    return F.transform(F.array_sort(F.array(*keyed)), lambda x: x["n"])
