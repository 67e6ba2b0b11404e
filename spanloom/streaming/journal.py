"""Append-only journals, replayed with last write wins, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.postprocess import latest
from ..sources import files


def replay(journal: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last event of each key."""
    return latest(journal, key, seq)


def follow(spark: SparkSession, path: str, schema: str, state: str, checkpoint: str, key: str = "key", seq: str = "seq", fmt: str = "json") -> None:
    """Take what is new in a journal folder and bring the table of last events up to date.

    A file source, ``foreachBatch`` and a checkpoint: each file counts once, and a
    batch that is repeated after a failure writes the same version again.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        old = [v for v in _versions(spark, state) if v < epoch]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{state}/v={max(old)}")) if old else batch
        latest(rows, key, seq).select(*batch.columns).write.mode("overwrite").parquet(f"{state}/v={epoch}")

    source = spark.readStream.schema(schema).format(fmt).load(path)
    query = source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def state_of(spark: SparkSession, state: str, schema: str) -> DataFrame:
    """The table of last events after the last complete batch."""
    found = _versions(spark, state)
    return spark.read.schema(schema).parquet(f"{state}/v={max(found)}") if found else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, state: str) -> list[int]:
    """The versions of a state table that are complete."""
    store, inner = files.file_system(state)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    names = [f.base_name for f in found if f.base_name.startswith("v=")]
    return sorted(int(n[2:]) for n in names if files.exists(f"{state.rstrip('/')}/{n}/_SUCCESS"))


def compact(spark: SparkSession, path: str, out: str, schema: str, key: str = "key", seq: str = "seq") -> None:
    """A checkpoint of a journal: its replay as one table."""
    replay(spark.read.schema(schema).json(path), key, seq).write.mode("overwrite").parquet(out)


def windowed_counts(events: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """Events in tumbling windows, batch or stream; a stream drops what is later than the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Run a handler on all new data, once."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
