"""What the operators of this package share: tables, Arrow mapping, shared storage."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows and bytes of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_batches(spark: SparkSession) -> None:
    """Lower the session's limits on an Arrow batch to ours, as texts may be very long; lower ones stay.

    Plans read these settings when they run, after an operator has returned, so they
    cannot be set back here.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name)).strip()
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def released(run: Callable) -> Callable:
    """``run`` over batches; at its end the worker, which serves later stages too, gives unused memory back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return memory that Arrow and the C library hold but nothing uses to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python process and outlasts one task."""
    holder = sys.modules.setdefault("_spanloom_worker_cache", types.ModuleType("_spanloom_worker_cache"))
    return holder.__dict__.setdefault(name, {})


def map_columns(
    df: DataFrame,
    fn: Callable[..., Sequence],
    inputs: Sequence[str],
    outputs: Sequence[T.StructField],
    keep: Sequence[str],
) -> DataFrame:
    """Append columns computed batch by batch from Arrow columns.

    fn gets one Arrow array for each name in ``inputs`` and returns one for each
    field of ``outputs``. An input column whose name an output takes is replaced.
    """
    limit_batches(df.sparkSession)
    new = {f.name for f in outputs}
    kept = [c for c in keep if c not in new]
    source = df.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)], *[F.col(quoted(c)).alias(f"i{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept] + list(outputs))
    names, n = [f.name for f in schema], len(kept)

    def run(batches):
        for batch in batches:
            made = fn(*[batch.column(n + i) for i in range(len(inputs))])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], *made], names=names)

    return source.mapInArrow(released(run), schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so that lambdas of ``body`` do not evaluate it anew for each element."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir.

    Where the cluster names none (tests, a single machine), a temporary folder is
    set as the checkpoint folder of the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/spanloom-{uuid.uuid4().hex}"


#: The folders of steps that this process wrote.
_STEPS: list[str] = []


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step as a table in the shared folder and read it back; cuts the lineage.

    Results read steps lazily, so steps stay until ``clean_up`` or the end of the driver's process.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    _STEPS.append(folder)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def clean_up() -> None:
    """Delete the steps that this process wrote, on file systems that pyarrow reaches; results not yet read are lost."""
    while _STEPS:
        try:
            store, inner = fs.FileSystem.from_uri(_STEPS.pop())
            store.delete_dir(inner)
        except (OSError, ValueError, pa.ArrowException):
            continue


atexit.register(clean_up)


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Append the rank of each row, from 0, in a total order; sorted by ranges, so that no task sees all rows."""
    low = (1 << 33) - 1
    rows = materialise(df.orderBy(*order).withColumn("at__r", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("at__r", 33), F.col("at__r").bitwiseAND(F.lit(low))
    # one count for each partition of the sort
    sizes = sorted(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, items = 0, []
    for p, n in sizes:
        items += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += n
    base = F.create_map(*items)[part] if items else F.lit(0)
    return rows.withColumn(name, (base + place).cast("long")).drop("at__r")


def size_of(df: DataFrame) -> int:
    """Bytes that the rows of a written table take in memory, by the sizes of their values."""
    width = F.lit(16).cast("long")
    for field in df.schema:
        c = F.col(quoted(field.name))
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = width + 16 + 8 * F.coalesce(F.size(c), F.lit(0))
        else:
            width = width + 8
    return df.agg(F.sum(width)).first()[0] or 0
