"""Named files on any file system that pyarrow can reach, and a shared folder for steps."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters of files that one batch holds.
MOST_READ = 4 << 20
#: The scratch folders of this process.
_FOLDERS: list[str] = []


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    store, inner = file_system(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def put(path: str, content: bytes) -> None:
    """Write one file under another name first, so that a reader never sees half of it."""
    store, inner = file_system(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, inner)


def write_named(rows: DataFrame, path: str, overwrite: bool = True) -> int:
    """Write a file for each row (name, value) below ``path``; executors write in parallel, a retry writes the same again.

    Returns the number of files. Without ``overwrite`` an existing folder is an error.
    """
    if not overwrite and exists(path):
        raise FileExistsError(path)
    file_system(path)[0].create_dir(file_system(path)[1], recursive=True)

    def write(batches):
        for batch in batches:
            for name, value in zip(*(batch.column(i).to_pylist() for i in range(2))):
                put(f"{path.rstrip('/')}/{name}", (value or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("name", "value").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_named(rows: DataFrame, path: str, name: str, value: str) -> DataFrame:
    """Append as ``value`` the content of the file below ``path`` that each row names; a missing file is an error.

    Nothing is listed, and files of no length count: Spark's readers skip them.
    """
    schema = T.StructType([*rows.schema, T.StructField(value, T.StringType())])

    def read(batches):
        store, inner = file_system(path.rstrip("/"))
        for batch in batches:
            first, size, values = 0, 0, []
            for i, own in enumerate(batch.column(name).to_pylist(), 1):
                with store.open_input_stream(f"{inner}/{own}", compression=None) as f:
                    values.append(f.read().decode())
                size += len(values[-1])
                if i == batch.num_rows or size > MOST_READ:
                    part = batch.slice(first, i - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.string())], names=[f.name for f in schema])
                    first, size, values = i, 0, []

    return rows.mapInArrow(read, schema)


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share: below spark.checkpoint.dir, or, on one machine without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spanloom-")
    _FOLDERS.append(f"{root.rstrip('/')}/spanloom-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def written(df: DataFrame) -> DataFrame:
    """The rows of a step, written once as a table in a fresh shared folder and read from there."""
    at = scratch(df.sparkSession)
    df.write.parquet(f"{at}/step")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/step")


def clean_up() -> None:
    """Delete the scratch folders that this process made; results not yet read from them are lost."""
    while _FOLDERS:
        try:
            store, inner = file_system(_FOLDERS.pop())
            store.delete_dir(inner)
        except (OSError, ValueError, pa.ArrowException):
            continue


atexit.register(clean_up)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
