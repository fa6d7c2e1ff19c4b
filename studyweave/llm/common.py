"""Helpers shared by the training-data operators: shared storage, bounded broadcasts, Arrow buffers."""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None

#: Where intermediate tables go on a single machine whose session names no shared folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/studyweave"

#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: JVM and Python hold a batch each.
BATCH_ROWS = 2_000
BATCH_BYTES = 4_000_000

#: Bytes that a broadcast may hold, by counted rows and their size.
BROADCAST_BYTES = 16_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one on a single machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or LOCAL_CHECKPOINTS


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless its user chose sizes."""
    for key, default, bound in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", f"{64 << 20}b", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, bound)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hand_back() -> None:
    """Give freed memory back to the system between batches, so that workers that live on stay small."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


_scratch: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below this application's own folder."""
    top = f"{shared_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    _scratch[top] = spark
    return f"{top}/{tag}-{uuid.uuid4().hex}"


@atexit.register
def release() -> None:
    """Delete all intermediate tables of this process; results that still read them must have been written before."""
    while _scratch:
        top, spark = _scratch.popitem()
        if spark.sparkContext._jsc is not None:  # not stopped
            remove(spark, top)


def materialise(df: DataFrame, tag: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str | None) -> None:
    """Delete tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in filter(None, paths):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def table_path(df: DataFrame) -> str | None:
    """Folder of a table made by materialise(); None if it has no file."""
    files = df.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: float = 16) -> DataFrame:
    """A broadcast hint only behind a check of counted rows and their size; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def byte_slices(offsets, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string column whose bytes stay under limit (a longer single row stands alone)."""
    start, n = 0, len(offsets) - 1
    for i in range(n):
        if offsets[i + 1] - offsets[start] > limit and i > start:
            yield start, i
            start = i
    if n > start:
        yield start, n


def text_buffers(column: pa.Array):
    """(bytes, offsets) of a string column, nulls as empty texts; no Python strings are made."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets
