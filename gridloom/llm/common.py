"""Shared pieces: written intermediate tables, Arrow slicing, columns that every operator expects."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker turns into NumPy arrays at a time.
SLICE_BYTES = 2 << 20
#: Within small_batches, so while a table is written: bytes in an Arrow batch, which stand in memory on both sides of a Python worker.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send Arrow batches of BATCH_BYTES, or a single larger row."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Removes written tables, of which nothing that is still to run reads."""
    for df in tables:
        spark = df.sparkSession
        own = f"{shared_dir(spark)}/gridloom/".split(":")[-1].lstrip("/")
        for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if own in place:
                path = spark._jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty texts."""
    return column.cast(pa.large_string()).fill_null("")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; nulls are empty."""
    column = texts(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def given_back() -> None:
    """Returns freed memory to the system: idle Python workers stay, and so would what they once held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes of text, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(buffers(batch.column(column))[1]))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    given_back()


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the columns that an operator works on, under its own names: other columns cannot clash with it."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])
