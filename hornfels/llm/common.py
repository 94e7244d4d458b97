"""Shared plumbing of the training-data operators: scratch tables and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
"""A word: a run of anything but ASCII white space.  On UTF-8 bytes ``bytes.split()`` finds the same runs."""


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    On a local master a temporary folder does where it is unset; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="hornfels-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/hornfels-{spark.sparkContext.applicationId}"


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def persist(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read the table.  The files go when the
    application ends, or before with :func:`forget`.
    """
    spark = spark or df.sparkSession
    bounded_batches(spark)
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target, files = _place(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete persisted tables that no plan reads any more: what was made of them is written itself."""
    for df in tables:
        target, files = _place(df.sparkSession, df._scratch)
        files.delete(target, True)


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20), "spark.sql.parquet.columnarReaderBatchSize": "1024"}
"""Rows and bytes that a task holds at once beside its sorts: rows are whole texts, thousands of which need much memory."""


_DEFAULTS = ("10000", "67108864b", "67108864", "4096")


def bounded_batches(spark: SparkSession) -> None:
    """Set what of ``BATCH`` the session leaves at Spark's defaults."""
    for key, value in BATCH.items():
        if spark.conf.get(key) in _DEFAULTS:
            spark.conf.set(key, value)


def tasks(amount: int, of_a_task: int) -> int:
    """Tasks for an amount of work: those of the session's shuffles, or as many more as the data ask for."""
    set_ = int((SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()).conf.get("spark.sql.shuffle.partitions"))
    return max(set_, -(-int(amount) // of_a_task))


def free_shuffles(spark: SparkSession) -> None:
    """Collect garbage on the driver, so that Spark deletes the files of shuffles that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_TRIM_THRESHOLD, _MMAP_THRESHOLD, _MMAP_MAX = -1, -3, -4
"""Parameters of glibc's mallopt."""


def release_memory() -> None:
    """Give memory that a finished task has freed back to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def held_memory():
    """Keep what is freed for the large arrays to come, instead of asking the system for new pages each time, until the end."""
    with contextlib.suppress(OSError, AttributeError):
        c = ctypes.CDLL(None)
        c.mallopt(_MMAP_MAX, 0), c.mallopt(_TRIM_THRESHOLD, 2**31 - 1)
    try:
        yield
    finally:
        with contextlib.suppress(OSError, AttributeError):  # what glibc comes to by itself where large arrays are freed
            c.mallopt(_MMAP_MAX, 65_536), c.mallopt(_MMAP_THRESHOLD, 32 << 20), c.mallopt(_TRIM_THRESHOLD, 64 << 20)
        release_memory()


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(column, n: int):
    """A bucket number from 0 to ``n`` - 1 that depends on the value alone."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
