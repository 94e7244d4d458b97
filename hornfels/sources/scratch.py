"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master a temporary folder where that is unset.  On a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="hornfels-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/hornfels-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A folder that goes when the application ends."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_mark(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all."""
    target, part = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not files.rename(part, target):
        raise OSError(f"cannot write {path}")


def read_marks(spark: SparkSession, folder: str) -> dict[str, str]:
    """The small files of a folder by name."""
    jvm, place = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = {}
    for status in files.listStatus(place) if files.exists(place) else []:
        name = status.getPath().getName()
        if not name.endswith((".part", ".crc")):
            stream = files.open(status.getPath())
            try:
                marks[name] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
    return marks


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage, gives exact sizes, survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    if not df.columns:  # Parquet needs a column
        from pyspark.sql import functions as F

        return materialize(df.select(F.lit(1).alias("_there"))).select()
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
