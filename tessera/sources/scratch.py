"""Folders for tables that one step writes and the next one reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that is unset, a folder of this machine's own is set, if all tasks run in the driver's process.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/tessera/{tag}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at the path, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def located(spark: SparkSession, path: str):
    """A folder's whole name, as Spark's readers give it, and (file system, path) if pyarrow knows it, else None."""
    from pyarrow import fs

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if at.toUri().getScheme() == "file":
        return at.toString(), (fs.LocalFileSystem(), at.toUri().getPath())
    try:
        return at.toString(), fs.FileSystem.from_uri(at.toUri().toString())
    except (ValueError, OSError):
        return at.toString(), None


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written below the shared folder and read again: its lineage ends there, and lost executors don't cost more than a stage."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
