"""Numbered manifests of tables that are written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has committed the version."""


class Versions:
    """Numbered manifests, small tables below ``path``, each committed by one writer only.

    A manifest is written under a name of its own and renamed to its version, so readers
    see a whole one or none, and a writer that dies leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def place(self, name: str = ""):
        """The file system and the path of ``name``; the driver lists and renames, no data passes through it."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def last(self) -> int:
        """The newest committed version; 0 before any."""
        fs, top = self.place()
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return max([int(n[2:]) for n in names if n.startswith("v=")], default=0)

    def read(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def commit(self, version: int, manifest: DataFrame) -> int:
        own = f".{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(f"{self.path}/{own}")
        fs, to = self.place(f"v={version}")
        if fs.exists(to) or not fs.rename(self.place(own)[1], to) or fs.exists(self.place(f"v={version}/{own}")[1]):
            raise Conflict(version)
        return version
