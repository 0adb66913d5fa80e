"""A table with a unique key, kept in buckets of it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.order import first_per_key
from tessera.sources.scratch import stored

BUCKETS = 32


class KeyedTable:
    """Rows of ``schema`` below ``path``, of each key the first that came.

    Files are dealt to ``buckets`` by the key's hash when they are written.  A batch is dealt the same way and meets each bucket where it lies, of which only
    the keys are read: what is held is never shuffled, however large it has grown.  The number of buckets stays as it was when the table
    was made; the session's catalog learns of the table again in each session.  Null keys are equal to none and come in each time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.keys, self.buckets, self.columns = spark, keys, buckets, schema.fieldNames()
        self.name = "keyed_" + hashlib.sha1(path.encode()).hexdigest()[:16]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet CLUSTERED BY ({', '.join(f'`{k}`' for k in keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self, spark: SparkSession | None = None) -> DataFrame:
        """The table as it is now; a stream's batches have a session of their own."""
        spark = spark or self.spark
        spark.catalog.refreshTable(self.name)
        return spark.table(self.name)

    def new(self, rows: DataFrame) -> DataFrame:
        """The rows whose key the table lacks; only they are dealt."""
        dealt = rows.repartition(self.buckets, *[F.col(k) for k in self.keys])
        held = self.read(rows.sparkSession).select(*self.keys).hint("merge")  # what is held is not to be sent anywhere
        return dealt.join(held, self.keys, "left_anti").select(*self.columns)

    def insert_first(self, batch: DataFrame, order: list[str]) -> tuple[int, int]:
        """Insert the first row, by ``order``, of each key that the table lacks; returns how many keys came and how many were inserted."""
        came, inserted = Observation(), Observation()
        first = stored(first_per_key(batch, [F.col(k) for k in self.keys], order).observe(came, F.count(F.lit(1)).alias("n")), "batch")
        rows = self.new(first).observe(inserted, F.count(F.lit(1)).alias("n"))
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, *self.keys).saveAsTable(self.name)
        return came.get["n"] or 0, inserted.get["n"] or 0
