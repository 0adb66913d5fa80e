"""Streaming: exactly-once ingest of a file stream, token windows, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.keyed import BUCKETS, KeyedTable
from tessera.sources.scratch import exists


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Append rows whose keys the table lacks; the first writer of a key wins.

    The table is kept in buckets of its keys, so a batch is dealt to them and the table isn't dealt at all.  A batch that is run again finds its
    own keys there and adds nothing, so a restart repeats nothing and loses nothing.
    Each batch leaves a row of counts (batch, seen, selected, inserted) at ``path``_progress, the first time that it is through.
    """
    table = KeyedTable(stream.sparkSession, path, stream.schema, keys, buckets)

    def commit(batch: DataFrame, number: int) -> None:
        told = Observation()
        seen = batch.observe(told, F.count(F.lit(1)).alias("seen"))
        selected, inserted = table.insert_first(seen, order)
        counts = batch.sparkSession.createDataFrame([(told.get["seen"], selected, inserted)], "seen long, selected long, inserted long")
        if not exists(batch.sparkSession, f"{path}_progress/batch={number}/_SUCCESS"):
            counts.coalesce(1).write.mode("overwrite").parquet(f"{path}_progress/batch={number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, keys: list[str], order: list[str], files: int | None = None) -> None:
    """Take in what has come since the last run, in batches of ``files`` files."""
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    ingest(reader.parquet(source), path, checkpoint, keys, order).awaitTermination()


def token_windows(stream: DataFrame, tokens: Column, length: int, *keys: str) -> DataFrame:
    """(keys, at, tokens): each row's tokens in runs of exactly ``length``; a rest that is shorter is left out.  Streams and tables alike."""
    n = F.floor(F.size("__t") / length).cast("int")
    runs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("__t", i * length + 1, F.lit(length)))).otherwise(F.array().cast("array<array<string>>"))
    return stream.withColumn("__t", tokens.cast("array<string>")).select(*keys, F.posexplode(runs).alias("at", "tokens"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(batch, seen, selected, inserted) of the batches of ``ingest``."""
    return spark.read.schema("seen long, selected long, inserted long, batch long").parquet(f"{path}_progress")
