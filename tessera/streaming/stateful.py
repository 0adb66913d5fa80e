"""Streams whose state is kept by key: quotas that end, and a bounded shuffle buffer.

State lies in Spark's state store and is committed with the batch, so a restart goes on where the last committed batch ended and gives the
rows that a run without it gives.  A quota's state is a number a key, a buffer's at most ``size`` rows a key.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _need_rocks(spark: SparkSession) -> None:
    """This kind of state needs the store that can hold several variables."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Quota(StatefulProcessor):
    """The first rows of a key: batch by batch, within a batch by ``order``; a full key passes nothing on."""

    def __init__(self, order: str, quotas: dict, other: int):
        self.order, self.quotas, self.other = order, quotas, other

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.taken.get()[0] if self.taken.exists() else 0
        left = self.quotas.get(key[0], self.other) - taken
        kept: pd.DataFrame | None = None
        for part in rows if left > 0 else ():  # never more than the quota and one part of the batch
            kept = (part if kept is None else pd.concat([kept, part])).sort_values(self.order, kind="stable").head(left)
        if kept is not None and len(kept):
            self.taken.update((taken + len(kept),))
            yield kept

    def close(self) -> None:
        pass


class Shuffle(StatefulProcessor):
    """A buffer of rows: one that comes when it is full takes the place of another, which is passed on.

    Which one hangs on the seed, the key and how many have come.  A row whose ``end`` column is true is no row: it empties the buffer of its key.
    Within a batch rows come by ``order``; a batch of a key must fit in a task.
    """

    def __init__(self, size: int, seed: str, order: str, end: str, schema: StructType):
        self.size, self.seed, self.order, self.end, self.schema = size, seed, order, end, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", self.schema)
        self.count = handle.getValueState("count", "came bigint, sent bigint")

    def _pick(self, key, count: int, among: int) -> int:
        return int.from_bytes(hashlib.sha1(f"{self.seed}:{key}:{count}".encode()).digest()[:8], "big") % among

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.fieldNames()
        batch = pd.concat(list(rows)).sort_values([self.end, self.order], kind="stable")
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        (came, sent), out = self.count.get() if self.count.exists() else (0, 0), []
        for row in batch[names].itertuples(index=False, name=None):
            row = tuple(x.item() if hasattr(x, "item") else x for x in row)
            if row[names.index(self.end)]:
                while held:
                    out.append(held.pop(self._pick(key, came + sent + len(out), len(held))))
                continue
            if len(held) < self.size:
                held.append(row)
            else:
                i = self._pick(key, came + sent + len(out), self.size)
                out.append(held[i])
                held[i] = row
            came += 1
        self.held.put(held) if held else self.held.clear()
        self.count.update((came, sent + len(out)))
        if out:
            yield pd.DataFrame(out, columns=names).assign(at=range(sent, sent + len(out)))

    def close(self) -> None:
        pass


def _kept(stream: DataFrame, key: str, processor: StatefulProcessor, schema) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="None")


def quota(stream: DataFrame, key: str, order: str, n: int, path: str, checkpoint: str, quotas: dict | None = None, each: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Write the first rows of each key to ``path``: ``quotas`` of the keys named there, ``n`` of any other.

    ``each``: how many keys there will be; when so many rows have been written as fill the quotas of all, the query is stopped and what the source
    still holds isn't read.  Counts of batches lie at ``path``_counts.
    """
    spark, quotas = stream.sparkSession, quotas or {}
    _need_rocks(spark)
    most = None if each is None else sum(quotas.values()) + n * (each - len(quotas))
    full: list[bool] = []

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        here = batch.sparkSession
        here.read.schema(batch.schema).parquet(f"{path}/batch={number}").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}_counts/batch={number}")
        if most is not None and (here.read.schema("n long").parquet(f"{path}_counts").agg(F.sum("n")).first()[0] or 0) >= most:
            full.append(True)

    made = _kept(stream, key, Quota(order, quotas, n), stream.schema)
    query = made.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    if most is not None:
        while query.isActive and not full:
            time.sleep(0.05)
        while full and query.isActive and query.status["isTriggerActive"] and query.lastProgress is None:
            time.sleep(0.05)  # the batch that filled the quotas is committed first
        if full:
            query.stop()
    return query


def shuffled(stream: DataFrame, key: str, order: str, size: int, seed: str, end: str = "end") -> DataFrame:
    """``stream`` with rows in the order in which they leave a buffer of ``size`` a key; ``at`` numbers a key's rows in that order."""
    _need_rocks(stream.sparkSession)
    return _kept(stream, key, Shuffle(size, seed, order, end, stream.schema), StructType([*stream.schema.fields, StructField("at", LongType())]))
