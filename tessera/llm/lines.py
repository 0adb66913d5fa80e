"""Incremental, reversible line deduplication.

State is a folder of immutable Parquet tables, and numbered manifests that name those of
each version; a version is committed by renaming its manifest into place, so a writer that
fails leaves the last version as it was, and of two writers one is refused.

* ``postings`` (k1, k2, doc_id): which document holds which line key, a table for each
  insertion; ``ids``: the documents of each insertion; ``deleted``: those of each deletion;
* ``counts`` (k1, k2, n_docs, max_doc, was): the exact reference counts of the keys that a
  change has touched, and the count before it; the newest row of a key holds;
* ``filters`` (shard, items, cells): one cuckoo filter per shard of the keys whose
  count has reached the threshold.

``insert`` and ``delete`` write what they change.  Keys that cross the threshold
are put into or taken out of their shard's filter, which cuckoo filters allow; a
filter that is full is made anew, with more room, from the counts, and all are when
shards hold more than ``SHARD_KEYS`` keys on average.  After ``MERGE`` changes the tables are
merged into one of each kind.  An index is opened again by its path.

``clean`` asks the filters first, at any size: lines are dealt by shard (a shard with many
lines several times) and stream past their filter.  A line that no filter holds stays
without a join.  The rest is decided by the exact counts, so false positives cost time only.

A line's key is the line with ASCII white space stripped at both ends and A-Z
lower-cased, as 128 bits of hash; keys shorter than ``min_chars`` code points don't
count.  Lines of a key found in ``threshold`` documents or more go, except in the
largest doc_id that holds it.

Null or empty text is one empty line.  Rows that share a doc_id, equal or not, count as one
document for the keys, and each loses the lines of its own text.  Of a document inserted
again, without having been deleted, keys that it held already count once.  Rows with a null
doc_id hold no keys and stay as they are.  An empty table is fine in any call.  ``clean``
keeps all columns and may overwrite the text; column names that start with ``__`` are its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, WHITE, Versions, ddl, placed, quoted, scratch, stored

MIN_CHARS, THRESHOLD = 20, 3
#: Keys that a shard's filter holds on average, at most, and changes after which the tables are merged.
SHARD_KEYS, MERGE = 1 << 14, 8
#: Lines that stream past one copy of a filter, at least, before the shard is split.
PROBED = 1 << 15
SLOTS, KICKS = 4, 500


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: 16-bit fingerprints, four to a bucket.

    Holds each inserted item once; ``delete`` takes out what was inserted.
    """

    def __init__(self, capacity: int):
        need = max(1, int(capacity / (SLOTS * 0.9)) + 1)
        self.cells = np.zeros((1 << (need - 1).bit_length(), SLOTS), np.uint16)
        self.items = 0

    @classmethod
    def of(cls, items: int, raw: bytes) -> Cuckoo:
        out = cls.__new__(cls)
        out.cells, out.items = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy(), items
        return out

    def bytes(self) -> bytes:
        return self.cells.tobytes()

    def _spots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.int64).view(np.uint64)
        mask = np.uint64(len(self.cells) - 1)
        print16 = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = h & mask
        return print16, first.astype(np.int64), self._other(first.astype(np.int64), print16)

    def _other(self, bucket, print16):
        mixed = (np.asarray(print16, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return np.asarray(bucket, np.int64) ^ (mixed & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        p, a, b = self._spots(hashes)
        return (self.cells[a] == p[:, None]).any(1) | (self.cells[b] == p[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> None:
        if len(hashes) + self.items > 0.9 * self.cells.size:
            raise OverflowError("filter too small")
        p, a, b = self._spots(hashes)
        rng = np.random.default_rng(7)
        for print16, one, two in zip(p.tolist(), a.tolist(), b.tolist(), strict=True):
            at = one if (self.cells[one] == 0).any() else two
            for _ in range(KICKS):
                free = np.flatnonzero(self.cells[at] == 0)
                if len(free):
                    self.cells[at, free[0]] = print16
                    break
                slot = int(rng.integers(SLOTS))
                print16, self.cells[at, slot] = int(self.cells[at, slot]), print16
                at = int(self._other(at, print16))
            else:
                raise OverflowError("no free slot found")
            self.items += 1

    def delete(self, hashes: np.ndarray) -> None:
        p, a, b = self._spots(hashes)
        for print16, one, two in zip(p.tolist(), a.tolist(), b.tolist(), strict=True):
            for at in (one, two):
                found = np.flatnonzero(self.cells[at] == print16)
                if len(found):
                    self.cells[at, found[0]] = 0
                    self.items -= 1
                    break


def built(hashes: np.ndarray, capacity: int) -> Cuckoo:
    """A filter of the hashes, with room for ``capacity``, larger if it must be."""
    while True:
        try:
            out = Cuckoo(max(capacity, len(hashes)))
            out.insert(hashes)
            return out
        except OverflowError:
            capacity = 2 * max(capacity, len(hashes), 8)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


class LineIndex:
    """The state below ``path`` (default: a fresh folder in the shared one), at its newest version."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 16, min_chars: int = MIN_CHARS, threshold: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text"):
        self.spark, self.path = spark, path or scratch(spark, "lines")
        self.min_chars, self.threshold, self.doc_id, self.text = min_chars, threshold, doc_id, text
        self.log = Versions(spark, f"{self.path}/manifests", "kind string, name string, seq int, shards int")
        self.version = self.log.last()
        #: (kind, name, seq, shards) of each table; MERGE bounds them.
        self.tables = [tuple(r) for r in self.log.read(self.version).collect()]
        self.shards = max([t[3] for t in self.tables], default=shards)

    _SCHEMA = {
        "postings": "k1 long, k2 long, doc_id long",
        "ids": "doc_id long",
        "deleted": "doc_id long",
        "counts": "k1 long, k2 long, n_docs long, max_doc long, was long",
        "filters": "shard int, items long, cells binary",
    }

    def _write(self, kind: str, rows: DataFrame) -> tuple[str, DataFrame]:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name, self.spark.read.schema(self._SCHEMA[kind]).parquet(f"{self.path}/{name}")

    def _all(self, kind: str) -> DataFrame:
        """All tables of a kind, each row with the version that wrote it."""
        parts = [self.spark.read.schema(self._SCHEMA[kind]).parquet(f"{self.path}/{name}").withColumn("seq", F.lit(seq)) for k, name, seq, _ in self.tables if k == kind]
        parts = parts or [self.spark.createDataFrame([], self._SCHEMA[kind]).withColumn("seq", F.lit(0))]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, kind: str) -> DataFrame:
        """Rows of postings or ids whose document has not been deleted since."""
        rows = self._all(kind)
        if not any(t[0] == "deleted" for t in self.tables):
            return rows.drop("seq")
        gone = self._all("deleted").groupBy("doc_id").agg(F.max("seq").alias("gone"))
        return rows.join(gone, "doc_id", "left").filter("gone is null or gone < seq").select(*[c for c in rows.columns if c != "seq"])

    def counts(self) -> DataFrame:
        """(k1, k2, n_docs, max_doc): the exact counts."""
        rows = self._all("counts")
        if sum(t[0] == "counts" for t in self.tables) > 1:
            rows = rows.groupBy("k1", "k2").agg(F.max(F.struct("seq", "n_docs", "max_doc")).alias("c")).select("k1", "k2", "c.n_docs", "c.max_doc")
        return rows.filter("n_docs > 0").select("k1", "k2", "n_docs", "max_doc")

    def blocked(self) -> DataFrame:
        return self.counts().filter(F.col("n_docs") >= self.threshold)

    def lines(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text_hash, at, k1, k2): the lines whose key counts, written out."""
        key = F.col("key")
        text = F.col(f"`{self.text}`")
        found = (
            docs.filter(F.col(f"`{self.doc_id}`").isNotNull())
            .select(F.col(f"`{self.doc_id}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
            .select("doc_id", "text_hash", "at", line_key(F.col("line")).alias("key"))
            .filter(F.length("key") >= self.min_chars)
        )
        return stored(found.select("doc_id", "text_hash", "at", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("second"), key).alias("k2")), "lines")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents."""
        return self._insert(self.lines(docs))

    def _insert(self, lines: DataFrame) -> LineIndex:
        added = lines.select("k1", "k2", "doc_id").distinct()
        ids = lines.select("doc_id").distinct()
        if self.version:
            again = ids.join(self._live("ids"), "doc_id", "left_semi")
            if not again.isEmpty():
                held = self._live("postings").join(again, "doc_id", "left_semi")
                added = added.join(held, ["k1", "k2", "doc_id"], "left_anti")
                ids = ids.join(self._live("ids"), "doc_id", "left_anti")
        name, postings = self._write("postings", added)
        counts = postings.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if self.version:
            old = self.counts().select("k1", "k2", F.col("n_docs").alias("was"), F.col("max_doc").alias("old_max"))
            counts = counts.join(old, ["k1", "k2"], "left").select("k1", "k2", (F.col("n_docs") + F.coalesce("was", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "old_max").alias("max_doc"), F.coalesce("was", F.lit(0)).cast("long").alias("was"))
        else:
            counts = counts.withColumn("was", F.lit(0).cast("long"))
        return self._commit([("postings", name), ("ids", self._write("ids", ids)[0])], counts)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take out documents, given by their ids in the first column; unknown ids do nothing."""
        name, ids = self._write("deleted", doc_ids.select(F.col(doc_ids.columns[0]).cast("long").alias("doc_id")).distinct())
        live = self._live("postings")
        touched = stored(live.join(ids, "doc_id", "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("gone")), "touched")
        left = live.join(touched, ["k1", "k2"], "left_semi").join(ids, "doc_id", "left_anti").groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        n = F.coalesce("n_docs", F.lit(0)).cast("long")
        return self._commit([("deleted", name)], touched.join(left, ["k1", "k2"], "left").select("k1", "k2", n.alias("n_docs"), "max_doc", (n + F.col("gone")).alias("was")))

    def _commit(self, written: list[tuple[str, str]], counts: DataFrame) -> LineIndex:
        name, counts = self._write("counts", counts)
        had = self.version
        before, seq = [t for t in self.tables if t[0] != "filters"], had + 1
        filters = self._all("filters").drop("seq")
        self.tables = before + [(k, n, seq, self.shards) for k, n in [*written, ("counts", name)]]
        try:
            up, down = F.col("n_docs") >= self.threshold, F.col("was") >= self.threshold
            changes = counts.filter(up != down).select("k1", "k2", F.when(up, 1).otherwise(-1).alias("what"))
            n_keys = (filters.agg(F.sum("items")).first()[0] or 0) + (changes.agg(F.sum("what")).first()[0] or 0)
            grown = False
            while n_keys > self.shards * SHARD_KEYS:
                self.shards, grown = 4 * self.shards, True
            if had and not grown:
                filters = self._rebuilt(stored(self._changed(filters, changes), "filters"))
            else:
                filters = self._built(self.blocked())
            self.tables = [t[:3] + (self.shards,) for t in self.tables] + [("filters", self._write("filters", filters)[0], seq, self.shards)]
            if sum(t[0] == "counts" for t in self.tables) > MERGE:
                self._merge(seq)
            self.log.commit(seq, self.spark.createDataFrame(self.tables, self.log.schema))
        except BaseException:
            self.__init__(self.spark, self.path, self.shards, self.min_chars, self.threshold, self.doc_id, self.text)  # as last committed
            raise
        self.version = seq
        return self

    def _merge(self, seq: int) -> None:
        """One table of each kind; deletions are done with."""
        rows = {"postings": self._live("postings"), "ids": self._live("ids"), "counts": self.counts().withColumn("was", F.col("n_docs"))}
        merged = [(k, self._write(k, r)[0], seq, self.shards) for k, r in rows.items()]
        self.tables = merged + [t for t in self.tables if t[0] == "filters"]

    def vacuum(self) -> int:
        """Delete tables that the newest version doesn't name; no other writer may be at work.  Returns how many went."""
        fs, top = Versions(self.spark, self.path, "").place()
        live = {t[1] for t in self.tables} | {"manifests"}
        gone = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName() not in live]
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def _shard(self) -> Column:
        return F.pmod(F.col("k1"), F.lit(self.shards)).cast("int")

    def _changed(self, filters: DataFrame, changes: DataFrame) -> DataFrame:
        """``filters`` with ``changes`` (k1, k2, what) put in (1) or taken out (-1).

        A filter that is too small for that, or missing, comes without cells and -1 items.  A
        shard holds about as many keys as any other, since k1 is a hash.
        """

        def merge(key: tuple, filters: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
            if len(filters):
                cuckoo = Cuckoo.of(int(filters["items"].iloc[0]), filters["cells"].iloc[0])
                cuckoo.delete(moves.k2[moves.what < 0].to_numpy(np.int64))
                try:
                    cuckoo.insert(moves.k2[moves.what > 0].to_numpy(np.int64))
                    return pd.DataFrame({"shard": [key[0]], "items": [cuckoo.items], "cells": [cuckoo.bytes()]})
                except OverflowError:  # fingerprints alone can't be dealt to more buckets
                    pass
            return pd.DataFrame({"shard": [key[0]], "items": [-1], "cells": [b""]})

        return filters.groupBy("shard").cogroup(changes.withColumn("shard", self._shard()).groupBy("shard")).applyInPandas(merge, self._SCHEMA["filters"])

    def _rebuilt(self, filters: DataFrame) -> DataFrame:
        """``filters`` with those that were too small made anew from all blocked keys of their shard."""
        small = filters.filter("items < 0").select("shard")
        if small.isEmpty():
            return filters
        blocked = self.blocked().withColumn("shard", self._shard()).join(small, "shard", "left_semi")
        return filters.filter("items >= 0").unionByName(self._built(blocked))

    def _built(self, blocked: DataFrame) -> DataFrame:
        def build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
            cuckoo = built(keys.k2.to_numpy(np.int64), 2 * len(keys))
            return pd.DataFrame({"shard": [key[0]], "items": [cuckoo.items], "cells": [cuckoo.bytes()]})

        return blocked.select("k2", self._shard().alias("shard")).groupBy("shard").applyInPandas(build, self._SCHEMA["filters"])

    def maybe(self, lines: DataFrame) -> DataFrame:
        """The lines whose key some filter may hold.

        Lines and filters are sorted together, the filter ahead of the lines of its shard, so
        a task holds one filter and one batch of lines.  Each ``PROBED`` lines of a shard, or
        more if there are many for each partition, go past a copy of the filter of their own.
        """
        lines = lines.withColumn("shard", self._shard())
        per = stored(lines.groupBy("shard").agg(F.count("*").alias("n")).join(self._all("filters").select("shard"), "shard"), "per-shard")
        total = per.agg(F.sum("n")).first()[0] or 0
        size = max(PROBED, total // (2 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        copies = per.select("shard", F.ceil(F.col("n") / size).cast("int").alias("copies"))
        sent = lines.join(copies, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "at"), F.col("copies")).cast("int").alias("copy"), F.lit(None).cast("binary").alias("cells"), "doc_id", "text_hash", "at", "k1", "k2")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text_hash", "long"), ("at", "int"), ("k1", "long"), ("k2", "long"))]
        filters = self._all("filters").join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "cells", *none)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuckoo = None  # of the lines that come next
            for batch in batches:
                cells, k2 = batch.column(2), batch.column(7).fill_null(0).to_numpy()
                keep = np.zeros(len(k2), bool)
                starts = np.flatnonzero(cells.is_valid().to_numpy(zero_copy_only=False)).tolist()
                for begin, end in zip([0, *starts], [*starts, len(k2)], strict=True):
                    if begin in starts:
                        cuckoo = Cuckoo.of(0, cells[begin].as_py())
                        begin += 1
                    if end > begin:
                        keep[begin:end] = cuckoo.contains(k2[begin:end])
                yield pa.RecordBatch.from_arrays(batch.columns[3:], names=["doc_id", "text_hash", "at", "k1", "k2"]).filter(pa.array(keep))

        dealt = filters.unionByName(sent).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.isnull("cells"))
        return dealt.mapInArrow(run, "doc_id long, text_hash long, at int, k1 long, k2 long")

    def dropped(self, lines: DataFrame) -> DataFrame:
        """(doc_id, text_hash, drop): the numbers, from 0, of the lines that go; documents without any are absent."""
        hit = self.maybe(lines).join(self.blocked().select("k1", "k2", "max_doc"), ["k1", "k2"])
        return hit.filter("doc_id <> max_doc").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("drop"))

    def clean(self, docs: DataFrame, digests: bool = False) -> DataFrame:
        """``docs`` without the lines that go: text changed in place, or, with ``digests``,
        (doc_id, n_lines, n_dropped, kept_sha256)."""
        return self._clean(docs, self.lines(docs), digests)

    def deduplicate(self, docs: DataFrame, digests: bool = False) -> DataFrame:
        """``insert`` and ``clean`` of the same documents, whose lines are taken once."""
        lines = self.lines(docs)
        return self._insert(lines)._clean(docs, lines, digests)

    def _clean(self, docs: DataFrame, lines: DataFrame, digests: bool) -> DataFrame:
        drop = self.dropped(lines).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("drop").alias("__drop"))
        columns = [self.doc_id] if digests else docs.columns
        frame = docs.select(*placed(docs, columns), F.col(quoted(self.text)).alias("text"), F.col(quoted(self.doc_id)).cast("long").alias("named"))
        frame = frame.join(drop, (F.col("named") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left").drop("__id", "__hash", "named")
        n = len(columns)
        place = None if digests else columns.index(self.text)
        kinds = ", ".join(ddl(docs, columns))
        schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" if digests else kinds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, max(batch.num_rows, 1), 512):
                    part = batch.slice(at, 512)
                    rows = []
                    for text, gone in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True):
                        lines = (text or "").split("\n")
                        out = set(gone or ())
                        kept = "\n".join([x for i, x in enumerate(lines) if i not in out]) if out else text
                        rows.append((len(lines), len(out), hashlib.sha256((kept or "").encode()).hexdigest()) if digests else kept)
                    if digests:
                        a, b, c = list(zip(*rows, strict=True)) or [()] * 3
                        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
                    else:
                        cols = [pa.array(rows, pa.string()) if i == place else part.column(i) for i in range(n)]
                        yield pa.RecordBatch.from_arrays(cols, names=columns)

        return frame.mapInArrow(run, schema)
