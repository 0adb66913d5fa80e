"""Size-tiered compaction of shards under versioned manifests, in DataFrame operations only.

A store is a folder:

* ``data/folder=<name>/shard=S/*.parquet``: immutable shards; each write has a folder with a name of
  its own, so neither a second writer nor a repeated attempt meets the files of another;
* ``manifests/v=N``: the shards that version N consists of: folder, the version that wrote it
  (gen), rows, bytes and tier.

``append`` writes arrivals as small shards, without a shuffle.  ``compact`` looks at each
tier (shards of similar size: the power of ``FANOUT`` over ``SMALL`` bytes); in a tier
with ``FANOUT`` shards or more it merges runs of them, in order, into shards of
about ``TARGET`` bytes.  Both write data first and then commit: the manifest is written
under a name of its own and renamed to its version, which only one writer can do; the other
is refused with ``Conflict`` and may try again.  Readers see a whole version or none, and read
only the folders that it names; a lost executor or a failed job leaves files that no manifest
names.  Older versions stay readable until ``vacuum``.

A shard's bytes are those of the texts, as UTF-8 (null: 0).  Rows with a null key arrive
in shard -1.  Repeated rows are kept.  Appending an empty table commits a version without
new shards.  Columns named ``gen`` or ``shard``, or as the manifest's, are refused.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Conflict, Versions, scratch

SMALL, TARGET, FANOUT = 1 << 20, 32 << 20, 4
MANIFEST = "folder string, gen int, shard long, n_rows long, n_bytes long, tier int"
__all__ = ["Conflict", "ShardStore"]


class ShardStore:
    def __init__(self, spark: SparkSession, path: str | None = None, text: str = "text", small: int = SMALL, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.path, self.text = spark, path or scratch(spark, "shards"), text
        self.small, self.target, self.fanout = small, target, fanout
        self.log = Versions(spark, f"{self.path}/manifests", MANIFEST)

    def version(self) -> int:
        """The newest committed version; 0 before any."""
        return self.log.last()

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.log.read(self.version() if version is None else version)

    def _tier(self) -> Column:
        """0 up to SMALL bytes, then one more for each power of FANOUT."""
        return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col("n_bytes"), F.lit(1)) / self.small) / F.log(F.lit(float(self.fanout))))).cast("int")

    def _listed(self, gen: int, folder: str, schema) -> DataFrame:
        """Manifest rows of the shards in a folder, counted from their files."""
        bytes_ = F.coalesce(F.octet_length(F.col(f"`{self.text}`")), F.lit(0)).cast("long")
        counted = self._data([folder], schema).groupBy("folder", "shard").agg(F.count("*").alias("n_rows"), F.sum(bytes_).alias("n_bytes"))
        return counted.select("folder", F.lit(gen).alias("gen"), "shard", "n_rows", "n_bytes", self._tier().alias("tier"))

    def _data(self, folders: list[str], schema) -> DataFrame:
        """The rows in the folders, with folder and shard.  There are as many folders as writes still in use."""
        full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["folder string", "shard long"])
        if not folders:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/folder={f}" for f in folders])

    @staticmethod
    def _folders(manifest: DataFrame) -> list[str]:
        return sorted(r.folder for r in manifest.select("folder").distinct().collect())

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.partitionBy("shard").option("compression", "zstd").parquet(f"{self.path}/data/folder={folder}")
        return folder

    def append(self, rows: DataFrame, shard: Column) -> int:
        """Write arrivals; ``shard`` numbers the small shard of each row."""
        own = {x.split()[0] for x in MANIFEST.split(", ")} & set(rows.columns)
        if own:
            raise ValueError(f"columns named {', '.join(sorted(own))} are the store's own")
        before = self.version()
        folder = self._write(rows.withColumn("shard", F.coalesce(shard.cast("long"), F.lit(-1).cast("long"))))
        return self.log.commit(before + 1, self.manifest(before).unionByName(self._listed(before + 1, folder, rows.schema)))

    def plan(self, manifest: DataFrame) -> DataFrame:
        """(folder, shard, to): the shards to merge and the number of their merged shard.

        Runs are cut where the bytes before a shard pass a multiple of the target.
        The manifest is metadata: one row for each shard of a tier in a window.
        """
        order = Window.partitionBy("tier").orderBy("gen", "shard", "folder")
        full = manifest.filter(F.col("n_bytes") < self.target).withColumn("n", F.count("*").over(Window.partitionBy("tier"))).filter(F.col("n") >= self.fanout)
        before = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")
        return full.select("folder", "shard", (F.col("tier") * (1 << 32) + F.floor(before / self.target)).cast("long").alias("to"))

    def compact(self, columns) -> int:
        """Merge where a tier is full; ``columns``: the schema of the rows.  Returns the version, a new one if anything moved."""
        old = self.version()
        manifest = self.manifest(old)
        plan = self.plan(manifest)
        if plan.isEmpty():
            return old
        rows = self._data(self._folders(plan), columns)
        # A merged shard is one task's work: its bytes are bounded by twice the target.
        moved = rows.join(plan, ["folder", "shard"]).drop("folder", "shard").withColumnRenamed("to", "shard").repartition(F.col("shard"))
        folder = self._write(moved)
        kept = manifest.join(plan, ["folder", "shard"], "left_anti")
        return self.log.commit(old + 1, kept.unionByName(self._listed(old + 1, folder, columns)))

    def read(self, columns, version: int | None = None) -> DataFrame:
        """The rows of a version, with gen, shard, and their shard's n_rows, n_bytes and tier."""
        manifest = self.manifest(version)
        return self._data(self._folders(manifest), columns).join(manifest, ["folder", "shard"]).drop("folder")

    def vacuum(self, keep: int = 1, older_than_s: float = 86400) -> int:
        """Delete folders that none of the last ``keep`` versions names and that have not changed for
        ``older_than_s`` seconds (a writer may still be at work on younger ones); returns how many went."""
        last = self.version()
        live = {f for v in range(max(1, last - keep + 1), last + 1) for f in self._folders(self.manifest(v))}
        fs, top = Versions(self.spark, f"{self.path}/data", "").place()
        young = time.time() - older_than_s
        gone = [s.getPath() for s in (fs.listStatus(top) if fs.exists(top) else []) if s.getPath().getName().removeprefix("folder=") not in live and s.getModificationTime() / 1000 <= young]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
