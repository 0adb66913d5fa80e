"""Merging of intervals, without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored


#: Starts of a group that one task may sweep.
HELD = 1 << 16


def merged(df: DataFrame, group: str, start: str, stop: str, gap: int = 1, parts: int | None = None, held: int = HELD) -> DataFrame:
    """(group, start, stop): the group's intervals, joined where one starts at most ``gap`` after the end of those before it.

    Equal starts are one row.  If a group has more than ``held`` of them, rows are dealt by ranges of (group, start) into ``parts`` slots (default: the shuffle's partitions), so a
    hot group takes many; each slot is swept apart, and starts from the greatest end of the group's slots before.
    An interval joins the last new one at or before it, which may lie in an earlier slot.  Rows with a null start or stop are left out.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(group).alias("g"), F.col(start).cast("long").alias("s"), F.col(stop).cast("long").alias("e")).filter("s is not null and e is not null")
    one = rows.groupBy("g", "s").agg(F.max("e").alias("e"))
    named = [F.col("g").alias(group), F.col("first").alias(start), F.col("e").alias(stop)]
    if (one.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= held:
        whole = Window.partitionBy("g").orderBy("s")
        before = F.max("e").over(whole.rowsBetween(Window.unboundedPreceding, -1))
        new = one.withColumn("new", F.when(before.isNull() | (F.col("s") > before + gap), F.col("s")))
        return new.withColumn("first", F.max("new").over(whole.rowsBetween(Window.unboundedPreceding, 0))).groupBy("g", "first").agg(F.max("e").alias("e")).select(*named)
    # Written, since the ranges' bounds come from a sample and must not change.
    swept = stored(one.repartitionByRange(parts, "g", "s").withColumn("slot", F.spark_partition_id()), "slots")
    own = Window.partitionBy("g", "slot").orderBy("s")
    earlier = Window.partitionBy("g").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot

    def with_carried(rows: DataFrame, what, to: str) -> DataFrame:
        slots = rows.groupBy("g", "slot").agg(what.alias("x")).select(F.col("g").alias("__g"), F.col("slot").alias("__slot"), F.max("x").over(earlier).alias(to))
        return rows.join(slots, F.col("g").eqNullSafe(F.col("__g")) & (F.col("slot") == F.col("__slot"))).drop("__g", "__slot")

    reach = with_carried(swept, F.max("e"), "carried")
    before = F.greatest("carried", F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1)))  # null where nothing is before
    new = reach.select("g", "slot", "s", "e", F.when(before.isNull() | (F.col("s") > before + gap), F.col("s")).alias("new"))
    new = stored(new, "new")
    joined = with_carried(new, F.max("new"), "carried")
    first = F.coalesce(F.max("new").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"))
    return joined.select("g", first.alias("first"), "e").groupBy("g", "first").agg(F.max("e").alias("e")).select(*named)
