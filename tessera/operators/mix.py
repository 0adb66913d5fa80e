"""Mixing of pools: quotas, shares, repeats.

Rows are numbered in the order of a seeded hash, without one task holding a pool: the
hash's first bits are its slot, slots are numbered apart and moved by the sizes of
the slots before.  Quotas are tables of a row a bucket, whose number is configured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import shuffle_key, unit
from tessera.sources.scratch import stored


#: Rows of a slot on average, about; a table of n rows is numbered in n / SLOT tasks.
SLOT = 1 << 15


def numbered(df: DataFrame, groups: list[str], seed: str, *keys: str, to: str = "at") -> DataFrame:
    """``df`` with the place (from 0) of each row of a group in the order of its hash, then its keys.

    A group's rows are dealt to slots by the first 32 bits of the hash, as many as the largest group needs.
    """
    sizes = df.groupBy(*groups).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits = min(32, max(0, (int(sizes) // SLOT).bit_length()))
    h = shuffle_key(seed, *[F.col(k) for k in keys])
    first = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long")
    rows = df.withColumn("__h", h).withColumn("__slot", F.shiftright(first, 32 - bits))
    slots = rows.groupBy(*groups, "__slot").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot
    base = slots.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("__slot").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    same = F.col("__slot") == F.col("__s")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inside = F.row_number().over(Window.partitionBy(*groups, "__slot").orderBy("__h", *keys))
    out = rows.withColumn("__in", inside).join(base, same)
    return out.select(*df.columns, (F.col("__base") + F.col("__in") - 1).alias(to))


def running(df: DataFrame, group: str, order: str, value: Column, to: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group that stand before it by ``order``.

    Rows are dealt by ranges of (group, order) into slots of about ``SLOT`` rows, however unevenly the order's values lie, which are summed up
    apart; a slot starts at what those before it hold.  Equal places of a group are summed in no particular order.
    """
    parts = max(1, df.count() // SLOT + 1)
    # Written, since the ranges' bounds come from a sample and must not change.
    rows = stored(df.withColumn("__v", value).repartitionByRange(parts, group, order).withColumn("__slot", F.spark_partition_id()), "slots")
    slots = rows.groupBy(F.col(group).alias("__g"), F.col("__slot").alias("__s")).agg(F.sum("__v").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot
    base = slots.select("__g", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.sum("__v").over(Window.partitionBy(group, "__slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("__in", F.coalesce(inside, F.lit(0))).join(base, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__slot") == F.col("__s")))
    return out.select(*df.columns, (F.col("__base") + F.col("__in")).alias(to))


def capped_target(n: int, ratio: float, least: int | None = None, most: int | None = None, most_first: bool = False) -> int:
    """``n`` times ratio within bounds; where these cross, the one applied last wins."""
    target = int(n * ratio)
    for is_most in (True, False) if most_first else (False, True):
        bound = most if is_most else least
        if bound is not None:
            target = min(target, bound) if is_most else max(target, bound)
    return target


def share_beside(n: int, share: float) -> int:
    """Rows to add to ``n`` so that they make up ``share`` of all."""
    return int(n * share / (1 - share))


def shrunk(available: dict[str, int], caps: dict[str, int], most: int, floor: int, order: list[str]) -> dict[str, int]:
    """Quotas of at most cap and supply; what exceeds ``most`` goes from the buckets in ``order``, none below ``floor``."""
    quota = {b: min(c, available.get(b, 0)) for b, c in caps.items()}
    over = sum(quota.values()) - most
    for b in order:
        cut = max(0, min(over, quota[b] - floor))
        quota[b] -= cut
        over -= cut
    return quota


def by_weight(available: dict[str, int], weights: dict[str, float], total: int) -> dict[str, int]:
    whole = sum(weights.values())
    return {b: min(int(total * w / whole), available.get(b, 0)) for b, w in weights.items()}


def supply(df: DataFrame, bucket: str) -> dict[str, int]:
    """Rows of each bucket; buckets are few."""
    return {r[0]: r[1] for r in df.groupBy(bucket).agg(F.count("*")).collect()}


def take(df: DataFrame, bucket: str, quota: dict[str, int], seed: str, *keys: str) -> DataFrame:
    """The first rows of each bucket by hash, as many as its quota."""
    table = df.sparkSession.createDataFrame(list(quota.items()) or [("", 0)], f"`{bucket}` string, __quota long")
    return numbered(df, [bucket], seed, *keys, to="__at").join(F.broadcast(table), bucket).filter("__at < __quota").drop("__at", "__quota")


def draws(spark: SparkSession, n: int, weights: dict[str, float], seed: str) -> DataFrame:
    """(i, bucket, u): n draws of a bucket by weight, with a number from 0 to 1."""
    whole, low, chosen = sum(weights.values()), 0.0, None
    u = unit(seed + "b", F.col("id"))
    for b, w in weights.items():
        low += w / whole
        chosen = F.when(u < low, b) if chosen is None else chosen.when(u < low, b)
    return spark.range(n).select(F.col("id").alias("i"), chosen.otherwise(b).alias("bucket"), unit(seed + "i", F.col("id")).alias("u"))


def with_replacement(df: DataFrame, bucket: str, weights: dict[str, float], n: int, seed: str, *keys: str) -> DataFrame:
    """``n`` rows (column i), drawn with repeats from pools by weight; empty pools lose their weight."""
    sizes = supply(df.filter(F.col(bucket).isin(*weights)), bucket)
    weights = {b: w for b, w in weights.items() if sizes.get(b)}
    if not weights:
        return df.limit(0).withColumn("i", F.lit(None).cast("long"))
    table = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    wanted = draws(df.sparkSession, n, weights, seed).select("i", F.col("bucket").alias(bucket), F.floor(F.col("u") * table[F.col("bucket")]).alias("at"))
    return wanted.join(numbered(df, [bucket], seed, *keys), [bucket, "at"]).drop("at")


def filled_up(df: DataFrame, k: int, seed: str, *keys: str) -> DataFrame:
    """The first ``k`` rows by hash; if there are fewer, all of them and as many drawn again as lack (column draw: -1, else the draw's number)."""
    n = df.count()
    if n >= k or not n:
        return numbered(df, [], seed, *keys, to="__at").filter(F.col("__at") < k).drop("__at").withColumn("draw", F.lit(-1).cast("long"))
    wanted = df.sparkSession.range(k - n).select(F.col("id").alias("draw"), F.floor(unit(seed + "i", F.col("id")) * n).alias("__at"))
    again = numbered(df, [], seed, *keys, to="__at").join(wanted, "__at").drop("__at")
    return df.withColumn("draw", F.lit(-1).cast("long")).unionByName(again.select(*df.columns, "draw"))


def rotated(df: DataFrame, templates: list[str], seed: str, *keys: str, to: str = "template") -> DataFrame:
    """A template for each row, in turn by the row's place."""
    each = F.array(*[F.lit(t) for t in templates])
    return numbered(df, [], seed, *keys, to="__at").withColumn(to, F.element_at(each, (F.col("__at") % len(templates) + 1).cast("int"))).drop("__at")
