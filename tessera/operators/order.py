"""Deterministic selection: first of each key, first n of each group, samples, quotas, splits.

Spark rows have no order, so each takes order columns; seeds make orders by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import shuffle_key


def first_per_key(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; an aggregation, so that equal keys meet pre-combined."""
    named = df.select(F.struct(*order).alias("__o"), F.struct(*df.columns).alias("__r"), *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    best = named.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min_by("__r", "__o").alias("__r"))
    return best.select("__r.*")


def first_n_per_group(df: DataFrame, groups: list[str], n: int | Column, order: list[Column | str], number: str = "rn") -> DataFrame:
    """Spark prunes ranks beyond n before the shuffle, so a large group sends n rows a task."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).filter(F.col(number) <= n)


def sample_n(df: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    return df.orderBy(shuffle_key(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def safe_slice(df: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """The first ``n`` rows in seeded order; none if n is 0 or less."""
    return sample_n(df, n, seed, *keys) if n > 0 else df.limit(0)


def capped(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in order; all if there are fewer."""
    return df.orderBy(*order).limit(n)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts by the names of their columns; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def eval_size(n: int) -> int:
    return min(2000, max(200, n // 50))


def split_share(df: DataFrame, share: float, seed: str, *keys: str) -> DataFrame:
    """``df`` with is_eval: whether the row's hash falls below the share; no sort, no shuffle."""
    h = F.conv(F.substring(shuffle_key(seed, *[F.col(k) for k in keys]), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.withColumn("is_eval", h < share)


def without_known(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


def upsert_first(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append so that the first writer of a key wins."""
    return without_known(first_per_key(rows, [F.col(k) for k in keys], order), target, keys)
