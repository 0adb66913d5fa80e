"""Packing of sequences into bins of a size, by the histogram of their lengths.

How many rows have each length is all that best fit needs: the histogram has at most ``size`` entries and is worked on where it
is, on the driver.  Lengths go from the longest down; as many rows of a length as fit fill the bin with the least room left that takes
one, and bins in the same state are counted together, so the work hangs on the size and not on the rows.  The outcome is a list of
segments: the rows of a length from one rank to another go to so many consecutive bins.  Rows get their rank within their
length by slots of a hash and meet their segment by length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.mix import numbered

#: Segments that may be sent to all tasks; beyond, the join is left to the planner.
FEW = 100_000


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, first bin, rows a bin): row r goes to bin first + (r - from) // rows a bin."""
    out: list[tuple[int, int, int, int, int]] = []
    open_: list[tuple[int, int, int]] = []  # (room, first bin, bins) of bins in the same state, by room
    made = 0
    for length in sorted((n for n in counts if n > 0), reverse=True):
        if length > size:
            raise ValueError(f"length {length} is over the size {size}")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(open_, (length,))
            if at < len(open_):
                room, first, bins = open_.pop(at)
            else:
                room, first, bins = size, made, -(-left // (size // length))
                made += bins
            each = room // length
            full = min(bins, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each))
                rank, left = rank + full * each, left - full * each
                insort(open_, (room - each * length, first, full)) if room > each * length else None
            if full < bins and left:  # fewer than a bin takes
                out.append((length, rank, rank + left, first + full, each))
                insort(open_, (room - left * length, first + full, 1))
                full, rank, left = full + 1, rank + left, 0
            if full < bins:
                insort(open_, (room, first + full, bins - full))
    return out


def packed(df: DataFrame, length: Column, size: int, seed: str, *keys: str, to: str = "bin") -> DataFrame:
    """``df`` with length (at most ``size``: longer rows are cut there, those without length have none) and bin.

    Rows of a length are in the order of a seeded hash of ``keys``.
    """
    rows = df.withColumn("length", length.cast("long")).filter("length > 0").withColumn("length", F.least("length", F.lit(size).cast("long")))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    segments = best_fit(counts, size)
    table = df.sparkSession.createDataFrame(segments or [(0, 0, 0, 0, 1)], "__length long, __low long, __high long, __first long, __each long")
    table = F.broadcast(table) if len(segments) <= FEW else table
    placed = numbered(rows, ["length"], seed, *keys, to="__rank")
    both = placed.join(table, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high")))
    return both.select(*rows.columns, (F.col("__first") + F.expr("(__rank - __low) div __each")).alias(to))


def fill(bins: DataFrame, size: int) -> DataFrame:
    """One row: bins, tokens, the share of the bins that they fill, and the fullest one's tokens."""
    each = bins.groupBy("bin").agg(F.sum("length").alias("n"))
    return each.agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"), F.round(F.sum("n") / (F.count("*") * size), 6).alias("fill"), F.max("n").alias("fullest"))
