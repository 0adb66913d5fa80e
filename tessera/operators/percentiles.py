"""Exact percentiles of groups of any size.

A group's percentile lies between two of its ordered values.  A group of at most ``HELD`` values is sorted in one buffer.
Of a larger one each wanted rank is narrowed down: a sketch (KLL, of constant size) of the values that are still possible gives two
pivots around the rank, one pass counts exactly what lies below, between and above them, and the part that holds
the rank is what is possible next, sketched in the same pass.  A part leaves a few hundredths of the values, so 10^12 of them
take five passes.  It is settled when its values are all the same or at most ``HELD``, which are then sorted.  Pivots
only choose where to cut; the counts decide, so the answer is exact whatever the sketch says.

Each pass is an aggregation that combines in the tasks; what is kept of a group is a row for each rank.  Nulls are no values, NaN
is the greatest one.  A group without values has null percentiles.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

#: Values that one buffer may hold, and steps of the shares at which a sketch is asked for pivots; a part is three steps.
HELD, STEPS = 1 << 16, 50


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(and_, [left[n].eqNullSafe(right[n]) for n in names], F.lit(True))


def _joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """Null groups meet each other."""
    other = right.select(*[F.col(n).alias(f"__{n}") if n in names else F.col(n) for n in right.columns])
    on = reduce(and_, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names], F.lit(True) if also is None else also)
    out = left.join(other, on, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"__{n}" for n in names])


def _interpolated(at: Column, low: Column, high: Column) -> Column:
    share = at - F.floor(at)
    return F.when(share == 0, low).otherwise((1 - share) * low + share * high)


def _narrowed(rows: DataFrame, groups: list[str], state: DataFrame, held: int) -> DataFrame:
    """(groups, rank, value) of each rank of ``state`` (groups, rank, below, inside, low, high, sketch): ``below`` values are less than low,
    ``inside`` are from low to high, which are values themselves."""
    columns = [*groups, "rank", "below", "inside", "low", "high", "sketch"]
    open_ = (F.col("inside") > held) & ~F.col("low").eqNullSafe(F.col("high"))
    settled = []
    while True:
        state = stored(state.select(*columns), "ranks")
        settled.append(state.filter(~open_).drop("sketch"))
        state = state.filter(open_)
        if state.isEmpty():
            break
        at = (F.col("rank") - F.col("below")) / F.col("inside")
        step = F.floor(at * STEPS).cast("int")  # of the array from 1
        pivots = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))
        cuts = state.withColumn("p", pivots).withColumn("a", F.greatest("low", F.element_at("p", F.greatest(F.lit(1), step)))).withColumn("b", F.least("high", F.element_at("p", F.least(F.lit(STEPS + 1), step + 3)))).drop("p")
        # Pivots that take in everything would leave everything; one value is less than that.
        whole = (F.col("a") <= F.col("low")) & (F.col("b") >= F.col("high"))
        cuts = cuts.withColumn("b", F.when(whole | (F.col("b") < F.col("a")), F.col("a")).otherwise(F.col("b"))).drop("sketch", "inside")
        here = _joined(rows, cuts, groups, also=(F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        parts = {"l": F.col("v") < F.col("a"), "m": (F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b")), "h": F.col("v") > F.col("b")}
        told = []
        for name, within in parts.items():
            v = F.when(within, F.col("v"))
            told += [F.count(v).alias(f"n_{name}"), F.min(v).alias(f"low_{name}"), F.max(v).alias(f"high_{name}"), F.kll_sketch_agg_double(v).alias(f"sketch_{name}")]
        counted = here.groupBy(*groups, "rank", "below").agg(*told)
        inner = F.col("rank") - F.col("below")
        part = F.when(inner < F.col("n_l"), "l").when(inner < F.col("n_l") + F.col("n_m"), "m").otherwise("h")
        before = {"l": F.lit(0), "m": F.col("n_l"), "h": F.col("n_l") + F.col("n_m")}
        pick = lambda what: reduce(lambda out, p: out.when(part == p, what(p)), "lmh", F)
        state = counted.select(*groups, "rank", (F.col("below") + pick(lambda p: before[p])).alias("below"), pick(lambda p: F.col(f"n_{p}")).alias("inside"), *[pick(lambda p, c=c: F.col(f"{c}_{p}")).alias(c) for c in ("low", "high", "sketch")])
    done = reduce(DataFrame.unionByName, settled)
    same = F.col("low").eqNullSafe(F.col("high"))
    rest = _joined(rows, done.filter(~same).drop("inside"), groups, also=(F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    # At most ``held`` values each.
    sorted_ = rest.groupBy(*groups, "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    few = sorted_.select(*groups, "rank", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value"))
    return done.filter(same).select(*groups, "rank", F.col("low").alias("value")).unionByName(few)


def percentiles(df: DataFrame, groups: list[str], value: Column, ps: dict[str, float], held: int = HELD) -> DataFrame:
    """A row a group: ``groups``, n (values) and, for each name of ``ps``, the percentile of its share (0 to 1), interpolated."""
    named = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(n) for g, n in zip(groups, named, strict=True)], value.cast("double").alias("v"))
    back = [F.col(n).alias(g) for g, n in zip(groups, named, strict=True)]
    few = lambda d: d.groupBy(*named).agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(p)).alias(name) for name, p in ps.items()])
    if (rows.groupBy(*named).agg(F.count("v").alias("n")).agg(F.max("n")).first()[0] or 0) <= held:
        return few(rows).select(*back, "n", *ps)
    rows = stored(rows, "values")
    sizes = stored(rows.groupBy(*named).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double("v").alias("sketch")), "sizes")
    large = sizes.filter(F.col("n") > held)
    at = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in ps.items()}
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)]))
    state = large.select(*named, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "low", "high", "sketch")
    found = _narrowed(rows, named, state, held).groupBy(*named).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of"))
    told = _joined(large.select(*named, "n"), found, named)
    exact = told.select(*named, "n", *[_interpolated(x, F.col("of")[F.floor(x).cast("long")], F.col("of")[F.ceil(x).cast("long")]).alias(name) for name, x in at.items()])
    if not named:
        return exact
    small = few(_joined(rows, large.select(*named), named, "left_anti"))
    return small.unionByName(exact).select(*back, "n", *ps)
