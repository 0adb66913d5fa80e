"""Percentiles, merged intervals and packing against brute force, in slots so small that carries matter."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bins, intervals, percentiles

PS = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def values(kind, n, rng):
    return {
        "spread": lambda: [rng.gauss(0, 1e6) for _ in range(n)],
        "two": lambda: [rng.choice([1.0, 2.0]) for _ in range(n)],
        "one": lambda: [7.5] * n,
        "skewed": lambda: [0.0] * (n - n // 50) + [rng.random() * 1e-300 for _ in range(n // 50)],
        "huge": lambda: [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(n)],
    }[kind]()


@pytest.mark.parametrize("held", [1, 40])
def test_percentiles_are_exact(spark, held):
    rng, rows = random.Random(held), []
    for kind in ("spread", "two", "one", "skewed", "huge"):
        rows += [(kind, i % 2, v) for i, v in enumerate(values(kind, 700, rng))]
    rows += [(None, 0, float(i)) for i in range(300)] + [("small", 0, 3.0), ("small", 0, 1.0), ("none", 0, None), ("some", 0, None)] + [("some", 0, float(i % 9)) for i in range(90)]
    df = spark.createDataFrame(rows, "kind string, part int, x double").repartition(5)
    got = {(r.kind, r.part): r for r in percentiles.percentiles(df, ["kind", "part"], F.col("x"), PS, held).collect()}
    want = defaultdict(list)
    for kind, part, x in rows:
        want[kind, part] += [] if x is None else [x]
    assert got.keys() == want.keys()
    for key, xs in want.items():
        assert got[key].n == len(xs)
        for name, p in PS.items():
            if not xs:
                assert got[key][name] is None
            else:
                at = p * (len(xs) - 1)
                low, high = sorted(xs)[math.floor(at)], sorted(xs)[math.ceil(at)]
                assert got[key][name] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-9)


def test_percentiles_of_everything_and_of_nothing(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("x"))
    row = percentiles.percentiles(df, [], F.col("x"), {"p": 0.25}, held=10).first()
    assert (row.n, row.p) == (5000, np.percentile(range(5000), 25))
    assert percentiles.percentiles(df.limit(0), [], F.col("x"), {"p": 0.25}).collect()[0].p is None
    assert percentiles.percentiles(df.limit(0).withColumn("g", F.lit(1)), ["g"], F.col("x"), {"p": 0.25}).collect() == []
    odd = spark.createDataFrame([(float("nan"),)] * 60 + [(float(i),) for i in range(40)], "x double")
    row = percentiles.percentiles(odd, [], F.col("x"), {"a": 0.1, "b": 0.9}, held=5).first()
    assert row.a == pytest.approx(9.9) and math.isnan(row.b)


def test_no_pass_gathers_a_group(spark):
    """Values are gathered below ``held`` only; of the rest there are counts and sketches."""
    df = spark.range(20000).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("g"))
    plan = percentiles.percentiles(df, ["g"], F.col("x"), {"p": 0.5}, held=100)._jdf.queryExecution().toString()
    assert "collect_list(v" in plan and "__low" not in plan
    state = df.groupBy("g").agg(F.kll_sketch_agg_double("x").alias("s")).select(F.length("s").alias("n")).first()
    assert state.n < 10_000


def brute_merge(rows, gap):
    out = []
    for g in {r[0] for r in rows}:
        islands = []
        for _, s, e in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]):
            if islands and s <= islands[-1][1] + gap:
                islands[-1][1] = max(islands[-1][1], e)
            else:
                islands.append([s, e])
        out += [(g, *i) for i in islands]
    return Counter(out)


@pytest.mark.parametrize("parts, gap", [(1, 1), (7, 1), (23, 0), (23, 30)])
def test_intervals_merge_across_slots(spark, parts, gap):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), s, s + rng.choice([0, 3, 9, 500 if rng.random() < 0.02 else 1])) for s in (rng.randint(-50, 9000) for _ in range(900))]
    rows += [("chain", i, i + 1) for i in range(300)] + [("nest", 0, 10_000)] + [("nest", i * 20, i * 20 + 3) for i in range(100)] + [("tie", 5, 6)] * 20
    df = spark.createDataFrame([*rows, ("a", None, 4), ("a", 4, None)], "who string, start long, stop long").repartition(4)
    got = intervals.merged(df, "who", "start", "stop", gap, parts, held=10)
    assert Counter(map(tuple, intervals.merged(df, "who", "start", "stop", gap).collect())) == brute_merge(rows, gap)
    assert Counter(map(tuple, got.collect())) == brute_merge(rows, gap)


def test_a_hot_group_takes_many_slots(spark, tmp_path):
    df = spark.range(4000).select(F.lit("u").alias("who"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 1).alias("stop"))
    spread = df.repartitionByRange(8, "who", "start").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 1500
    assert intervals.merged(df, "who", "start", "stop", 1, 8, held=1000).count() == 4000
    assert intervals.merged(df.limit(0), "who", "start", "stop").count() == 0


def brute_best_fit(lengths, size):
    """Room left in the bins of best fit, the longest first."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_of_counts_is_best_fit_of_rows(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 500])
    lengths = [min(size, 1 + int(rng.expovariate(1 / (size / rng.choice([3, 10]))))) for _ in range(rng.choice([0, 5, 800]))]
    held, placed = defaultdict(int), Counter()
    for length, low, high, first, each in bins.best_fit(Counter(lengths), size):
        for r in range(low, high):
            held[first + (r - low) // each] += length
            placed[length, r] += 1
    assert placed == Counter({(n, i): 1 for n, c in Counter(lengths).items() for i in range(c)})
    assert sorted(size - n for n in held.values()) == brute_best_fit(lengths, size)
    assert sorted(held) == list(range(len(held)))


def test_packed_rows(spark):
    rng = random.Random(2)
    rows = [(i, int(rng.lognormvariate(4, 1))) for i in range(3000)] + [(9000, 0), (9001, 10_000), (9002, None)]
    df = spark.createDataFrame(rows, "id long, n int")
    got = bins.packed(df, F.col("n"), 512, "s", "id")
    lengths = {i: min(512, n) for i, n in rows if n}
    assert {r.id: r.length for r in got.collect()} == lengths
    told = bins.fill(got, 512).first()
    assert told.fullest <= 512 and told.fill >= 0.95 and told.tokens == sum(lengths.values())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bins.packed(df.repartition(6), F.col("n"), 512, "s", "id").collect()))
    assert bins.packed(df.limit(0), F.col("n"), 512, "s", "id").count() == 0
    with pytest.raises(ValueError):
        bins.best_fit({11: 1}, 10)
