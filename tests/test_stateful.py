"""Stateful streams: quotas that end, the shuffle buffer, restarts in mid-stream."""

import random

from pyspark.sql import functions as F

from tessera.streaming import stateful

SCHEMA = "id long, lang string, end boolean"


def put(spark, path, rows, number):
    """A file of rows, newer than those before."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/f={number}")


def read(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def arrivals(n=120, parts=4, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["en", "en", "en", "de", "fr"]), False) for i in range(n)]
    return [rows[i::parts] for i in range(parts)]


def brute_quota(parts, n, quotas):
    taken, out = {}, set()
    for part in parts:
        for i, lang, _ in sorted(part):
            if taken.get(lang, 0) < quotas.get(lang, n):
                taken[lang] = taken.get(lang, 0) + 1
                out.add(i)
    return out


def test_quota_with_a_restart_equals_one_run(spark, tmp_path):
    parts, quotas = arrivals(), {"en": 20}
    for name, stops in (("one", [4]), ("two", [2, 4])):
        path, at = f"{tmp_path}/{name}", 0
        for stop in stops:
            for i in range(at, stop):
                put(spark, path, parts[i], i)
            at = stop
            stateful.quota(read(spark, path), "lang", "id", 7, f"{path}-out", f"{path}-mark", quotas).awaitTermination()
        got = [r.id for r in spark.read.parquet(f"{path}-out").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_quota(parts, 7, quotas)


def test_the_query_stops_when_all_quotas_are_full(spark, tmp_path):
    parts = [[(100 * p + i, "en" if i % 2 else "de", False) for i in range(40)] for p in range(6)]
    path = f"{tmp_path}/in"
    for i, part in enumerate(parts):
        put(spark, path, part, i)
    query = stateful.quota(read(spark, path), "lang", "id", 15, f"{path}-out", f"{path}-mark", each=2)
    assert not query.isActive
    assert {r.id for r in spark.read.parquet(f"{path}-out").collect()} == brute_quota(parts, 15, {})
    assert spark.read.parquet(f"{path}-out").select("batch").distinct().count() < 6 and spark.read.parquet(f"{path}-out_counts").count() < 6


def test_shuffle_buffer_with_a_restart(spark, tmp_path):
    parts = arrivals(90, 3) + [[(1000 + i, lang, True) for i, lang in enumerate(["en", "de", "fr"])]]
    seen = {}
    for name, stops in (("one", [4]), ("two", [1, 4])):
        path, at = f"{tmp_path}/{name}", 0
        for stop in stops:
            for i in range(at, stop):
                put(spark, path, parts[i], i)
            at = stop
            out = stateful.shuffled(read(spark, path), "lang", "id", 10, "s")
            out.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-mark").trigger(availableNow=True).start().awaitTermination()
        seen[name] = {(r.lang, r["at"], r.id) for r in spark.read.parquet(f"{path}-out").collect()}
    assert seen["one"] == seen["two"]
    assert {i for *_, i in seen["one"]} == {i for p in parts[:3] for i, *_ in p}
    for lang in ("en", "de", "fr"):
        assert sorted(r[1] for r in seen["one"] if r[0] == lang) == list(range(sum(r[0] == lang for r in seen["one"])))
        order = [i for _, _, i in sorted((r for r in seen["one"] if r[0] == lang), key=lambda r: r[1])]
        came = [i for p in parts[:3] for i, la, _ in sorted(p) if la == lang]
        assert order != came
        # A row leaves at the earliest when it has come, so it can move forward by the buffer's size at most.
        assert all(came.index(x) <= place + 10 for place, x in enumerate(order))
