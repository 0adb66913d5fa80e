"""The keyed table and the batch sink."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import batches
from tessera.sources.keyed import KeyedTable
from tessera.streaming import ingest

SCHEMA = "k long, name string, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_first_writer_of_a_key_wins(spark, tmp_path):
    df = frame(spark, [(i, f"n{i % 3}", i) for i in range(200)])
    table = KeyedTable(spark, f"file://{tmp_path}/t", df.schema, ["k", "name"], 8)
    assert table.insert_first(df.filter("v < 100"), ["v"]) == (100, 100)
    again = df.withColumn("v", F.col("v") + 1000).unionByName(df.withColumn("v", F.col("v") + 2000))
    assert KeyedTable(spark, f"file://{tmp_path}/t", df.schema, ["k", "name"], 8).insert_first(again, ["v"]) == (200, 100)
    assert table.insert_first(again, ["v"]) == (200, 0) and table.insert_first(df.limit(0), ["v"]) == (0, 0)
    assert {(r.k, r.v) for r in table.read().collect()} == {(i, i if i < 100 else i + 1000) for i in range(200)}


def test_what_is_held_is_not_shuffled(spark, tmp_path):
    df = frame(spark, [(i, "n", i) for i in range(500)])
    table = KeyedTable(spark, f"file://{tmp_path}/t", df.schema, ["k"], 8)
    table.insert_first(df, ["v"])
    new = table.new(df.withColumn("k", F.col("k") * 2))
    new.collect()
    plan = new._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") <= 2 and plan.count("hashpartitioning") == 1 and "BroadcastExchange" not in plan
    held = plan[plan.index(table.name) - 800 : plan.index(table.name)]
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan, held
    scan = plan.rindex("FileScan parquet")
    assert "name" not in plan[scan : scan + 200].split("]")[0]  # of what is held the keys are read


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    frame(spark, [(i % 50, "n", i) for i in range(100)]).write.parquet(f"{source}/a=1")
    schema = SCHEMA + ", a int"
    ingest.run_once(spark, source, schema, out, mark, ["k"], ["v"])
    frame(spark, [(i, "n", -1) for i in range(40, 60)]).write.parquet(f"{source}/a=2")
    for n in (mark, f"file://{tmp_path}/other"):  # the second checkpoint knows of nothing and runs all again
        ingest.run_once(spark, source, schema, out, n, ["k"], ["v"])
    rows = spark.read.parquet(out).collect()
    assert sorted(r.k for r in rows) == list(range(60)) and {r.v for r in rows if r.k < 50} == set(range(50))


def picky():
    """Fails for some rows, and ends the worker at one."""

    def encode(row):
        if row["name"] == "die":
            os._exit(1)
        if row["v"] is not None and row["v"] % 100 == 7:
            raise ValueError(f"no {row['v']}")
        return json.dumps(row)

    return encode


def test_rows_that_fail_are_left_out_and_the_others_stand(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    df = frame(spark, [(i, "n", i) for i in range(1000)]).repartition(3)
    batches.insert(df, path, picky(), batch=50)
    got = batches.rows(spark, path, SCHEMA)
    assert sorted(r.k for r in got.collect()) == [i for i in range(1000) if i % 100 != 7]
    bad = batches.quarantine(spark, path).collect()
    assert len(bad) == 10 and all(r.error.startswith("ValueError: no ") for r in bad)
    told = batches.manifests(spark, path).collect()
    assert [(r.rows, r.bad) for r in told] == [(990, 10)] and 1 <= told[0].retried <= 10
    batches.insert(frame(spark, [(5000, "é\n", None)]), path)
    assert batches.rows(spark, path, SCHEMA).filter("k = 5000").first().name == "é\n" and batches.manifests(spark, path).count() == 2
    assert not os.path.exists(f"{tmp_path}/sink/_staged") or not os.listdir(f"{tmp_path}/sink/_staged")


def test_a_job_that_dies_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    batches.insert(frame(spark, [(1, "n", 1)]), path)
    df = frame(spark, [(i, "die" if i == 150 else "n", i) for i in range(200)]).repartition(2)
    with pytest.raises(Exception):  # noqa: B017
        batches.insert(df, path, picky(), batch=10)
    time.sleep(0.2)
    assert [r.k for r in batches.rows(spark, path, SCHEMA).collect()] == [1] and batches.manifests(spark, path).count() == 1
    assert not os.path.exists(f"{tmp_path}/sink/_staged") or not os.listdir(f"{tmp_path}/sink/_staged")
