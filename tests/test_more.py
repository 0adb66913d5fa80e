"""Cases of the newer functions that the queries don't reach."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import code as C
from tessera.functions import formats as X
from tessera.functions import repair as R
from tessera.operators import mix as M
from tessera.operators import order as O
from tessera.sources import scan, sinks
from tessera.streaming import ingest, stateful


def test_violations_by_import_call_and_attribute():
    assert C.violations_of("import os, sys, shutil, pickle\ncompile('x')") == []
    assert C.violations_of("import pty\nfrom subprocess import run\nPath(p).chmod(0)\nos.system('x')\nopen('f')") == ["attribute chmod", "attribute system", "call open", "import pty", "import subprocess"]
    assert C.violations_of("def f(:") == ["syntax error"]


def test_valid_code_texts():
    good, bad = "```python\nx = 1\ny = [2, 3, 4]\n```", "```\nx = = 1 and some more\n```"
    assert C.valid_code_text_of("Here it is, as asked for:\n" + good) and not C.valid_code_text_of("Here it is, as asked for:\n" + good + bad)
    assert not C.valid_code_text_of("short") and not C.valid_code_text_of(None) and C.valid_code_text_of("only words without any code in them at all")
    assert not C.valid_code_text_of("def f(:\n    return 1  # and some more") and C.valid_code_text_of("def f():\n    return 1  # and some more")


def test_written_files_and_their_ends():
    text = "WRITE_FILE: a.py\n<<<CONTENT\nx = 1\ny = 2\nz = 33333\n```\nprose\n\nWRITE_FILE: b.py\n<<<CONTENT\nfirst = 'a long line'\n## Why\n-WRITE_FILE: c.py\n<<<CONTENT\nremoved lines of a diff\nCONTENT>>>\n"
    assert R.written_files_of(text) == [("a.py", "x = 1\ny = 2\nz = 33333\n"), ("b.py", "first = 'a long line'\n")]
    assert R.written_files_of(None) == [] and R.written_files_of("WRITE_FILE: a.py\n<<<CONTENT\nshort") == []


def test_hunks_that_are_there_already_and_lines_without_a_mark():
    source = "a\nb\nc"
    diff = "@@ -1 +1 @@\n a\n+new\n b\n"
    once, lost = R.patched(source, diff)
    assert (once, lost) == ("a\nnew\nb\nc", 0) and R.patched(once, diff) == (once, 0)
    assert R.patched("if x:\nreturn y", "@@ @@\nif x:\n-return y\n+return z\n") == ("if x:\nreturn z", 0)


def test_projects():
    made = scan.project_of({"project": "enwiki", "dump_path": "d", "db_path": "i", "namespaces": []}, {"enwiki": "u"})
    assert made.namespaces is None and made.mode == "wiki" and scan.project_of({"project": "x", "dump_path": "d", "db_path": "i", "base_url": "u", "namespaces": ["4", 0]}, {}).namespaces == (0, 4)
    with pytest.raises(ValueError):
        scan.project_of({"project": "x", "dump_path": "d", "db_path": "i"}, {})
    assert scan.projects_of(["a"], "D", "I", {"a": "u"}, main_only=False)[0].namespaces is None


def test_datasets(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(f"{tmp_path}/r/train")
    spark.createDataFrame([(2,)], "k int").write.json(f"{tmp_path}/r/test")
    rows = scan.dataset(spark, str(tmp_path), "r", ("train", "test")).collect()
    assert sorted((r.k, r.v) for r in rows) == [(1, "a"), (2, None)]
    with pytest.raises(FileNotFoundError):
        scan.dataset(spark, str(tmp_path), "r:none")
    assert scan.first_that_loads(spark, str(tmp_path), ["x", "y"]) is None


def test_source_tree_variants(spark, tmp_path):
    for name, data in {"a.PY": b"x = 1\r\n" * 30, "b.py": b"y = '\xff\xc3\xa9'\n" * 20, "dist/c.py": b"z" * 300, "d.js": b"w" * 3000}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    names = lambda **more: {r.path.rsplit("/", 1)[1]: r.content for r in scan.source_tree(spark, str(tmp_path), **more).collect()}
    assert set(names()) == {"a.PY", "d.js"} and set(names(per_root=1)) == {"a.PY"}
    assert names(lenient=True, tidy=True) == {"a.PY": "x = 1\n" * 30, "b.py": "y = 'é'\n" * 20}


def test_appends_keep_the_first(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, None)], "k int, v string")
    sinks.append_new(rows, rows.filter("k = 2"), f"{tmp_path}/new", ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/new").collect()), key=str) == [(1, "a"), (3, None)]
    assert [sinks.append_hashed(rows.unionByName(rows), f"{tmp_path}/hashed") for _ in range(2)] == [4, 0]


def test_quota_of_a_stream(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in ([("a", 1), ("a", 2), ("b", 1)], [("a", 0), ("b", 5), ("b", 4)]):
        spark.createDataFrame(part, "k string, n int").coalesce(1).write.mode("append").parquet(source)
        stateful.quota(spark.readStream.schema("k string, n int").parquet(source), "k", "n", 2, out, f"{tmp_path}/mark").awaitTermination()
    assert sorted((r.k, r.n) for r in spark.read.parquet(out).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 4)]


def test_windows_numbers_and_slices(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "k int, t string")
    got = ingest.token_windows(rows, F.split("t", " "), 2, "k").collect()
    assert [(r.k, r.at, r.tokens) for r in got] == [(1, 0, ["a", "b"]), (1, 1, ["c", "d"])]
    many = spark.range(1000)
    assert sorted(r["at"] for r in M.numbered(many, [], "s", "id").collect()) == list(range(1000))
    assert O.safe_slice(many, 0, "s", "id").count() == 0 and M.filled_up(many.limit(0), 5, "s", "id").count() == 0 and M.filled_up(many, 5, "s", "id").count() == 5


def test_numbering_in_many_slots(spark, monkeypatch):
    rows = spark.range(500).withColumn("g", F.col("id") % 3)
    want = {(r.g, r.id): r["at"] for r in M.numbered(rows, ["g"], "s", "id").collect()}
    monkeypatch.setattr(M, "SLOT", 8)
    assert {(r.g, r.id): r["at"] for r in M.numbered(rows, ["g"], "s", "id").collect()} == want


def test_rows_of_formats_without_columns(spark):
    rows = spark.createDataFrame([("t",)], "other string")
    assert X.problems(rows).count() == X.instructions(rows).count() == X.patches(rows).count() == X.plain_texts(rows).count() == 0


def test_running_sums_in_many_slots(spark, monkeypatch):
    monkeypatch.setattr(M, "SLOT", 8)
    rows = spark.range(300).select((F.col("id") * 37 % 1009).alias("at"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), (F.col("id") % 5).alias("v"))
    held = rows.collect()
    want = {r["at"]: sum(x.v for x in held if x.g == r.g and x["at"] < r["at"]) for r in held}
    assert {r["at"]: r.before for r in M.running(rows, "g", "at", F.col("v"), "before").collect()} == want
    assert M.running(rows.limit(0), "g", "at", F.col("v"), "before").count() == 0
