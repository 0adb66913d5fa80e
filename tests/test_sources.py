import bz2
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import code
from tessera.sources import scan, sinks
from tessera.streaming import ingest

DUMP = """<mediawiki><page><title>A</title><ns>0</ns><revision><timestamp>t1</timestamp><text xml:space="preserve">old</text></revision><revision><timestamp>t2</timestamp><text xml:space="preserve"> new </text></revision></page>
<page><title>B</title><ns>x</ns><revision><timestamp>t3</timestamp><text/></revision></page></mediawiki>"""


def test_wiki_pages_plain_and_compressed(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP)
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(DUMP.encode()))
    for name in ("d.xml", "d.xml.bz2"):
        got = sorted(map(tuple, scan.wiki_pages(spark, str(tmp_path / name)).collect()))
        assert got == [("A", 0, "t2", " new "), ("B", -1, "t3", "")]


def test_source_tree(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n" * 30, "b.txt": b"y" * 300, "c.py": b"short", "node_modules/d.js": b"z" * 300, "e.py": b"\xff" * 300, "f.py": b" \n" * 200}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert [r.path.rsplit("/", 1)[1] for r in scan.source_tree(spark, str(tmp_path)).collect()] == ["a.py"]


def test_json_lines_skip_bad_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"user": "q", "assistant": "a"}\n\n{broken\n{"user": "r"}\n')
    assert sorted((r.user, r.assistant) for r in scan.json_lines(spark, str(tmp_path), "user string, assistant string").collect()) == [("q", "a"), ("r", None)]


def test_restarted_ingest_equals_batch(spark, tmp_path):
    path, source, mark = (str(tmp_path / x) for x in ("out", "in", "mark"))
    schema = "k long, v string, n long"
    for part in ([(1, "a", 1), (2, "b", 2), (1, "c", 0)], [(2, "d", 3), (3, "e", 4)], []):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            ingest.run_once(spark, source, schema, path, mark, ["k"], ["n", "v"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "c"), (2, "b"), (3, "e")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, x double")
    assert [r.line for r in sinks.markdown_rows(df, ["name", "x"]).collect()] == ["| a | 0.5000 |", "| b | N/A |"]
    assert sinks.manifest(df, ["name"]).first().asDict() == {"total": 2, "by_name": {"a": 1, "b": 1}}


def test_python_source(spark):
    good = "class A:\n    def f(self):\n        'doc'\n        a = 1\n        b = 2\n        c = 3\n        return a\n"
    rows = spark.createDataFrame([(good,), ("import os\neval('1')",), ("def (",)], "x string").select(code.parses("x").alias("p"), code.violations("x").alias("v"), code.functions("x").alias("f")).collect()
    assert [r.p for r in rows] == [True, True, False]
    assert [r.v for r in rows] == [[], ["call eval"], ["syntax error"]]
    assert [(f.qualname, f.body_lines) for f in rows[0].f] == [("A.f", 5)]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def lines_of(n, seed=1):
    rng = random.Random(seed)
    return [rng.choice(['{"a": %d}' % i, "", "{broken", "x" * rng.randint(0, 300)]) for i in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_lines_of_one_large_file_are_numbered_in_many_tasks(spark, tmp_path, small_splits, packed):
    one, two = lines_of(900), lines_of(70, 2)
    if packed:  # many streams one after the other
        (tmp_path / "a.txt.bz2").write_bytes(b"".join(bz2.compress(("\n".join(one[i : i + 90]) + "\n").encode()) for i in range(0, 900, 90)))
    else:
        (tmp_path / "a.txt").write_text("\n".join(one))
    (tmp_path / "b.txt").write_text("\n".join(two) + "\n")
    got = scan.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > (2 if packed else 8)
    assert sorted((r.file.rsplit("/", 1)[1][0], r.line, r.text) for r in got.collect()) == [("a", i, t) for i, t in enumerate(one, 1)] + [("b", i, t) for i, t in enumerate(two, 1)]
    bad = scan.json_line_faults(spark, str(tmp_path))
    fits = lambda t: t == "" or t.startswith('{"a"')
    assert sorted((r.file.rsplit("/", 1)[1][0], r.line) for r in bad.collect()) == [("a", i) for i, t in enumerate(one, 1) if not fits(t)] + [("b", i) for i, t in enumerate(two, 1) if not fits(t)]


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_a_slice_reads_the_files_that_it_needs(spark, tmp_path, kind):
    frame = spark.range(1000).select("id", F.concat(F.lit("t"), "id").alias("t"))
    getattr(frame.repartitionByRange(20, "id").sortWithinPartitions("id").write, kind)(f"{tmp_path}/d")
    for n in (0, 1, 60, 77, 5000):
        got = scan.first_rows(spark, f"{tmp_path}/d", n)
        assert sorted((r.id, r.t) for r in got.collect()) == [(i, f"t{i}") for i in range(min(n, 1000))]
    assert len(scan.first_rows(spark, f"{tmp_path}/d", 77).inputFiles()) <= 4


@pytest.mark.parametrize("packed", [False, True])
def test_a_large_dump_is_read_in_splits(spark, tmp_path, small_splits, packed):
    rng = random.Random(5)
    pages = [(f"T {i} &amp; co", i % 3, "é唐 &lt;/page&gt; text\n" * rng.randint(0, 9)) for i in range(300)]
    one = lambda p: f"  <page>\n<title>{p[0]}</title><ns>{p[1]}</ns><id>7</id><revision><timestamp>t</timestamp><text xml:space=\"preserve\">{p[2]}</text></revision></page>\n"
    head, rest = "<mediawiki><siteinfo><sitename>x</sitename></siteinfo>\n", [one(p) for p in pages]
    if packed:
        streams = [head] + ["".join(rest[i : i + 20]) for i in range(0, 300, 20)] + ["</mediawiki>"]
        (tmp_path / "d.xml.bz2").write_bytes(b"".join(bz2.compress(s.encode()) for s in streams))
    else:
        (tmp_path / "d.xml").write_text(head + "".join(rest) + "</mediawiki>\n")
    got = scan.wiki_pages(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > (1 if packed else 8)
    assert sorted((r.title, r.ns, r.wikitext) for r in got.collect()) == sorted((t.replace("&amp;", "&"), n, x.replace("&lt;", "<").replace("&gt;", ">")) for t, n, x in pages)
