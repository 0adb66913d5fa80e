"""What once held only for small inputs."""

import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import parse as P
from tessera.operators import index, search
from tessera.plans import mixes, registry
from tessera.sources import scan, sinks


def seconds(df):
    """The least of three runs."""
    out = []
    for _ in range(3):
        start = time.monotonic()
        df.write.format("noop").mode("overwrite").save()
        out.append(time.monotonic() - start)
    return min(out)


def made(spark, n, tokens):
    """Fillers by themselves, as many and as long as a query's."""
    return spark.range(n).select(F.octet_length(P.repeated_to("The sun sets in the west. ", F.lit(tokens) + F.col("id"))).alias("n"))


@pytest.mark.parametrize("filler", ["The sun sets in the west. ", "é, ü. ", "x"])
def test_passkey_contexts_at_all_depths(spark, filler):
    cases = [(n, d) for n in (None, 0, 64, 65, 100, 1000) for d in (None, -1.0, 0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0, 7.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, d double").select("i", P.passkey_context(F.col("n"), F.col("i"), F.col("d"), filler).alias("c")).collect()
    for i, got in rows:
        n, d = cases[i]
        body = filler * -(-max(64, n or 0) * 4 // len(filler))
        at = int(len(body) * max(0.0, min(1.0 if d is None else d, 1.0)))
        assert got == f"{body[:at]}\nThe secret passkey is {i}.\n{body[at:]}"


def test_long_passkey_contexts_are_laid_out_in_blocks(spark):
    n, tokens = 800, 500_000
    context = P.passkey_context(F.lit(tokens) + F.col("id"), F.col("id"), F.col("id") / n)
    assert seconds(spark.range(n).select(F.octet_length(context))) < 0.5 + 6 * seconds(made(spark, n, tokens))


def test_size_of_a_prefill_is_not_counted_letter_by_letter(spark, tmp_path):
    n, tokens = 800, 500_000
    spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") + tokens).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    query = registry.QUERIES["t59_prefill"](spark, str(tmp_path))
    assert [r.n for r in query.orderBy("event_id").limit(3).collect()] == [12 * -(-(tokens + i + 1) * 4 // 12) for i in range(3)]
    assert seconds(query) < 0.3 + 3 * seconds(made(spark, n, tokens))


def test_status_lists_any_number_of_tasks(spark, tmp_path):
    n = 100_003
    spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.QUERIES["w20_status"](spark, str(tmp_path)).first()
    assert tuple(got) == (n, n // 3, n - n // 3, n)


def test_slices_of_splits_go_by_id_however_documents_lie(spark, tmp_path):
    """Spark reads the largest file first; here it holds the last ids."""
    for name, low, high in (("a", 0, 40), ("b", 40, 200), ("c", 200, 2000)):
        d = spark.range(low, high).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 7).alias("source"), F.lit(128).cast("long").alias("n_chars"))
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "100000")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        got = registry.QUERIES["r20_split_slices"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.doc_id for r in got) == list(range(14))


PATHS = ["a/b/c.py", "b/c.py", "c.py", "x/c.py", "x//c.py", "d.py", "lib/d.py", "/d.py", "only/e.py", "tail/", "other/tail/", "q", "u/v/w", "u2/v/w", None, ""]


def test_paths_are_resolved_as_by_all_pairs(spark):
    raws = [*PATHS, "v/w", "w", "zz", "e.py", "no/e.py", "/c.py", "//c.py", "tail", "d.py/", "/"]
    got = mixes.resolved(spark.createDataFrame([(r,) for r in raws], "raw string"), spark.createDataFrame([(p,) for p in PATHS], "path string")).collect()

    def one(raw):
        if raw is None:
            return None
        known = [p for p in PATHS if p is not None and p.rsplit("/", 1)[-1] == raw.rsplit("/", 1)[-1]]
        ends = [p for p in known if p.endswith("/" + raw)]
        return raw if raw in known else ends[0] if len(ends) == 1 else known[0] if len(known) == 1 else None

    assert {r.raw: r.path for r in got} == {r: one(r) for r in raws} and len(got) == len(set(raws))


def test_paths_of_one_base_name_are_not_paired(spark, tmp_path):
    """3,000 index pages in folders of their own: all pairs would be nine millions."""
    spark.range(3000).select(F.concat(F.lit("http://h/"), "id", F.lit("/index.html")).alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    query = registry.QUERIES["t81_resolved_paths"](spark, str(tmp_path))
    assert query.filter("path = 'http://h/' || raw").count() == 3000
    assert "EndsWith" not in query._jdf.queryExecution().optimizedPlan().toString()


def test_a_tree_of_many_small_files_is_written_without_a_job_for_each(spark, tmp_path):
    """As many files as rows, each written once and where it stays."""
    n = 4000
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("words\nof a text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(15).cast("long").alias("n_chars")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    start = time.monotonic()
    got = registry.QUERIES["r08_tidy_tree"](spark, str(tmp_path))
    assert time.monotonic() - start < 12
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(n) if i % 5]


def test_a_tree_is_read_by_few_tasks_and_listed_by_none_of_the_driver(spark, tmp_path):
    """Spark's own reader takes 32 files a task at most, or fewer, and lists them on the driver."""
    for i in range(2000):
        (tmp_path / f"t/{i % 40}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"t/{i % 40}/{i}.py").write_text(f"x = {i}\n")
    got = scan.source_tree(spark, f"{tmp_path}/t", 1, lenient=True, tidy=True)
    assert got.rdd.getNumPartitions() == 1 and "BatchScan" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "binaryFile" not in plan
    assert sorted(int(r.content[4:]) for r in got.collect()) == list(range(2000))


def test_a_tree_is_dealt_by_number_and_size(spark, tmp_path, monkeypatch):
    """In parts of few files, few bytes and few folders the same rows come out."""
    for i in range(60):
        (tmp_path / f"{i % 7}/{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{i % 7}/{i % 3}/{i}.py").write_text(f"x = {i}\n" * 10)
    rows = lambda: sorted(map(tuple, scan.source_tree(spark, str(tmp_path), 1).collect()))
    want = rows()
    assert len(want) == 60 and all(r[0].startswith(f"file:{tmp_path}/") for r in want)
    for name, few in (("FILES", 7), ("BYTES", 100), ("HELD", 80), ("FOLDERS", 2)):
        monkeypatch.setattr(scan, name, few)
        assert rows() == want


def test_a_tree_has_all_its_names(spark, tmp_path):
    """Names with a dot or a low line ahead, odd letters, suffixes in any case; the root's own place is no reason to leave it out, links to folders aren't entered."""
    root = tmp_path / "build/a b%20é"
    for name, data in {"__init__.py": b"a", ".hidden/.x.js": b"b", "_p/é %41.Py": b"c", "r.py": "d\ufffd\r".encode() + b"\xff\r\n", "venv/e.py": b"e", "s/dist/f.py": b"f", ".py": b"g", "n.bin": b"h"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "s/up").symlink_to(root)
    (root / "s/gone.py").symlink_to(root / "nowhere")
    got = scan.source_tree(spark, str(root), 1, lenient=True, tidy=True).collect()
    assert {r.path.removeprefix(f"file:{root}/"): (r.language, r.content) for r in got} == {"__init__.py": ("py", "a"), ".hidden/.x.js": ("js", "b"), "_p/é %41.Py": ("py", "c"), "r.py": ("py", "d\ufffd\n\n")}
    (tmp_path / "empty").mkdir()
    assert scan.source_tree(spark, f"{tmp_path}/empty").count() == 0
    with pytest.raises(FileNotFoundError):
        scan.source_tree(spark, f"{tmp_path}/none")


def test_a_tree_on_a_file_system_of_spark_alone(spark, tmp_path):
    for name, data in {"a.py": b"x\r\n", "dist/b.py": b"y", "c.py": b"\xff", "d/e.js": b"\xc3\xa9"}.items():
        (tmp_path / "build" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "build" / name).write_bytes(data)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.trees.link./build", f"file://{tmp_path}/build")
    rows = lambda root, **more: sorted((r.path.removeprefix(root), r.content) for r in scan.source_tree(spark, root, 1, **more).collect())
    for more in ({}, {"lenient": True, "tidy": True}):
        assert rows("viewfs://trees/build", **more) == rows(f"file:{tmp_path}/build", **more)
    assert rows("viewfs://trees/build") == [("/a.py", "x\r\n"), ("/d/e.js", "é")]


def test_files_are_written_as_they_are(spark, tmp_path):
    rows = [("a.txt", b"\x00\xff"), ("b/c/d.txt", b""), ("b/é.txt", "é\r\n".encode())]
    assert sinks.write_files(spark.createDataFrame(rows, "path string, content binary"), f"file://{tmp_path}/t") == 3
    assert sinks.write_files(spark.createDataFrame(rows, "path string, content binary"), f"{tmp_path}/t") == 3
    assert [(tmp_path / "t" / p).read_bytes() for p, _ in rows] == [c for _, c in rows]


def test_index_deals_documents_of_a_term_and_not_its_places(spark, monkeypatch):
    """A term a hundred times in a text is one row of a part, and texts of a window are one; batches of a few tokens give the same."""
    texts = [(i, " ".join(["ab", f"c{i % 3}"] * 100), "Ab x") for i in range(40)] + [(40, "", None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, title string").coalesce(1)
    got = {}
    for most in (1_000_000, 7):
        monkeypatch.setattr(index, "GROUPED", most)
        built = index.Index(spark, fields=("text", "title")).put(frame)
        got[most] = sorted(map(repr, built._read("blocks").drop("seq").collect())), sorted(map(repr, built._read("lengths").drop("seq").collect()))
    assert got[7] == got[1_000_000]
    cut = search.cut(frame, "doc_id", ("text", "title")).select("doc_id", "dl", F.lit(0).cast("long").alias("window"), "t0", "t1")
    monkeypatch.setattr(index, "GROUPED", 1_000_000)
    parts = cut.mapInArrow(index._parts_of("doc_id"), built._schema("parts")).collect()
    assert sorted(r.term or "" for r in parts) == ["", "ab", "c0", "c1", "c2", "x"]
    ab = {d.doc_id: d for r in parts if r.term == "ab" for d in r.docs}
    assert len(ab) == 40 and ab[7].dl == 202 and ab[7].ats == [*range(0, 200, 2), search.FIELD]


def test_snippets_of_one_search_write_no_index(spark, tmp_path):
    """What the search writes follows its hits and not the tokens of all texts; the ten best have their snippets."""
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000)) + (" licensed Under the Café" if i % 20 == 0 else "")) for i in range(300)]
    spark.createDataFrame([*texts, (None, "the")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    there = set(shared.rglob("*.parquet"))
    got = registry.QUERIES["q06_snippets"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 200, 20)) and all(r.snippet.endswith(" [licensed] Under [the]…") for r in got)
    assert sum(p.stat().st_size for p in set(shared.rglob("*.parquet")) - there) < 0.1 * sum(len(t) for _, t in texts)
