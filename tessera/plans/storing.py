"""Queries of sources, sinks and streams: the documents are written as files and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import order as O
from tessera.operators.index import Index
from tessera.operators.search import tokens
from tessera.plans.base import SQL, query, read
from tessera.plans.parsing import cat, pick, sql_pick
from tessera.sources import batches, scan, sinks
from tessera.sources.keyed import KeyedTable
from tessera.sources.scratch import scratch
from tessera.streaming import ingest, stateful

L = F.lit
_ID = lambda: F.col("doc_id").cast("string")


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


# --- sources -----------------------------------------------------------------------------------
def _dump(spark, sf_dir, codec: str):
    """The documents as a wiki dump, some pages with an older revision and some with a namespace that is no number."""
    own = F.regexp_replace("text", r"[^\p{L}\p{N} .,\n]", " ")
    revision = lambda at, text: cat("<revision><timestamp>t", at, "</timestamp><text xml:space=\"preserve\">", text, "</text></revision>")
    old = F.when(F.col("doc_id") % 3 == 0, revision(L("0"), L("older words"))).otherwise("")
    ns = pick(4, L("0"), L("14"), L("x"), L(" 0 "))
    page = cat("<page><title>", F.col("source"), " ", _ID(), "</title><ns>", ns, "</ns>", old, revision(_ID(), own), "</page>")
    path = scratch(spark, "dump")
    # Up to 500 pages make a dump of their own.
    dumps = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 500).alias("dump"), page.alias("page")).groupBy("dump").agg(cat("<mediawiki>", F.array_join(F.collect_list("page"), "\n"), "</mediawiki>").alias("value"))
    dumps.repartition("dump").write.partitionBy("dump").option("compression", codec).text(path)
    pages = scan.wiki_pages(spark, path)
    return pages.select("title", F.col("ns").cast("long").alias("ns"), "ts", F.md5("wikitext").alias("digest"), F.length("wikitext").cast("long").alias("n"))


_OWN = r"regexp_replace(text, '[^\p{L}\p{N} .,\n]', ' ', 'g')"
_PAGES = f"SELECT source || ' ' || doc_id AS title, CAST({sql_pick(4, '0', '14', '-1', '0')} AS BIGINT) AS ns, 't' || doc_id AS ts, md5({_OWN}) AS digest, length({_OWN}) AS n FROM documents"


@query(_PAGES)
def r01_dump_pages(spark, sf_dir):
    return _dump(spark, sf_dir, "none")


@query(_PAGES)
def r02_compressed_dump(spark, sf_dir):
    return _dump(spark, sf_dir, "bzip2")


@query("SELECT lang || 'wiki' AS project, source AS base_url, CASE CAST(min(doc_id) % 3 AS INT) WHEN 0 THEN '0' WHEN 1 THEN 'all' ELSE '0,14' END AS namespaces, 'wiki' AS mode FROM documents GROUP BY lang, source")
def r04_configured_projects(spark, sf_dir):
    """A JSON file of projects for each language and source, read as configuration."""
    first = docs(spark, sf_dir).groupBy("lang", "source").agg((F.min("doc_id") % 3).alias("m"))
    spaces = F.when(F.col("m") == 1, F.array().cast("array<int>")).when(F.col("m") == 2, F.array(L(14), L(0), L(14)))
    item = F.struct(cat(F.col("lang"), "wiki").alias("project"), L("d.xml").alias("dump_path"), L("i").alias("db_path"), F.col("source").alias("base_url"), spaces.alias("namespaces"))
    path = scratch(spark, "config")
    first.agg(F.to_json(F.struct(F.collect_list(item).alias("projects")))).write.text(path)
    projects = [scan.project_of({k: v for k, v in r.asDict().items() if v is not None}, {}) for r in scan.configured(spark, path).collect()]  # a few projects
    rows = [(p.project, p.base_url, "all" if p.namespaces is None else ",".join(map(str, p.namespaces)), p.mode) for p in projects]
    return spark.createDataFrame(rows, "project string, base_url string, namespaces string, mode string")


@query("SELECT DISTINCT lang || 'wiki' AS project, '/d/' || lang || 'wiki/' || lang || 'wiki-latest-pages-articles.xml.bz2' AS dump, '/i/' || lang || 'wiki_fts' AS index FROM documents")
def r05_projects_by_name(spark, sf_dir):
    names = docs(spark, sf_dir).select(cat(F.col("lang"), "wiki").alias("project")).distinct()
    return names.select("project", scan.places_of(F.col("project"), "/d", "/i").alias("at")).select("project", "at.*")


@query("SELECT doc_id, source AS item, CASE doc_id % 4 WHEN 0 THEN 'blob' WHEN 1 THEN 'tree' WHEN 2 THEN 'raw' ELSE 'path' END AS kind FROM documents")
def r12_input_kinds(spark, sf_dir):
    item = pick(4, cat("https://github.com/o/", F.col("lang"), "/blob/main/x.py"), cat("https://github.com/o/r/tree/", F.col("lang")), cat("http://", F.col("source"), ".org/blob/x"), cat("/data/", F.col("source")))
    return docs(spark, sf_dir).select("doc_id", F.col("source").alias("item"), scan.item_kind(item).alias("kind"))


def _line():
    """A document as a line of JSON, or in its place a blank, broken or other line."""
    row = F.to_json(F.struct("doc_id", "text", "lang"))
    return pick(5, row, row, F.substring(row, 1, 12), L("  "), cat("[", _ID(), "]"))


def _lines(spark, sf_dir):
    path = scratch(spark, "lines")
    docs(spark, sf_dir).select(_line()).write.text(path)
    return path


@query("SELECT doc_id, md5(text) AS digest, lang FROM documents WHERE doc_id % 5 < 2")
def r15_json_objects(spark, sf_dir):
    rows = scan.json_lines(spark, _lines(spark, sf_dir), "doc_id long, text string, lang string", objects=True)
    return rows.select("doc_id", F.md5("text").alias("digest"), "lang")


@query("SELECT substr('{\"doc_id\":' || doc_id || ',\"text\":', 1, 12) AS bad, row_number() OVER (ORDER BY doc_id) * 5 - 2 AS line FROM documents WHERE doc_id % 5 = 2")
def r14_json_faults(spark, sf_dir):
    """One file of all lines, in the order of the ids, read in splits."""
    path = scratch(spark, "lines")
    docs(spark, sf_dir).orderBy("doc_id").select(_line()).coalesce(1).write.text(path)
    return scan.json_line_faults(spark, path).select(F.col("text").alias("bad"), "line")


def _hub(spark, sf_dir) -> str:
    """Datasets below a root: ``web``, with a subset for each language, in splits whose rows lie in the order of their ids."""
    root = scratch(spark, "hub")
    d = docs(spark, sf_dir).select("doc_id", "source", "lang").orderBy("doc_id")
    for lang in ("en", "de"):
        d.filter((F.col("lang") == lang) & (F.col("doc_id") % 2 == 0)).write.parquet(f"{root}/web/{lang}/train")
        d.filter((F.col("lang") == lang) & (F.col("doc_id") % 2 == 1)).write.json(f"{root}/web/{lang}/test")
    return root


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'en'")
def r16_dataset_splits(spark, sf_dir):
    return scan.dataset(spark, _hub(spark, sf_dir), "web:en", ("train", "test")).select("doc_id", "source", "lang")


@query("SELECT 'web:de' AS name, doc_id, source FROM documents WHERE lang = 'de' AND doc_id % 2 = 1")
def r19_first_dataset(spark, sf_dir):
    name, rows = scan.first_that_loads(spark, _hub(spark, sf_dir), ["books", "web:fr", "web:de", "web:en"], splits=("test",))
    return rows.select(L(name).alias("name"), "doc_id", "source")


@query("SELECT * FROM (SELECT doc_id, source FROM documents WHERE lang = 'en' AND doc_id % 2 = 0 ORDER BY doc_id LIMIT 7) UNION ALL SELECT * FROM (SELECT doc_id, source FROM documents WHERE lang = 'en' AND doc_id % 2 = 1 ORDER BY doc_id LIMIT 7)")
def r20_split_slices(spark, sf_dir):
    """The first seven of each split: that is the operator."""
    return scan.dataset(spark, _hub(spark, sf_dir), "web:en", ("train", "test"), 7).select("doc_id", "source")


@query("SELECT doc_id, lang, length(text) AS n FROM documents")
def r21_kept_dataset(spark, sf_dir):
    """Built once; the second call, whose maker would fail, reads what the first one kept."""
    path = scratch(spark, "kept")
    scan.kept_or_built(spark, path, lambda: docs(spark, sf_dir).select("doc_id", "lang", F.length("text").cast("long").alias("n")))
    return scan.kept_or_built(spark, path, lambda: 1 / 0)


SQL["w19_saved_dataset"] = "SELECT doc_id, md5(text) AS digest FROM documents"


@query(SQL["w19_saved_dataset"])
def w19_saved_dataset(spark, sf_dir):
    path = scratch(spark, "saved")
    docs(spark, sf_dir).write.parquet(path)
    return scan.kept_or_built(spark, path, lambda: 1 / 0).select("doc_id", F.md5("text").alias("digest"))


def _runs(spark, sf_dir) -> str:
    """A folder of results for each source, one without a summary."""
    root = scratch(spark, "runs")
    per = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("score"))
    per.withColumn("run", F.col("source")).repartition("run").write.partitionBy("run").json(root)
    return root


@query("SELECT source, count(*) AS n, round(avg(n_chars), 4) AS score FROM documents GROUP BY source")
def r23_found_results(spark, sf_dir):
    rows = scan.results(spark, _runs(spark, sf_dir), "source string, n long, score double")
    return rows.select("source", "n", F.round("score", 4).alias("score"))


@query("SELECT source AS model, round(avg(n_chars), 4) AS score, false AS missing FROM documents WHERE source < 'm' GROUP BY source UNION ALL SELECT DISTINCT source, NULL, true FROM documents WHERE source >= 'm'")
def r22_summaries(spark, sf_dir):
    """A summary for some sources; the folders of the others are told as missing."""
    root = scratch(spark, "evals")
    per = docs(spark, sf_dir).groupBy("source").agg(F.avg("n_chars").alias("score"))
    names = sorted(r[0] for r in per.select("source").collect())  # a few sources
    for n in names:
        if n < "m":
            per.filter(F.col("source") == n).coalesce(1).write.json(f"{root}/{n}/summary.json")
    rows, missing = scan.summaries(spark, [f"{root}/{n}" for n in names], "source string, score double")
    lost = spark.createDataFrame([(p.rsplit("/", 1)[1], None, True) for p in missing], "model string, score double, missing boolean")
    return rows.select(F.col("source").alias("model"), F.round("score", 4).alias("score"), L(False).alias("missing")).unionByName(lost)


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'Legacy' ELSE lang END AS category, CASE WHEN doc_id % 2 = 0 THEN 'general' ELSE '' END AS pattern, CASE WHEN doc_id % 2 = 0 THEN 'Legacy ' || lang || ': ' || substr(text, 1, 100) || '...' ELSE text END AS insight, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 200) ELSE '' END AS evidence, CAST(CASE WHEN doc_id % 4 = 1 THEN doc_id ELSE 1 END AS BIGINT) AS count, '' AS created_at FROM documents")
def r24_skills(spark, sf_dir):
    """Rows of the old and the new shape; the old shape's cuts are the operator's."""
    old = F.to_json(F.struct(F.col("source").alias("tag"), F.col("lang").alias("kind"), "text", F.col("text").alias("evidence")))
    new = F.to_json(F.struct(F.col("lang").alias("category"), F.col("text").alias("insight"), F.when(F.col("doc_id") % 4 == 1, F.col("doc_id")).alias("count")))
    path = scratch(spark, "skills")
    docs(spark, sf_dir).select(F.when(F.col("doc_id") % 2 == 0, old).otherwise(new).alias("value")).unionByName(spark.createDataFrame([("",), ("{",), ("3",)], "value string")).write.text(f"{path}/a.jsonl")
    return scan.skills(spark, path)


@query("SELECT 'https://h.org/' || source || doc_id AS item, true AS remote FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT '/data/' || source || doc_id, false FROM documents WHERE doc_id % 4 = 1")
def r28_repositories(spark, sf_dir):
    line = pick(4, cat(" https://h.org/", F.col("source"), _ID()), cat("/data/", F.col("source"), _ID(), " "), cat("# ", F.col("source")), L(" "))
    path = scratch(spark, "list")
    docs(spark, sf_dir).select(line).write.text(path)
    return scan.repositories(spark, path)


_COLUMNS = {"documents": {"doc_id": "bigint", "lang": "string", "source": "string", "text": "string"}, "labels": {"doc_id": "bigint", "quality": "bigint", "toxic": "bigint"}}
_NAMED = "nullif(source, 'src1')"
_COUNTED = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", {i} AS position, '{c}' AS \"column\", '{k}' AS type, count(*) AS n_rows, count({c if c != 'source' else _NAMED}) AS n_filled FROM {t}" for t, cs in _COLUMNS.items() for i, (c, k) in enumerate(cs.items()))


@query(f"SELECT \"table\", CAST(position AS BIGINT) AS position, \"column\", type, n_rows, n_filled FROM ({_COUNTED}) UNION ALL SELECT 'none', 0, 'missing', '', NULL, NULL")
def r26_schema_report(spark, sf_dir):
    """Columns of two tables and of one that isn't there, with the rows that fill them; one source is made null."""
    tables = {t: read(spark, sf_dir, t).select(*[F.col(c).cast(k).alias(c) for c, k in cs.items()]) for t, cs in _COLUMNS.items()}
    tables["documents"] = tables["documents"].withColumn("source", F.nullif("source", L("src1")))
    return scan.schema_report(spark, tables, ("labels", "none"))


@query("""SELECT 't.' || source || ': ' || CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS line FROM documents""")
def t88_report_lines(spark, sf_dir):
    """Types cut at 400 characters: that is the operator."""
    return scan.report_lines(docs(spark, sf_dir).select(L("t").alias("table"), F.col("source").alias("column"), F.col("text").alias("type")))


# --- sinks -------------------------------------------------------------------------------------
@query("SELECT doc_id, md5(text) AS digest, (SELECT count(*) FROM documents) AS written FROM documents")
def w01_json_lines(spark, sf_dir):
    path = scratch(spark, "json")
    n = sinks.write_json(docs(spark, sf_dir), path)
    back = spark.read.schema("doc_id long, text string").json(path)
    return back.select("doc_id", F.md5("text").alias("digest"), L(n).cast("long").alias("written"))


_ROUTES = {"en": "english", "de": "german", "fr": "other"}
_ROUTE = "CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'other' ELSE 'all' END"


@query(f"SELECT file, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT {_ROUTE} AS file, doc_id FROM documents UNION ALL SELECT 'merged', doc_id FROM documents) GROUP BY 1")
def w09_routed_export(spark, sf_dir):
    path = scratch(spark, "routed")
    counts = sinks.write_routed(docs(spark, sf_dir), path, _ROUTES, column="lang", keys=("doc_id",))
    held = spark.read.schema("doc_id long, file string").json(f"{path}/by_file").groupBy("file").agg(F.sum("doc_id").alias("ids"))
    merged = spark.read.schema("doc_id long").json(f"{path}/merged").agg(F.sum("doc_id").alias("ids")).select(L("merged").alias("file"), "ids")
    return counts.join(held.unionByName(merged), "file")


@query("SELECT lang AS file, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'merged', count(*) FROM documents")
def w02_files_by_type(spark, sf_dir):
    d = docs(spark, sf_dir)
    return sinks.write_routed(d, scratch(spark, "types"), {r[0]: r[0] for r in d.select("lang").distinct().collect()}, column="lang", keys=("doc_id",))


@query("SELECT count(*) AS total, (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)) AS by_lang, 'seed=42' AS config FROM documents")
def w03_manifest(spark, sf_dir):
    path = scratch(spark, "manifest")
    sinks.manifest(docs(spark, sf_dir), ["lang"], {"seed": "42"}, {"all": "x"}).write.json(path)
    back = spark.read.schema("total long, by_lang map<string, long>, config map<string, string>").json(path)
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], L("="), e["value"].cast("string"))), ",")
    return back.select("total", flat("by_lang").alias("by_lang"), flat("config").alias("config"))


def _long_only():
    """Writes a row; a text that is too short can't be written."""

    def encode(row: dict) -> str:
        if len(row["text"] or "") < 100:
            raise ValueError("too short")
        return batches.as_json(row)

    return encode


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents WHERE length(text) < 100")
def w04_left_out_rows(spark, sf_dir):
    """What couldn't be written, row by row; the others of its batches stand."""
    path = scratch(spark, "valid")
    batches.insert(docs(spark, sf_dir).select("doc_id", "text"), path, _long_only(), batch=64)
    ids = F.regexp_extract("row", r"'doc_id': (\d+)", 1)
    return batches.quarantine(spark, path).filter("error = 'ValueError: too short'").agg(F.count("*").alias("n"), F.count_distinct(ids).alias("ids"))


@query("SELECT doc_id, (SELECT count(*) FROM documents WHERE length(text) >= 100) AS inserted FROM documents WHERE length(text) >= 100")
def w04_valid_rows(spark, sf_dir):
    path = scratch(spark, "valid")
    batches.insert(docs(spark, sf_dir).select("doc_id", "text"), path, _long_only())
    told = F.broadcast(batches.manifests(spark, path).agg(F.sum("rows").alias("inserted")))  # one row
    return batches.rows(spark, path, "doc_id long").join(told)


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id % 2, doc_id) AS rn FROM documents) WHERE rn = 1")
def w05_upsert_first(spark, sf_dir):
    """Even ids are there first; then the odd ones come, and those whose key is known are left out."""
    d = docs(spark, sf_dir).select("doc_id", "source", "lang")
    table = KeyedTable(spark, scratch(spark, "keyed"), d.schema, ["source", "lang"])
    for rest in (0, 1):
        table.insert_first(d.filter(F.col("doc_id") % 2 == rest), ["doc_id"])
    return table.read()


@query("SELECT DISTINCT source, lang, text FROM documents")
def w08_hashed_append(spark, sf_dir):
    """Rows arrive twice and overlap; each different one stands once."""
    path = scratch(spark, "hashed")
    d = docs(spark, sf_dir)
    for part in (d.filter("doc_id % 3 < 2"), d.filter("doc_id % 3 > 0"), d):
        sinks.append_hashed(part.select("source", "lang", "text"), path)
    return spark.read.schema("source string, lang string, text string").json(path)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source, '' AS score FROM documents")
def w12_fixed_header(spark, sf_dir):
    path = scratch(spark, "csv")
    rows = docs(spark, sf_dir).select("lang", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"), "doc_id")
    sinks.write_csv(rows, path, ["doc_id", "source", "score"])
    return sinks.read_csv(spark, path)


@query("SELECT lang AS model, CAST(count(*) AS VARCHAR) AS n, '' AS chars, '' AS words FROM documents WHERE lang < 'en' GROUP BY 1 UNION ALL SELECT lang, '', CAST(sum(n_chars) AS VARCHAR), CAST(min(doc_id) AS VARCHAR) FROM documents WHERE lang >= 'en' GROUP BY 1")
def w13_united_header(spark, sf_dir):
    d = docs(spark, sf_dir).withColumnRenamed("lang", "model")
    a = d.filter("model < 'en'").groupBy("model").agg(F.count("*").alias("n"))
    b = d.filter("model >= 'en'").groupBy("model").agg(F.min("doc_id").alias("words"), F.sum("n_chars").alias("chars"))
    rows = sinks.united([a, b], "model")
    path = scratch(spark, "united")
    sinks.write_csv(rows, path, rows.columns)
    return sinks.read_csv(spark, path)


@query("SELECT '| ' || source || ' | ' || CASE WHEN doc_id % 3 = 0 THEN 'N/A' ELSE printf('%.4f', n_chars / 8.0::DOUBLE) END || ' |' AS line FROM documents")
def w14_report_rows(spark, sf_dir):
    rows = docs(spark, sf_dir).select("source", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") / 8.0).alias("score"))
    return sinks.markdown_rows(rows, ["source", "score"])


_CHARS = [f"round(avg({u}), 4) AS {u}_mean, " + ", ".join(f"round(quantile_cont({u}, {q / 100}), 4) AS {u}_p{q}" for q in (50, 90, 95)) + f", CAST(max({u}) AS BIGINT) AS {u}_max" for u in ("chars", "tokens")]
_BUCKETS = f"""WITH one AS (SELECT DISTINCT source AS bucket, text, length(text) AS chars, length(text) // 4 AS tokens, contains(text, 'the ')::INT AS fine FROM documents),
raw AS (SELECT source AS bucket, count(*) AS raw_count FROM documents GROUP BY 1)
SELECT bucket, raw_count, count(*) AS dedup_count, round(1 - count(*) / raw_count::DOUBLE, 6) AS dedup_ratio, round(avg(fine), 6) AS parse_rate, {', '.join(_CHARS)} FROM one JOIN raw USING (bucket) GROUP BY bucket, raw_count"""


@query(_BUCKETS)
def w15_bucket_table(spark, sf_dir):
    """The table of buckets as CSV; read back with its types."""
    path = scratch(spark, "buckets")
    rows = sinks.buckets(docs(spark, sf_dir), "source", "text", F.contains("text", L("the ")))
    sinks.write_csv(rows, path, list(sinks.BUCKETS))
    kinds = dict(rows.dtypes)
    return sinks.read_csv(spark, path).select(*[F.col(c).cast(kinds[c]).alias(c) for c in sinks.BUCKETS])


@query(f"SELECT string_agg(bucket || ':' || dedup_count || ':' || chars_max, ',' ORDER BY bucket) AS summaries, 'a;b' AS checks, 'x' AS name FROM ({_BUCKETS})")
def a31_analysis(spark, sf_dir):
    path = scratch(spark, "analysis")
    sinks.analyse(docs(spark, sf_dir), "source", "text", F.contains("text", L("the ")), path, {"name": "x"}, ["a", "b"])
    report = spark.read.schema("config map<string, string>, summaries array<struct<bucket: string, dedup_count: long, chars_max: long>>, checks array<string>").json(f"{path}/report")
    lines = F.transform("summaries", lambda s: F.concat_ws(":", s["bucket"], s["dedup_count"], s["chars_max"]))
    return report.select(F.array_join(lines, ",").alias("summaries"), F.array_join("checks", ";").alias("checks"), F.col("config")["name"].alias("name"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS success, count(*) FILTER (WHERE quality <> 1) AS failed, count(*) AS tasks FROM labels")
def w20_status(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "success").otherwise("error").alias("status"))
    path = scratch(spark, "status")
    sinks.write_status(rows, path)
    tasks = spark.read.schema("doc_id long, status string").json(f"{path}/tasks").agg(F.count("*").alias("tasks"))
    return spark.read.schema("total long, success long, failed long").json(f"{path}/summary").join(F.broadcast(tasks))  # one row each


@query("SELECT CAST(doc_id AS VARCHAR) AS instance_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS model_patch FROM documents")
def w22_predictions(spark, sf_dir):
    path = scratch(spark, "predictions")
    rows = docs(spark, sf_dir).select(_ID().alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("patch"))
    sinks.write_json(sinks.predictions(rows, "id", "patch"), path)
    return spark.read.schema("instance_id string, model_patch string").json(path)


@query("SELECT event_id, round(CASE WHEN value > 5 THEN user_id / value ELSE 0 END, 3) AS tokens_per_sec, round(event_id * 1000000 / 1073741824.0::DOUBLE, 3) AS peak_memory_gb FROM events")
def a29_generation_speed(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("value") > 5, F.col("value")).otherwise(0.0).alias("s"), (F.col("event_id") * 1000000).alias("m"))
    return sinks.speed_row(e, "user_id", "s", "m").select("event_id", "tokens_per_sec", "peak_memory_gb")


@query("SELECT lang AS bucket, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY 1")
def f20_usable_buckets(spark, sf_dir):
    d = docs(spark, sf_dir)
    parts = {"en": d.filter("lang = 'en'"), "de": d.filter("lang = 'de'"), "none": d.filter("lang = 'no such'"), "odd": d.select("doc_id"), "lost": None}
    out = None
    for name, part in sinks.drop_unusable(parts).items():
        row = part.agg(F.count("*").alias("n")).select(L(name).alias("bucket"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# --- streams -----------------------------------------------------------------------------------
def _arrivals(spark, sf_dir) -> tuple[str, str]:
    """Files of the documents in the order of their ids; their folder and schema."""
    path = scratch(spark, "arrivals")
    docs(spark, sf_dir).select("doc_id", "source", "lang").repartitionByRange(5, "doc_id").write.parquet(path)
    return path, "doc_id long, source string, lang string"


@query("SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang")
def x04_streamed_upsert(spark, sf_dir):
    """All files in one run, and a second run, which adds nothing."""
    source, schema = _arrivals(spark, sf_dir)
    out, mark = scratch(spark, "out"), scratch(spark, "mark")
    for _ in range(2):
        ingest.run_once(spark, source, schema, out, mark, ["source", "lang"], ["doc_id"])
    return spark.read.parquet(out).select("doc_id", "source", "lang")


@query("SELECT count(*) AS seen, count(DISTINCT source || '/' || lang) AS inserted, CAST(5 AS BIGINT) AS batches FROM documents")
def x02_batches_of_files(spark, sf_dir):
    """A batch for each file: what is known is not inserted again, and each batch tells what it has seen."""
    source, schema = _arrivals(spark, sf_dir)
    out, mark = scratch(spark, "out"), scratch(spark, "mark")
    ingest.run_once(spark, source, schema, out, mark, ["source", "lang"], ["doc_id"], files=1)
    told = ingest.progress(spark, out)
    return told.agg(F.sum("seen").alias("seen"), F.sum("inserted").alias("inserted"), F.count("*").alias("batches"))


SQL["x09_progress"] = SQL["x02_batches_of_files"].replace("CAST(5 AS BIGINT) AS batches", "true AS ordered")


@query(SQL["x09_progress"])
def x09_progress(spark, sf_dir):
    source, schema = _arrivals(spark, sf_dir)
    out, mark = scratch(spark, "out"), scratch(spark, "mark")
    ingest.run_once(spark, source, schema, out, mark, ["source", "lang"], ["doc_id"], files=2)
    return ingest.progress(spark, out).agg(F.sum("seen").alias("seen"), F.sum("inserted").alias("inserted"), F.bool_and(F.expr("inserted <= selected and selected <= seen")).alias("ordered"))


@query("SELECT lang, count(*) AS n FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 9 GROUP BY 1")
def x06_streamed_quota(spark, sf_dir):
    source, schema = _arrivals(spark, sf_dir)
    out, mark = scratch(spark, "out"), scratch(spark, "mark")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    stateful.quota(stream, "lang", "doc_id", 9, out, mark, each=docs(spark, sf_dir).select("lang").distinct().count()).awaitTermination()
    return spark.read.parquet(out).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, true AS numbered, true AS moved FROM documents GROUP BY 1")
def x05_shuffle_buffer(spark, sf_dir):
    """A buffer of 50 rows a language: each row leaves it once, in another order than it came in; a last file empties it."""
    source, out = scratch(spark, "arrivals"), scratch(spark, "out")
    d = docs(spark, sf_dir).select("doc_id", "lang", L(False).alias("end"))
    d.repartitionByRange(3, "doc_id").write.parquet(f"{source}/f=1")
    d.groupBy("lang").agg(F.max("doc_id").alias("doc_id")).select((F.col("doc_id") + 1).alias("doc_id"), "lang", L(True).alias("end")).coalesce(1).write.parquet(f"{source}/f=2")
    stream = spark.readStream.schema("doc_id long, lang string, end boolean").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    stateful.shuffled(stream, "lang", "doc_id", 50, "x5").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("doc_id long, lang string, at long").parquet(out)
    numbered = (F.min("at") == 0) & (F.max("at") == F.count("*") - 1) & (F.count_distinct("at") == F.count("*")) & (F.count_distinct("doc_id") == F.count("*"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), numbered.alias("numbered"), (F.corr("at", "doc_id") < 1).alias("moved"))


_WORDS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"


@query(f"SELECT doc_id, CAST(i AS BIGINT) AS at, array_to_string(w[i * 64 + 1:i * 64 + 64], ' ') AS tokens FROM (SELECT doc_id, w, unnest(range(len(w) // 64)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents))")
def x07_token_windows(spark, sf_dir):
    """A stream of texts in windows of 64 words."""
    path, out = scratch(spark, "texts"), scratch(spark, "windows")
    docs(spark, sf_dir).select("doc_id", "text").write.parquet(path)
    made = ingest.token_windows(spark.readStream.schema("doc_id long, text string").parquet(path), tokens(F.col("text")), 64, "doc_id")
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema("doc_id long, at int, tokens array<string>").parquet(out)
    return back.select("doc_id", F.col("at").cast("long").alias("at"), F.array_join("tokens", " ").alias("tokens"))


_KEY = "sha1('x5:' || doc_id)"


@query(f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS BIGINT) AS at FROM documents")
def x05_shuffled_order(spark, sf_dir):
    """The order of a seeded hash in place of a shuffle buffer."""
    from tessera.operators.mix import numbered

    return numbered(docs(spark, sf_dir).select("doc_id"), [], "x5", "doc_id").select("doc_id", F.col("at").cast("long").alias("at"))


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha1('r17:' || doc_id), doc_id) AS rn FROM documents WHERE length(text) BETWEEN 50 AND 100000) WHERE rn <= 20")
def r17_quota_by_language(spark, sf_dir):
    """Texts of a fair length, shuffled, up to a quota a language."""
    d = docs(spark, sf_dir).filter(F.length("text").between(50, 100000))
    return O.first_n_per_group(d, ["lang"], 20, [T.shuffle_key("r17", F.col("doc_id")), "doc_id"]).select("doc_id", "text")


# --- the stored index --------------------------------------------------------------------------
def _upkept(spark, sf_dir, merged: bool):
    """An index of the documents that has seen them come in two parts, one of them in another shape, change, and go."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    index = Index(spark)
    index.put(d.filter("doc_id % 2 = 0").withColumn("text", cat("licensed under ", F.col("text"))))
    index.put(d.filter("doc_id % 2 = 1"))
    index.put(d.filter("doc_id % 2 = 0"))
    index.delete(d.filter("doc_id % 7 = 3").select("doc_id"))
    if merged:
        index.merge()
    return index.search("licensed OR under").select("doc_id", F.round("score", 6).alias("score"))


@query()
def w06_index_upkeep(spark, sf_dir):
    return _upkept(spark, sf_dir, False)


@query()
def w07_merged_index(spark, sf_dir):
    return _upkept(spark, sf_dir, True)
