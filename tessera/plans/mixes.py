"""Queries of sampling, mixing, joining and dedup operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import parse as P
from tessera.functions import text as T
from tessera.operators import mix as M
from tessera.operators import order as O
from tessera.operators.patterns import first_of, matches
from tessera.plans.base import U01, query, read

_ORDER = "ORDER BY sha1('{}:' || doc_id), doc_id"


def docs(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents").select("doc_id", *columns)


# --- samples and mixes -------------------------------------------------------------------------
@query(f"""WITH k AS (SELECT least(30, greatest(5, CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT))) AS k FROM documents WHERE lang = 'de')
SELECT doc_id, 'own' AS pool FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'public' FROM (SELECT doc_id, row_number() OVER ({_ORDER.format(5)}) AS rn FROM documents WHERE lang <> 'de'), k WHERE rn <= k""")
def m05_capped_public(spark, sf_dir):
    d = docs(spark, sf_dir, "lang")
    own = d.filter("lang = 'de'").select("doc_id", F.lit("own").alias("pool"))
    k = M.capped_target(own.count(), 0.5, 5, 30)
    return own.unionByName(O.sample_n(d.filter("lang <> 'de'"), k, "5", "doc_id").select("doc_id", F.lit("public").alias("pool")))


@query(f"""WITH c(lang, cap, o) AS (VALUES ('en', 30, 0), ('de', 20, 1), ('fr', 10, 2)), q AS (SELECT lang, o, least(cap, count(*)) AS k FROM documents JOIN c USING (lang) GROUP BY lang, cap, o),
g AS (SELECT *, greatest(0, k - 15) AS can, sum(k) OVER () - 40 AS over FROM q), s AS (SELECT *, coalesce(sum(can) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given FROM g),
r AS (SELECT lang, k - least(can, greatest(0, over - given)) AS quota FROM s)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang {_ORDER.format(8)}) AS rn FROM documents) JOIN r USING (lang) WHERE rn <= quota""")
def m08_fixed_quotas(spark, sf_dir):
    d = docs(spark, sf_dir, "lang")
    quota = M.shrunk(M.supply(d, "lang"), {"en": 30, "de": 20, "fr": 10}, 40, 15, ["en", "de", "fr"])
    return M.take(d, "lang", quota, "8", "doc_id").select("doc_id", "lang")


@query(f"""WITH c(lang, w) AS (VALUES ('en', 3), ('de', 2), ('fr', 1)), r AS (SELECT lang, least(floor(100 * w / 6.0::DOUBLE), count(*)) AS quota FROM documents JOIN c USING (lang) GROUP BY lang, w)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang {_ORDER.format(10)}) AS rn FROM documents) JOIN r USING (lang) WHERE rn <= quota""")
def m10_weighted_shares(spark, sf_dir):
    d = docs(spark, sf_dir, "lang")
    return M.take(d, "lang", M.by_weight(M.supply(d, "lang"), {"en": 3, "de": 2, "fr": 1}, 100), "10", "doc_id").select("doc_id", "lang")


@query(f"""WITH w AS (SELECT i, {U01.format("'11b:' || i")} AS b, {U01.format("'11i:' || i")} AS u FROM range(1000) t(i)), d AS (SELECT i, CASE WHEN b < 3 / 4.0::DOUBLE THEN 'en' ELSE 'fr' END AS lang, u FROM w),
p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang {_ORDER.format(11)}) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN ('en', 'fr'))
SELECT i, doc_id, lang FROM d JOIN p USING (lang) WHERE place = floor(u * n)""")
def m11_weighted_repeats(spark, sf_dir):
    d = docs(spark, sf_dir, "lang").filter("lang in ('en', 'fr')")
    return M.with_replacement(d, "lang", {"en": 3, "fr": 1}, 1000, "11", "doc_id").select("i", "doc_id", "lang")


@query(f"""WITH k AS (SELECT CAST(floor(count(*) * 0.25::DOUBLE / 0.75::DOUBLE) AS BIGINT) AS k FROM documents WHERE lang = 'en')
SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER ({_ORDER.format(12)}) AS rn FROM documents WHERE lang <> 'en'), k WHERE rn <= k""")
def m12_chat_share(spark, sf_dir):
    d = docs(spark, sf_dir, "lang")
    first = d.filter("lang = 'en'")
    return first.unionByName(O.sample_n(d.filter("lang <> 'en'"), M.share_beside(first.count(), 0.25), "12", "doc_id"))


@query(f"SELECT doc_id, rn <= least(2000, greatest(200, n // 50)) AS is_eval FROM (SELECT doc_id, row_number() OVER ({_ORDER.format(14)}) AS rn, count(*) OVER () AS n FROM documents)")
def m14_exact_split(spark, sf_dir):
    d = docs(spark, sf_dir)
    return M.numbered(d, [], "14", "doc_id").select("doc_id", (F.col("at") < O.eval_size(d.count())).alias("is_eval"))


@query(f"SELECT doc_id, row_number() OVER ({_ORDER.format(15)}) - 1 AS place FROM documents")
def m15_shuffle(spark, sf_dir):
    return M.numbered(docs(spark, sf_dir), [], "15", "doc_id", to="place")


@query("SELECT page_id, place FROM (SELECT page_id, row_number() OVER (PARTITION BY host ORDER BY sha1('16:' || page_id), page_id) AS place FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages)) WHERE place <= 2")
def m16_cap_per_file(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.parse_url(F.col("url"), F.lit("HOST")).alias("host"))
    return O.first_n_per_group(p, ["host"], 2, [T.shuffle_key("16", F.col("page_id")), F.col("page_id")], "place").select("page_id", F.col("place").cast("long").alias("place"))


@query(f"SELECT doc_id, CASE (row_number() OVER ({_ORDER.format(17)}) - 1) % 3 WHEN 0 THEN 'Complete:' WHEN 1 THEN 'Continue:' ELSE 'Fill in:' END AS template FROM documents")
def m17_rotated_templates(spark, sf_dir):
    return M.rotated(docs(spark, sf_dir), ["Complete:", "Continue:", "Fill in:"], "17", "doc_id")


@query("SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages ORDER BY 1 LIMIT 200")
def m20_top_level(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.parse_url(F.col("url"), F.lit("HOST")).alias("host")).distinct().orderBy("host").limit(200)




# --- joins -------------------------------------------------------------------------------------
_PATHS = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'src/m' || doc_id || '.py' WHEN 1 THEN 'src/test_m' || (doc_id - 1) || '.py' ELSE 'tests/m' || (doc_id - 2) || '_test.py' END AS path FROM documents"


def test_pairs(files, key="doc_id"):
    """Each source with the first of its six possible test files that exists."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    test, tested = F.concat(F.lit("test_"), stem, F.lit(".py")), F.concat(stem, F.lit("_test.py"))
    names = F.array(test, tested, F.concat(F.lit("tests/"), test), F.concat(F.lit("tests/"), tested), F.concat(folder, test), F.concat(folder, F.lit("tests/"), test))
    wanted = files.select(F.col(key).alias("source_id"), F.posexplode(names).alias("pos", "path"))
    found = wanted.join(files.select(F.col(key).alias("test_id"), "path"), "path")
    return found.groupBy("source_id").agg(F.min_by("test_id", F.struct("pos", "test_id")).alias("test_id"))


@query(f"WITH f AS ({_PATHS}) SELECT s.doc_id AS source_id, coalesce(b.doc_id, a.doc_id) AS test_id FROM f s LEFT JOIN f a ON a.doc_id = s.doc_id + 1 LEFT JOIN f b ON b.doc_id = s.doc_id + 2 WHERE s.doc_id % 3 = 0 AND coalesce(b.doc_id, a.doc_id) IS NOT NULL")
def j02_test_pairs(spark, sf_dir):
    i = F.col("doc_id")
    path = F.when(i % 3 == 0, F.concat(F.lit("src/m"), i, F.lit(".py"))).when(i % 3 == 1, F.concat(F.lit("src/test_m"), i - 1, F.lit(".py"))).otherwise(F.concat(F.lit("tests/m"), i - 2, F.lit("_test.py")))
    return test_pairs(docs(spark, sf_dir, path.alias("path")))


def resolved(raw, known):
    """raw: (raw); known: (path).  Exact, else the only path that ends in it, else the only one of its base name.

    Paths are counted by base name and by their last parts, as many as some raw path has; so no raw path meets all paths of its base name.
    """
    deep = lambda c: F.size(F.split(c, "/", -1))
    ask = raw.select("raw").distinct().withColumn("b", F.substring_index("raw", "/", -1))
    sizes = F.broadcast(ask.filter("raw is not null").select(deep("raw").alias("parts")).distinct())  # a few numbers
    paths = known.select("path").filter("path is not null").distinct()
    bases = paths.groupBy(F.substring_index("path", "/", -1).alias("b")).agg(F.count("*").alias("n_b"), F.max("path").alias("p"))
    tails = paths.withColumn("deep", deep("path")).join(sizes, F.col("deep") >= F.col("parts"))
    longer = F.col("deep") > F.col("parts")  # else the path is the tail itself
    ends = tails.groupBy(F.call_function("substring_index", "path", F.lit("/"), -F.col("parts")).alias("raw")).agg(F.max(F.when(~longer, F.col("path"))).alias("e"), F.count_if(longer).alias("n_s"), F.max(F.when(longer, F.col("path"))).alias("s"))
    got = ask.join(bases, "b", "left").join(ends, "raw", "left")
    return got.select("raw", F.coalesce("e", F.when(F.col("n_s") == 1, F.col("s")), F.when(F.col("n_b") == 1, F.col("p"))).alias("path"))


@query("""WITH k AS (SELECT DISTINCT url AS path FROM pages), r AS (SELECT DISTINCT list_extract(string_split(url, '/'), -2) || '/' || list_extract(string_split(url, '/'), -1) AS raw FROM pages)
SELECT raw, CASE WHEN count(path) FILTER (WHERE path = raw) > 0 THEN raw WHEN count(path) FILTER (WHERE ends_with(path, '/' || raw)) = 1 THEN max(path) FILTER (WHERE ends_with(path, '/' || raw)) WHEN count(path) = 1 THEN max(path) END AS path
FROM r LEFT JOIN k ON list_extract(string_split(path, '/'), -1) = list_extract(string_split(raw, '/'), -1) GROUP BY raw""")
def t81_resolved_paths(spark, sf_dir):
    known = read(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return resolved(known.select(F.substring_index("path", "/", -2).alias("raw")), known)


@query("""WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, i), v AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, CAST(rn AS BIGINT) AS rank, CAST(other AS BIGINT) AS other, round(s, 6) AS score FROM (SELECT a.label, b.label AS other, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.label ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.label) AS rn FROM v a JOIN v b ON a.label <> b.label) WHERE rn <= 2""")
def j07_nearest_labels(spark, sf_dir):
    """The two nearest other labels of each label, by mean vector; labels are few, vectors of pairs stay a small table."""
    from tessera.functions.text import cosine

    e = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    pairs = v.join(v.select(F.col("label").alias("other"), F.col("v").alias("w")), F.col("label") != F.col("other")).withColumn("s", cosine(F.col("v"), F.col("w")))
    return O.first_n_per_group(pairs, ["label"], 2, [F.desc("s"), F.col("other")], "rank").select("label", F.col("rank").cast("long").alias("rank"), "other", F.round("s", 6).alias("score"))


_STACKS = {"web": ["http", "html"], "law": ["licen", "court"], "code": ["def ", "import "]}


_TRIGGERS = [(t, k) for k, ts in _STACKS.items() for t in ts]


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{t}{chr(39)})' for t in ts)} THEN '{k}' END" for k, ts in _STACKS.items()) + "], lambda x: x IS NOT NULL), ',') AS stacks FROM documents")
def j09_trigger_lists(spark, sf_dir):
    triggers = spark.createDataFrame(_TRIGGERS, "pattern string, stack string")
    d = docs(spark, sf_dir, F.lower("text").alias("low"))
    found = matches(d, "doc_id", "low", triggers, "pattern").join(triggers, "pattern")
    stacks = found.groupBy("doc_id").agg(F.collect_set("stack").alias("s"))  # as many as there are stacks
    order = F.array(*[F.lit(k) for k in _STACKS])
    return d.join(stacks, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.array_intersect(order, "s"), ","), F.lit("")).alias("stacks"))


_DIR = "'/clones/' || CASE WHEN doc_id % 4 = 0 THEN 'own' ELSE lang || '__' || source END || '/part' || (doc_id % 7)"


@query(f"""WITH u AS (SELECT lang || '__' || source AS slug, 'https://github.com/' || lang || '/' || source AS url, row_number() OVER (ORDER BY sha1(source || lang), lang, source) AS place FROM (SELECT DISTINCT lang, source FROM documents)),
d AS (SELECT doc_id, {_DIR} AS dir FROM documents)
SELECT doc_id, coalesce('github:' || min_by(url, place), 'local:' || dir) AS tag FROM d LEFT JOIN u ON contains(dir, slug) GROUP BY doc_id, dir""")
def j11_source_tag(spark, sf_dir):
    """The first address of the list whose owner__name stands in the folder; a folder without one is local."""
    d = read(spark, sf_dir, "documents")
    urls = d.select("lang", "source").distinct().select(F.concat(F.lit("https://github.com/"), "lang", F.lit("/"), "source").alias("url"), F.sha1(F.concat("source", "lang")).alias("at"))
    urls = urls.select("url", P.repo_slug(F.col("url")).alias("slug"), F.row_number().over(Window.orderBy("at", "url")).alias("place"))
    folder = F.concat(F.lit("/clones/"), F.when(F.col("doc_id") % 4 == 0, "own").otherwise(F.concat("lang", F.lit("__"), "source")), F.lit("/part"), (F.col("doc_id") % 7).cast("string"))
    rows = first_of(d.select("doc_id", folder.alias("dir")), "doc_id", "dir", urls, "slug", "url", "place")
    return rows.select("doc_id", F.coalesce(F.concat(F.lit("github:"), "url"), F.concat(F.lit("local:"), "dir")).alias("tag"))


# --- dedup and sets ----------------------------------------------------------------------------
@query("SELECT min(conv_id * 1000 + turn) AS id FROM conversations GROUP BY sha1(role || text)")
def d02_dedup_key_and_answer(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.groupBy(F.sha1(F.concat("role", "text").cast("binary")).alias("h")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("id")).select("id")


@query("SELECT min(conv_id) AS conv_id, role, count(*) AS n FROM conversations GROUP BY role, text")
def d04_dedup_by_struct(spark, sf_dir):
    """Keys are compared by the digest of their JSON, so that no long text is shuffled."""
    c = read(spark, sf_dir, "conversations")
    key = F.sha2(F.to_json(F.struct("role", "text")), 256)
    return c.groupBy(key.alias("h"), "role").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).drop("h")


@query("SELECT min(o) AS first, count(*) AS n FROM (SELECT 'a' || doc_id AS o, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark) GROUP BY text")
def d05_dedup_across_sources(spark, sf_dir):
    rows = docs(spark, sf_dir, "text").select(F.concat(F.lit("a"), "doc_id").alias("o"), F.sha2("text", 256).alias("h"))
    rows = rows.unionByName(read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("o"), F.sha2("text", 256).alias("h")))
    return rows.groupBy("h").agg(F.min("o").alias("first"), F.count("*").alias("n")).drop("h")


@query("SELECT doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def d10_union_of_keys(spark, sf_dir):
    return docs(spark, sf_dir, "lang").withColumnRenamed("doc_id", "id").unionByName(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id IN (SELECT doc_id FROM labels)")
def d11_set_difference(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    return docs(spark, sf_dir).join(labels.select("doc_id"), "doc_id", "left_semi").join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")
