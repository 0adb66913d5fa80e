"""Queries of the skill register."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import skills as K
from tessera.plans.base import query, read

_AT = "lpad(CAST(event_id AS VARCHAR), 12, '0')"


@query(f"SELECT event_type AS category, CAST(user_id AS VARCHAR) AS insight, max({_AT}) AS evidence, count(*) AS count, max({_AT}) AS created_at FROM events GROUP BY 1, 2")
def w11_counted_insights(spark, sf_dir):
    at = F.lpad(F.col("event_id").cast("string"), 12, "0")
    rows = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("insight"), at.alias("evidence"), at.alias("created_at"))
    ledger = rows.filter("event_id % 2 = 0").drop("event_id").withColumn("count", F.lit(1).cast("long"))
    return K.counted(ledger, rows.filter("event_id % 2 <> 0").drop("event_id"))


@query("SELECT CAST(label AS VARCHAR) AS skill_name, max(vec_id) AS version FROM embeddings GROUP BY 1")
def w10_latest_entries(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("skill_name"), F.col("vec_id").alias("version"))
    return K.latest(rows.filter("version % 2 = 0"), rows.filter("version % 2 <> 0"))


_WANTED = [float(i % 7 - 3) for i in range(64)]


@query(f"SELECT CAST(vec_id AS VARCHAR) AS skill_name, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_WANTED}::DOUBLE[]) AS s FROM embeddings) WHERE s >= 0.1 ORDER BY s DESC, CAST(vec_id AS VARCHAR) LIMIT 5")
def j06_routed_query(spark, sf_dir):
    index = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("skill_name"), "embedding")
    return K.route(index, _WANTED, 5, 0.1).select("skill_name", F.round("score", 6).alias("score"))


_STEPS = "[" + ", ".join(f"'{s}'" for s in K.STEPS) + "]"


@query(f"""WITH c AS (SELECT lang AS n, count(*) AS k FROM documents WHERE lang IS NOT NULL GROUP BY 1),
s AS (SELECT n, step FROM (SELECT n, unnest({_STEPS}) AS step FROM c)),
plan AS (SELECT n, string_agg(step, ' -> ' ORDER BY sha1('7:' || n || ':' || step)) AS p FROM s GROUP BY n)
SELECT n AS skill_name, 'Which skill can do general automation?' AS user, n || ' can. What it is for: texts in ' || n AS assistant, 'skill_routing_positive' AS type, '' AS neighbor_skill FROM c
UNION ALL SELECT n, 'Please have ' || o || ' see to this.', 'Then ' || n || ' is the wrong one; take ' || o || '.', 'skill_routing_negative', o FROM (SELECT n, unnest(['de', 'fr']) AS o FROM c WHERE n = 'en')
UNION ALL SELECT n, 'Please translate my whole website.', n || ' can''t do that. What it is for: texts in ' || n, 'skill_routing_negative', '' FROM c WHERE n <> 'en'
UNION ALL SELECT n, 'Start ' || n || ' without any input.', n || ' needs text, which is missing. Give it first.', 'skill_input_check', '' FROM c
UNION ALL SELECT n, 'In which steps would you use ' || n || '?', p, 'skill_planning', '' FROM plan
UNION ALL SELECT n, 'Which arguments does ' || n || ' take?', '{{"text": "<text_value>"}}', 'skill_argument_construction', '' FROM c
UNION ALL SELECT n, 'What came out of ' || n || '?', n || ' ran through, ' || k || ' files in all. The findings and what to do next follow.', 'skill_result_synthesis', '' FROM c
UNION ALL SELECT n, n || ' has failed. What now?', 'It was runtime_error. Read its log, mend the input, then start run.py again.', 'skill_failure_recovery', '' FROM c""")
def u13_behaviours(spark, sf_dir):
    """Each language is a skill; English has two near ones."""
    none = F.array().cast("array<string>")
    by_lang = read(spark, sf_dir, "documents").filter("lang is not null").groupBy(F.col("lang").alias("skill_name")).agg(F.count("*").alias("n_files"))
    cards = by_lang.select("skill_name", F.concat(F.lit("texts in "), "skill_name").alias("summary"), F.lit("run.py").alias("entrypoint"), none.alias("capabilities"), F.array(F.lit("text")).alias("required_inputs"), none.alias("failure_modes"), "n_files")
    near = by_lang.select("skill_name", F.when(F.col("skill_name") == "en", F.array(F.lit("de"), F.lit("fr"))).alias("neighbors"))
    return K.behaviours(cards, near)
