"""Queries of evaluation reports: rates, pivots, flattened results, federated search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.percentiles import percentiles
from tessera.plans.base import query, read


def events(spark, sf_dir):
    return read(spark, sf_dir, "events")


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def a02_percentiles_in_per_cent(spark, sf_dir):
    told = percentiles(events(spark, sf_dir), ["event_type"], F.col("value"), {f"p{pct}": pct / 100 for pct in (5, 99)})
    return told.select("event_type", F.round("p5", 6).alias("p5"), F.round("p99", 6).alias("p99"))


@query("SELECT user_id % 4 AS prefill, count(*) AS n, round(coalesce(sum(event_id) FILTER (WHERE value > 5) / nullif(sum(value) FILTER (WHERE value > 5), 0), 0), 4) AS throughput FROM events GROUP BY GROUPING SETS ((user_id % 4), ())")
def a06_speed_with_total(spark, sf_dir):
    e = events(spark, sf_dir).select(F.expr("user_id % 4").alias("prefill"), "event_id", "value")
    fine = lambda c: F.sum(F.when(F.col("value") > 5, F.col(c)))
    return e.groupingSets([[F.col("prefill")], []], "prefill").agg(F.count("*").alias("n"), F.round(F.coalesce(F.try_divide(fine("event_id"), fine("value")), F.lit(0.0)), 4).alias("throughput"))


@query("SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def a09_last_record_wins(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("SELECT user_id, round(100 * avg((event_id % 3 = 0)::INT), 4) AS accuracy FROM events GROUP BY 1")
def a10_passkey_accuracy(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(100 * F.avg((F.col("event_id") % 3 == 0).cast("int")), 4).alias("accuracy"))


@query("SELECT event_type AS model, metric, round(CASE WHEN value <= 1 THEN value * 100 ELSE value END, 4) AS value FROM (SELECT event_type, avg(value) AS mean, avg((value > 100)::INT) AS share FROM events GROUP BY 1) UNPIVOT (value FOR metric IN (mean, share))")
def a14_flattened_results(spark, sf_dir):
    tree = events(spark, sf_dir).groupBy("event_type").agg(F.create_map(F.lit("mean"), F.avg("value"), F.lit("share"), F.avg((F.col("value") > 100).cast("int"))).alias("m"))
    flat = tree.select(F.col("event_type").alias("model"), F.explode("m").alias("metric", "value"))
    return flat.withColumn("value", F.round(F.when(F.col("value") <= 1, F.col("value") * 100).otherwise(F.col("value")), 4))


@query("SELECT CASE WHEN contains(event_type, 'view') OR contains(event_type, 'click') THEN 'accuracy' WHEN contains(event_type, 'error') THEN 'speed' ELSE 'other' END AS family, count(*) AS n FROM events GROUP BY 1")
def a15_metric_families(spark, sf_dir):
    c = F.col("event_type")
    family = F.when(F.contains(c, F.lit("view")) | F.contains(c, F.lit("click")), "accuracy").when(F.contains(c, F.lit("error")), "speed").otherwise("other")
    return events(spark, sf_dir).groupBy(family.alias("family")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS benchmark, round(avg(value) FILTER (WHERE user_id % 3 = 0), 6) AS case_0, round(avg(value) FILTER (WHERE user_id % 3 = 1), 6) AS case_1, round(avg(value) FILTER (WHERE user_id % 3 = 2), 6) AS case_2 FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1")
def a16_chart_pivot(spark, sf_dir):
    ok = events(spark, sf_dir).filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("c", F.concat(F.lit("case_"), F.col("user_id") % 3))
    out = ok.groupBy(F.col("event_type").alias("benchmark")).pivot("c", ["case_0", "case_1", "case_2"]).avg("value")
    return out.select("benchmark", *[F.round(f"case_{i}", 6).alias(f"case_{i}") for i in range(3)])


@query("SELECT event_type, round(avg(ln(1 + value)), 6) AS mean, round(stddev_pop(ln(1 + value)), 6) AS std FROM events GROUP BY 1")
def a18_nll_spread(spark, sf_dir):
    x = F.ln(1 + F.col("value"))
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value + 1 WHEN 2 THEN value + 2 ELSE value + 3 END AS metric FROM events")
def a20_representative_metric(spark, sf_dir):
    """The first of the known metrics that a result has."""
    k, v = F.col("event_id") % 4, F.col("value")
    result = F.create_map(F.when(k == 0, "acc").when(k == 1, "acc_norm").when(k == 2, "f1").otherwise("other"), v + k, F.lit("zz"), F.lit(-1.0))
    known = [result[m] for m in ("acc", "acc_norm", "exact_match", "f1", "bleu", "pass@1")]
    return events(spark, sf_dir).select("event_id", F.coalesce(*known, F.element_at(F.map_values(result), 1)).alias("metric"))


@query("""WITH r AS (SELECT user_id, count(*) FILTER (WHERE value > 100) / greatest(1, count(*) FILTER (WHERE value > 20))::DOUBLE AS rate FROM events GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS runs, round(max(rate), 6) AS best, max_by(user_id, (rate, -user_id)) AS best_run FROM r""")
def a21_resolve_rate(spark, sf_dir):
    r = events(spark, sf_dir).groupBy("user_id").agg((F.count_if(F.col("value") > 100) / F.greatest(F.lit(1), F.count_if(F.col("value") > 20))).alias("rate"))
    return r.agg(F.count("*").alias("runs"), F.round(F.max("rate"), 6).alias("best"), F.max_by("user_id", F.struct("rate", -F.col("user_id"))).alias("best_run"))


@query("""WITH h AS (SELECT event_id AS pos, m, ((event_id + m * m) % 3 > 0)::INT AS correct FROM events, range(1, 5) t(m)), p AS (SELECT m, correct, min(correct) OVER (PARTITION BY pos ORDER BY m ROWS UNBOUNDED PRECEDING) AS prefix FROM h)
SELECT m AS head, round(avg(correct), 6) AS accuracy, round(avg(prefix), 6) AS accepted FROM p GROUP BY m""")
def a22_prefix_acceptance(spark, sf_dir):
    """A prefix is accepted as far as all its heads are right; an array function, so no window is needed."""
    right = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda m: ((F.col("event_id") + m * m) % 3 > 0).cast("int"))
    rows = events(spark, sf_dir).select(right.alias("c")).select("c", F.posexplode("c").alias("i", "correct"))
    prefix = F.array_min(F.slice("c", F.lit(1), F.col("i") + 1))
    return rows.groupBy((F.col("i") + 1).cast("long").alias("head")).agg(F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg(prefix), 6).alias("accepted"))


@query("SELECT lang AS category, string_agg(DISTINCT source, '; ' ORDER BY source) AS lines FROM documents WHERE lang <> 'es' GROUP BY lang")
def a23_grouped_skills(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("lang <> 'es'")
    return d.groupBy(F.col("lang").alias("category")).agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("lines"))


@query("SELECT event_type, round(100 * sum(event_id % 4) / greatest(1, sum(4))::DOUBLE, 6) AS accepted, round(sum(event_id % 4 + 1) / greatest(1, count(*))::DOUBLE, 6) AS speed_up FROM events GROUP BY 1")
def a28_draft_acceptance(spark, sf_dir):
    got = F.col("event_id") % 4
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(100 * F.sum(got) / F.greatest(F.lit(1), F.sum(F.lit(4))), 6).alias("accepted"), F.round(F.sum(got + 1) / F.greatest(F.lit(1), F.count("*")), 6).alias("speed_up"))


@query("SELECT event_type, round(exp(avg(value / 100)), 6) AS ppl FROM events GROUP BY 1")
def a30_unweighted_perplexity(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.exp(F.avg(F.col("value") / 100)), 6).alias("ppl"))


@query("""SELECT coalesce(a.event_type, b.event_type) AS task, round(a.m, 6) AS base, round(b.m, 6) AS tuned, round(b.m - a.m, 6) AS gain FROM (SELECT event_type, avg(value) AS m FROM events WHERE user_id % 2 = 0 GROUP BY 1) a
FULL JOIN (SELECT event_type, avg(value) AS m FROM events WHERE user_id % 2 = 1 GROUP BY 1) b ON a.event_type = b.event_type""")
def a27_summary_comparison(spark, sf_dir):
    """Both sides in one pass over the rows."""
    side = lambda i: F.avg(F.when(F.col("user_id") % 2 == i, F.col("value")))
    out = events(spark, sf_dir).groupBy(F.col("event_type").alias("task")).agg(side(0).alias("b"), side(1).alias("t"))
    return out.select("task", F.round("b", 6).alias("base"), F.round("t", 6).alias("tuned"), F.round(F.col("t") - F.col("b"), 6).alias("gain"))
