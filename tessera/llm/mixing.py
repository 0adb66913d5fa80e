"""Mixing sources to target weights by entropy balancing.

Every document starts with rate 1 per word.  The rates sought lie between 0 and ``MOST``, stay
closest to the start in relative entropy and meet token constraints:

* the words taken of each source are the source's target;
* the mix has the word-weighted mean of a document feature (default: the log of its size) that the corpus has,
  so that moving words between sources doesn't shift it.  This one is soft: its multiplier mu is held
  by a penalty ``RIDGE``, so that there is a solution even if sources alone settle the feature.

They are exponentially tilted: rate = min(MOST, exp(lambda of its source + mu * z)), z being the
feature in standard deviations from its mean.  The multipliers solve the convex dual, by Newton steps:
each one is an aggregation over all documents that gives each source's gradient and its
entries of the Hessian.  That matrix is an arrow (sources don't touch each other), so mu's step comes from
sums over sources (a Schur complement) and each source's from its own row; no matrix is gathered.
At last mu stays and each source's lambda is settled between brackets.  Rates are then
rounded into copies.

Rounding: the documents of a source are dealt by hash into buckets of
about ``BUCKET`` documents, as many as the source needs; within a bucket, the largest
first, each takes the whole number of copies (its rate rounded down or up) that
brings the bucket's running sum nearest to that of rate times size, the remainder being
carried on.  A hot source is many buckets; no task holds a whole source.

Null text or source is allowed: size 0, and the null source comes last in order.
Documents of size 0 take 0 words but keep the copies that their rate, rounded down, gives them.
Repeated rows are documents of their own; ties in size go by doc_id, then by all
equal.  Texts of any length count whole.  Only ``doc_id``, ``source`` and the text are read, other columns (of
whatever name) aren't.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, words_count

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BUCKET = 2048
#: Newton steps of both multipliers and of lambda alone, at most; error of a source's words, relative, at which to stop.
STEPS, POLISH, EXACT = 12, 30, 1e-6
RIDGE = 0.01


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes.  No target exceeds ``most`` times its source's size;
    the excess is shared again by weight.  In the end the capped sources are those
    with the smallest cap for their weight, so one pass in that order finds them: of the levels
    that leave their source and all later ones uncapped, the first is the highest.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everyone))
    return per.select("source", "n_docs", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _total(c: Column) -> Column:
    """The sum in decimals of six places, which is the same in whatever order tasks add up."""
    return F.sum(c.cast("decimal(28,6)")).cast("double")


def _sums(docs: DataFrame, state: DataFrame, mu: float, most: float) -> DataFrame:
    """``state`` (source, ..., lambda), a row per source, with this point's sums over its documents:
    words (taken), words_z, and of documents below the bound free, free_z and free_zz."""
    rows = docs.join(state.select(F.col("source").alias("__source"), "lambda"), F.col("source").eqNullSafe(F.col("__source")))
    tilted = F.exp(F.col("lambda") + mu * F.col("z"))
    taken = F.col("size") * F.least(F.lit(float(most)), tilted)
    free = F.when(tilted < most, taken).otherwise(0.0)
    per = rows.groupBy(F.col("source").alias("__source")).agg(*[_total(x).alias(n) for n, x in (("words", taken), ("words_z", taken * F.col("z")), ("free", free), ("free_z", free * F.col("z")), ("free_zz", free * F.col("z") * F.col("z")))])
    return stored(state.join(per, state.source.eqNullSafe(per["__source"])).drop("__source"), "newton")


def balance(docs: DataFrame, per: DataFrame, most: float = MOST, ridge: float = RIDGE) -> tuple[DataFrame, float]:
    """``per`` with lambda, and mu, from (source, size, z) and (source, source_size, target).

    A source without words or target has no lambda (its rate is 0); one whose target is all that
    ``most`` allows has an infinite one.  Of each source only a row of sums is kept.
    """
    solvable = per.filter("source_size > 0 and target > 0")
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-9)
    start = F.when(full, float("inf")).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = solvable.withColumn("full", full).withColumn("lambda", start)
    gap, error = F.col("words") - F.col("target"), F.abs(F.col("words") / F.col("target") - 1)
    open_ = ~F.col("full")
    free = F.greatest("free", 1e-9 * F.col("target"))
    mu, columns = 0.0, state.columns
    for _ in range(STEPS):
        sums = _sums(docs, state, mu, most)
        r = sums.agg(
            _total(F.col("words")).alias("words"), _total(F.col("words_z")).alias("g"), F.max(F.when(open_, error)).alias("error"),
            _total(F.when(open_, F.col("free_zz") - F.col("free_z") ** 2 / free)).alias("h"), _total(F.when(open_, F.col("free_z") * gap / free)).alias("gap"),
        ).first()
        if not r.words or r.h is None:
            break
        off = r.g + ridge * r.words * mu
        if r.error < EXACT and abs(off) < EXACT * r.words:
            break
        step = max(-1.0, min(1.0, (r.gap - off) / (r.h + ridge * r.words)))
        by = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -(gap + F.col("free_z") * step) / free))
        state = sums.withColumn("lambda", F.when(open_, F.col("lambda") + by).otherwise(F.col("lambda"))).select(*columns)
        mu += step
    state = state.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
    for _ in range(POLISH):
        sums = _sums(docs, state, mu, most)
        worst = sums.agg(F.max(F.when(open_, error))).first()[0]
        if worst is None or worst < EXACT:
            break
        below = F.col("words") < F.col("target")
        low, high = F.when(below, F.col("lambda")).otherwise(F.col("low")), F.when(below, F.col("high")).otherwise(F.col("lambda"))
        sums = sums.withColumns({"low": low, "high": high, "next": F.col("lambda") - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gap / free))})
        within = F.col("next").between(F.col("low"), F.col("high"))
        middle = F.when((F.col("low") > float("-inf")) & (F.col("high") < float("inf")), (F.col("low") + F.col("high")) / 2).otherwise(F.col("next"))
        state = sums.withColumn("lambda", F.when(open_, F.when(within, F.col("next")).otherwise(middle)).otherwise(F.col("lambda"))).select(*columns, "low", "high")
    solved = state.select(F.col("source").alias("__source"), "lambda")
    return per.join(solved, per.source.eqNullSafe(solved["__source"]), "left").drop("__source"), mu


def carried(sizes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Copies of documents in order, each its rate rounded down or up, the remainder carried on."""
    low = np.floor(rates + 1e-9).astype(np.int64)
    high = np.where(rates - low < 1e-9, low, low + 1)
    out, carry = np.empty(len(sizes), np.int64), 0.0
    for i, (size, rate, least, most) in enumerate(zip(sizes.tolist(), rates.tolist(), low.tolist(), high.tolist(), strict=True)):
        want = rate * size + carry
        copies = least if not size else min(most, max(least, int(np.floor(want / size + 0.5))))
        out[i] = copies
        carry = want - copies * size
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, also: tuple = (), feature: Column | None = None, ridge: float = RIDGE) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), a row per document, and the long columns ``also`` of it.

    ``feature``: a number of each document, null counting as the mean; default: log(1 + size).
    """
    size = words_count(text)
    x = (F.log1p(size) if feature is None else feature).cast("double")
    sizes = stored(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), x.alias("x"), *also), "sizes")
    told = F.col("size") * F.when(F.col("x").isNotNull(), 1)
    r = sizes.agg(F.sum(told).alias("n"), _total(told * F.col("x")).alias("x"), _total(told * F.col("x") ** 2).alias("xx")).first()
    mean = r.x / r.n if r.n else 0.0
    spread = max(0.0, r.xx / r.n - mean * mean) ** 0.5 if r.n else 0.0
    z = (F.coalesce("x", F.lit(mean)) - mean) / spread if spread > 1e-9 * (1 + abs(mean)) else F.lit(0.0)
    sizes = sizes.withColumn("z", z).drop("x")
    per, mu = balance(sizes.select("source", "size", "z"), stored(targets(sizes, weights, share, most), "targets"), most, ridge)
    # Few rows, one for each source; whether they are broadcast is left to their size.
    per = stored(per, "rates")
    both = sizes.join(per, sizes.source.eqNullSafe(per.source)).drop(per.source)
    both = both.withColumn("rate", F.coalesce(F.least(F.lit(float(most)), F.exp(F.col("lambda") + mu * F.col("z"))), F.lit(0.0)))
    both = both.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", *also), F.ceil(F.col("n_docs") / BUCKET))).drop("lambda", "z")

    def round_off(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", *also], ascending=[False, *[True] * (1 + len(also))], kind="stable")
        rows["copies"] = carried(rows["size"].to_numpy(), rows["rate"].to_numpy())
        rows["taken"] = rows["copies"] * rows["size"]
        return rows[["doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken", *also]]

    return both.groupBy("source", "bucket").applyInPandas(round_off, "doc_id long, source string, size long, source_size long, target double, rate double, copies long, taken long" + "".join(f", {c} long" for c in also))
