"""Which of many patterns stand in which texts, in one pass over the texts.

Patterns come from a table.  Up to ``BOUND`` bytes of them, which is checked, are one automaton (Aho-Corasick) that every task walks
its texts through: a text costs its length, however many patterns there are.  Beyond that patterns and texts meet by equality of grams: each pattern
is looked for by the one of its grams that fewest texts have, and the texts found are searched for the whole of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import first_n_per_group
from tessera.sources.scratch import stored

#: Bytes of patterns that are sent to all tasks, and the length of grams beyond; shorter patterns are grams themselves.
BOUND, GRAM = 16 << 20, 6


def matches(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, bound: int = BOUND) -> DataFrame:
    """(key, pattern): each pattern that a text contains, once.  Letters must agree in case.

    Null and empty patterns and null texts match nothing; equal patterns are one.  Keys must be distinct.
    """
    known = patterns.select(F.col(pattern).alias("pattern")).filter("pattern <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("pattern") + 16)).first()[0] or 0
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = _walked(rows, [r.pattern for r in known.collect()]) if size <= bound else _met(rows, known)
    return found.select(F.col("key").alias(key), "pattern")


def _walked(rows: DataFrame, words: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(w, i)
        if words:
            automaton.make_automaton()
        for batch in batches:
            at, got = [], []
            for i, t in enumerate(batch.column(1).to_pylist() if words else []):
                if t:
                    there = {n for _, n in automaton.iter(t)}
                    at += [i] * len(there)
                    got += [words[n] for n in there]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(got, pa.string())], names=["key", "pattern"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, pattern string")


def _met(rows: DataFrame, known: DataFrame) -> DataFrame:
    def grams(c, n):
        return F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))

    known = stored(known.withColumn("n", F.least(F.length("pattern"), F.lit(GRAM))), "patterns")
    parts = known.withColumn("gram", F.explode(F.array_distinct(grams(F.col("pattern"), F.col("n")))))
    lengths = sorted(r.n for r in known.select("n").distinct().collect())  # at most GRAM
    every = F.array_distinct(F.flatten(F.array(*[F.when(F.length("text") >= n, grams(F.col("text"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in lengths])))
    wanted = parts.select("gram").distinct()
    held = stored(rows.select("key", F.explode(every).alias("gram")).join(wanted, "gram", "left_semi"), "grams")
    rare = held.groupBy("gram").agg(F.count("*").alias("texts"))
    # A pattern one of whose grams is nowhere is nowhere.
    counted = parts.join(rare, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.coalesce("texts", F.lit(0))).alias("gram"), F.min(F.coalesce("texts", F.lit(0))).alias("texts"))
    near = held.join(counted.filter("texts > 0"), "gram").select("key", "pattern")
    return near.join(rows, "key").filter(F.contains("text", "pattern")).select("key", "pattern")


def relevant(skills: DataFrame, queries: DataFrame, k: int = 6, hit: int = 5, most: int = 5, least: int = 2) -> DataFrame:
    """(query_id, skill, score, rank): the k skills (skill, pattern, insight) that fit each query (query_id, query) best.

    ``hit`` for a pattern that stands in the query, and one for each different word of the insight, of three letters or more, that does, up to ``most``;
    case doesn't matter, an empty pattern stands nowhere.  A skill that shares nothing with a query never meets it; ``least`` is 1 or more.
    """
    words = skills.select("skill", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("insight"), F.lit("[a-zA-Z0-9_]{3,}"), F.lit(0)))).alias("pattern"), F.lit(False).alias("whole"))
    wanted = words.unionByName(skills.select("skill", F.lower("pattern").alias("pattern"), F.lit(True).alias("whole")))
    found = matches(queries.withColumn("__low", F.lower("query")), "query_id", "__low", wanted, "pattern")
    met = found.join(wanted, "pattern").groupBy("query_id", "skill").agg(F.max(F.when(F.col("whole"), hit).otherwise(0)).alias("hit"), F.count_if(~F.col("whole")).alias("words"))
    scored = met.select("query_id", "skill", (F.col("hit") + F.least(F.lit(most), "words")).cast("int").alias("score")).filter(F.col("score") >= least)
    return first_n_per_group(scored, ["query_id"], k, [F.desc("score"), "skill"], "rank")


def first_of(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, value: str, place: str) -> DataFrame:
    """``texts`` with ``value`` of the pattern that stands first in the list (by ``place``) among those that the text contains; null without one."""
    found = matches(texts, key, text, patterns, pattern).join(patterns.select(F.col(pattern).alias("pattern"), F.col(value).alias("__value"), F.col(place).alias("__place")), "pattern")
    first = found.groupBy(key).agg(F.min_by("__value", "__place").alias(value))
    return texts.join(first, key, "left")
