"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs.  All stages but the last return the columns of
``documents``, and any others that are there.  Stages work on rows, not on ids: null and repeated
doc_ids, equal rows, null and empty texts and empty tables pass through as each stage says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, simhash, toxicity
from tessera.llm.lines import LineIndex
from tessera.llm.queries import toxicity_model
from tessera.llm.shared import free, keyed, one_of_equal, quoted, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model never sees held-out labels."""
    score, predicted = free(docs, "score", "predicted")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), to=score, predicted=predicted)
    return scored.filter(F.col(predicted) == 0).drop(score, predicted)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text."""
    cleaned = LineIndex(spark).deduplicate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(quoted, docs.columns))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, that of the smallest doc_id, a null one last; documents
    without words, which all share the fingerprint zero, are one such component."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as often as the mix has copies of it; equal rows as often as of all of them."""
    rows, row = keyed(docs)
    copies, copy = free(rows, "copies", "copy")
    times = mixing.mix(rows, also=tuple(row)).groupBy(*row).agg(F.sum("copies").alias(copies)).filter(F.col(copies) > 0)
    return one_of_equal(rows, row).join(times, row).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop(*row, copies, copy)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of the ids and of the text decoded from them."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs.select("doc_id", "source", "text"), vocabulary, public_tokenizers.PATTERN, digests=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: SQL can express neither the trained toxicity model nor XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
