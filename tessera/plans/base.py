"""What the modules of queries share: the registers and their decorators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def simple(name: str, table: str, columns: dict[str, tuple[object, str]], where: tuple[object, str] | None = None, key: str = "doc_id") -> None:
    """A projection of one table: output name to (maker of the column, SQL)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        if where:
            df = df.filter(where[0]())
        return df.select(key, *[c().alias(k) for k, (c, _) in columns.items()])

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, " + ", ".join(f"{q} AS {k}" for k, (_, q) in columns.items()) + f" FROM {table}" + (f" WHERE {where[1]}" if where else "")


U01 = "(('0x' || substr(sha1({}), 1, 8))::BIGINT / 4294967296.0)"
