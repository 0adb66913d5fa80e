"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tessera.sources.scratch import scratch
from tessera.sources.versions import Conflict, Versions  # noqa: F401

#: The ASCII white space that separates words: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    The written table cuts the lineage and survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete what operators have written below the shared folder; only once no result that reads it is needed."""
    fs, top = Versions(spark, scratch(spark, "x").rpartition("/")[0], "").place()
    fs.delete(top, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def placed(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns named by their places (c0, c1, ...), so that what a step adds clashes with none."""
    return [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]


def ddl(df: DataFrame, columns: list[str]) -> list[str]:
    """Names and types of the columns, as parts of a schema."""
    return [f"{quoted(c)} {df.schema[c].dataType.simpleString()}" for c in columns]


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, MapType):
        return True
    parts = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return any(map(_holds_map, parts))


def keyed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with 128 bits of hash of all its columns, equal for equal rows only, and the names of these two columns.

    Maps are hashed as JSON, those at the top with their entries in order.
    """
    columns = []
    for f in df.schema:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, MapType):
            c = F.map_entries(c) if _holds_map(f.dataType.valueType) else F.array_sort(F.map_entries(c))
        columns += [F.to_json(c) if _holds_map(f.dataType) else c, F.isnull(F.col(quoted(f.name)))]
    row = free(df, "__k1", "__k2")
    return df.withColumns({row[0]: F.xxhash64(*columns), row[1]: F.xxhash64(F.lit("second"), *columns)}), row


def one_of_equal(df: DataFrame, row: list[str]) -> DataFrame:
    """``df``, which ``keyed`` made, with one of equal rows; each task sends on one of a kind."""
    whole = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    one = df.groupBy(*[F.col(r).alias(f"k{i}") for i, r in enumerate(row)]).agg(F.any_value(whole).alias("one"))
    return one.select(*[F.col(f"one.c{i}").alias(c) for i, c in enumerate(df.columns)])


def words_count(text: str = "text"):
    """Number of runs of non-white characters; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
