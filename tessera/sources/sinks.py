"""Sinks: JSON lines by type, tables with a header, reports, manifests, appends of what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import shuffle_key
from tessera.operators.order import first_per_key
from tessera.operators.percentiles import percentiles
from tessera.sources.scratch import exists, stored

#: The columns of a table of buckets.
BUCKETS = ("bucket", "raw_count", "dedup_count", "dedup_ratio", "parse_rate", *[f"{u}_{m}" for u in ("chars", "tokens") for m in ("mean", "p50", "p90", "p95", "max")])


def write_json(df: DataFrame, path: str) -> int:
    """JSON lines, nothing escaped that needn't be; returns how many there are."""
    df.write.json(path)
    return df.sparkSession.read.text(path).count()


def write_files(df: DataFrame, root: str) -> int:
    """A file below a root for each (path, content), on a file system that pyarrow knows; returns how many there are.

    Each task writes its files where they stay, one stream each and no renames; a task that runs twice writes the same again.
    """

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        made = set()
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{base}/{path}"
                if (folder := at.rsplit("/", 1)[0]) not in made:
                    place.create_dir(folder)
                    made.add(folder)
                with place.open_output_stream(at) as out:
                    out.write(content)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = df.select("path", F.col("content").cast("binary"))
    return rows.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_by_type(df: DataFrame, path: str, column: str = "type") -> None:
    df.write.partitionBy(column).json(path)


def write_routed(df: DataFrame, path: str, routes: dict[str, str], other: str = "all", column: str = "type", seed: str = "42", keys: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines in a folder for each route, ``other`` for types without one, and all of them in
    ``merged`` in the order of a seeded hash; returns (file, n) with the count of each."""
    pairs = [F.lit(x) for kv in routes.items() for x in kv]
    route = F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(other)) if pairs else F.lit(other)
    routed = df.withColumn("file", route)
    routed.write.partitionBy("file").json(f"{path}/by_file")
    named = [F.col(k) for k in keys or df.columns]
    df.orderBy(shuffle_key(seed, *named), *named).write.json(f"{path}/merged")
    counts = routed.groupBy("file").agg(F.count("*").alias("n"))
    return counts.unionByName(df.agg(F.count("*").alias("n")).select(F.lit("merged").alias("file"), "n"))


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values in the order of their names; null differs from any text."""
    parts = [F.concat(F.lit(c), F.when(F.col(f"`{c}`").isNull(), "\x01").otherwise(F.concat(F.lit("\x02"), F.col(f"`{c}`").cast("string")))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def append_new(df: DataFrame, target: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """Append the rows whose keys the target lacks; of equal new keys the first in ``order`` (default: of all columns)."""
    first = first_per_key(df, [F.col(k) for k in keys], order or df.columns)
    first.join(target.select(*keys).distinct(), keys, "left_anti").select(*df.columns).write.mode("append").parquet(path)


def append_hashed(df: DataFrame, path: str) -> int:
    """Append the rows that aren't in the JSON lines at a path, by hash of all their columns; returns how many."""
    spark, columns = df.sparkSession, df.columns
    new = df.withColumn("__hash", row_hash(columns)).dropDuplicates(["__hash"])  # equal hash, equal row
    before = 0
    if exists(spark, path):
        held = spark.read.schema(df.schema).json(path)
        before = held.count()
        new = new.join(held.select(row_hash(columns).alias("__hash")).distinct(), "__hash", "left_anti")
    new.select(*columns).write.mode("append").json(path)
    return spark.read.text(path).count() - before


def csv_lines(df: DataFrame, header: list[str]) -> DataFrame:
    """``df`` with exactly these columns, as text; what is missing or null is empty."""
    kinds = dict(df.dtypes)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in kinds else F.lit("").alias(c) for c in header])


def write_csv(df: DataFrame, path: str, header: list[str]) -> None:
    """Files with a header, as many as the rows have partitions."""
    csv_lines(df, header).write.option("header", "true").option("emptyValue", "").csv(path)


def united(parts: list[DataFrame], first: str) -> DataFrame:
    """Rows of reports with different columns; all columns, ``first`` ahead of the others in order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(first, *sorted(c for c in out.columns if c != first))


def predictions(df: DataFrame, instance: str, patch: str) -> DataFrame:
    return df.select(F.col(instance).alias("instance_id"), F.coalesce(F.col(patch), F.lit("")).alias("model_patch"))


def write_status(df: DataFrame, path: str, state: str = "status") -> None:
    """A row of JSON with total, success and failed at ``path``/summary, and the tasks in order, a line each in as many files as they take, at ``path``/tasks."""
    good = F.count_if(F.col(state) == "success")
    df.agg(F.count("*").alias("total"), good.alias("success"), (F.count("*") - good).alias("failed")).write.json(f"{path}/summary")
    df.orderBy(*df.columns).write.json(f"{path}/tasks")


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One line of a report table per row; doubles with four digits, missing as N/A."""
    kinds = dict(df.dtypes)
    cells = [F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.4f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def manifest(df: DataFrame, by: list[str], config: dict[str, str] | None = None, paths: dict[str, str] | None = None) -> DataFrame:
    """One row: total and, for each column, a map of its values' counts; with ``config`` and ``paths``, these as maps."""
    counts = [df.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(f"by_{c}")) for c in by]
    out = df.agg(F.count("*").alias("total"))
    for c in counts:
        out = out.crossJoin(F.broadcast(c))  # one row each
    for name, values in (("config", config), ("paths", paths)):
        if values is not None:
            out = out.withColumn(name, F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]))
    return out


def buckets(df: DataFrame, bucket: str, text: str, parses: Column) -> DataFrame:
    """A row of ``BUCKETS`` for each bucket, of its distinct texts; a token is four characters."""
    raw = df.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("raw_count"))
    # Equal texts meet by digest, so that no long text is a shuffle key.
    one = stored(df.select(F.col(bucket).alias("bucket"), F.sha2(text, 256).alias("h"), F.length(text).alias("chars"), F.floor(F.length(text) / 4).alias("tokens"), parses.cast("double").alias("parses")).groupBy("bucket", "h").agg(*[F.max(c).alias(c) for c in ("chars", "tokens", "parses")]), "distinct")
    means = [m for u in ("chars", "tokens") for m in (F.round(F.avg(u), 4).alias(f"{u}_mean"), F.max(u).cast("long").alias(f"{u}_max"))]
    told = one.groupBy("bucket").agg(F.count("*").alias("dedup_count"), F.round(F.avg("parses"), 6).alias("parse_rate"), *means)
    for u in ("chars", "tokens"):
        marks = percentiles(one, ["bucket"], F.col(u), {f"{u}_p{int(q * 100)}": q for q in (0.5, 0.9, 0.95)})
        told = told.join(marks.select("bucket", *[F.round(f"{u}_p{q}", 4).alias(f"{u}_p{q}") for q in (50, 90, 95)]), "bucket")
    return told.join(raw, "bucket").withColumn("dedup_ratio", F.round(1 - F.col("dedup_count") / F.col("raw_count"), 6)).select(*BUCKETS)


def analyse(df: DataFrame, bucket: str, text: str, parses: Column, path: str, config: dict[str, str], checks: list[str]) -> DataFrame:
    """The table of buckets, sorted by name, as CSV at ``path``/buckets and in a JSON report with configuration and checks at ``path``/report."""
    rows = buckets(df, bucket, text, parses)
    write_csv(rows.orderBy("bucket"), f"{path}/buckets", list(BUCKETS))
    report = rows.agg(F.sort_array(F.collect_list(F.struct(*BUCKETS))).alias("summaries"))
    report = report.select(F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv]).alias("config"), "summaries", F.array(*map(F.lit, checks)).alias("checks"))
    report.coalesce(1).write.json(f"{path}/report")
    return rows


def speed_row(df: DataFrame, tokens: str, seconds: str, memory: str) -> DataFrame:
    """``df`` with tokens_per_sec and peak_memory_gb; no time, no speed."""
    speed = F.when(F.col(seconds) > 0, F.col(tokens) / F.col(seconds)).otherwise(0.0)
    return df.withColumn("tokens_per_sec", F.round(speed, 3)).withColumn("peak_memory_gb", F.round(F.col(memory) / float(1 << 30), 3))


def drop_unusable(parts: dict[str, DataFrame | None], text: str = "text") -> dict[str, DataFrame]:
    """The buckets that are there, have a text column and a row."""
    return {n: d for n, d in parts.items() if d is not None and text in d.columns and not d.isEmpty()}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table as text, empty where a cell is."""
    return spark.read.option("header", "true").csv(path).na.fill("")
