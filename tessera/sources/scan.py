"""Sources: wiki dumps, source trees, JSON lines, results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import LANGUAGES, minified, strip
from tessera.sources.scratch import exists, located, scratch, stored

#: What a source-tree scan takes and leaves out.
EXTENSIONS = tuple(LANGUAGES)
IGNORED = (".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build", "target")
DUMP = "title STRING, ns STRING, revision ARRAY<STRUCT<timestamp: STRING, text: STRUCT<_VALUE: STRING, `_xml:space`: STRING>>>"


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, ts, wikitext) of a dump, plain or compressed; the last revision counts, a bad ns is -1.

    A record ends with its page, so a large dump is read in splits, also one of many bz2 streams; each page is parsed by itself.  The end of
    a page can't stand in a text, where it is escaped.
    """
    ends = spark.read.option("lineSep", "</page>").text(path)
    pages = ends.select(F.regexp_extract("value", r"(?s)(<page[\s>].*)", 1).alias("page")).filter("page <> ''")
    options = {"ignoreSurroundingSpaces": "false", "rowTag": "page"}
    raw = pages.select(F.from_xml(F.concat("page", F.lit("</page>")), DUMP, options).alias("p")).select("p.*")
    last = F.element_at("revision", -1)
    return raw.select(F.trim("title").alias("title"), F.coalesce(F.trim("ns").try_cast("int"), F.lit(-1)).alias("ns"), F.trim(last["timestamp"]).alias("ts"), F.coalesce(last["text"]["_VALUE"], F.lit("")).alias("wikitext"))


@dataclass(frozen=True)
class Project:
    """A dump to index; ``namespaces`` None: all."""

    project: str
    dump: str
    index: str
    base_url: str
    namespaces: tuple[int, ...] | None
    mode: str


def project_of(item: dict, base_urls: dict[str, str]) -> Project:
    """A project of a configuration: namespaces are {0} unless given, an empty list being all; the mode goes by the name's end."""
    name = item["project"]
    url = item.get("base_url") or base_urls.get(name)
    if not url:
        raise ValueError(f"project {name} has no base_url")
    spaces = item.get("namespaces")
    chosen = (0,) if spaces is None else tuple(sorted({int(x) for x in spaces})) or None
    return Project(name, item["dump_path"], item["db_path"], url, chosen, item.get("mode") or ("wiki" if name.endswith("wiki") else "wikisource"))


def projects_of(names: list[str], dumps: str, indexes: str, base_urls: dict[str, str], main_only: bool = True) -> list[Project]:
    """Projects by name alone, their dumps where a mirror puts them."""
    spaces = None if main_only else []
    return [project_of({"project": n, "dump_path": f"{dumps}/{n}/{n}-latest-pages-articles.xml.bz2", "db_path": f"{indexes}/{n}_fts", "namespaces": spaces}, base_urls) for n in names]


def places_of(name: Column, dumps: str, indexes: str) -> Column:
    """Dump and index of projects by name alone, as ``projects_of`` has them."""
    dump = F.concat(F.lit(f"{dumps}/"), name, F.lit("/"), name, F.lit("-latest-pages-articles.xml.bz2"))
    return F.struct(dump.alias("dump"), F.concat(F.lit(f"{indexes}/"), name, F.lit("_fts")).alias("index"))


def configured(spark: SparkSession, path: str) -> DataFrame:
    """The projects of JSON files, as they are given: (project, dump_path, db_path, base_url, namespaces, mode)."""
    item = "struct<project: string, dump_path: string, db_path: string, base_url: string, namespaces: array<int>, mode: string>"
    rows = spark.read.schema(f"projects array<{item}>").json(path, multiLine=True)
    return rows.select(F.inline("projects"))


#: Folders that a task lists; files and bytes that a task reads; bytes that it holds at a time.
FOLDERS, FILES, BYTES, HELD = 128, 4000, 1 << 25, 1 << 22


def _walked(spark: SparkSession, place, top: str) -> DataFrame:
    """(path, length) of the files below a folder, paths from there on; ignored folders and links to folders aren't entered.

    Tasks list the folders, a level of the tree at a time, and write what they find: no name passes through the driver.
    """

    def listed(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        local = isinstance(place, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                paths, lengths = [], []
                for x in place.get_file_info(fs.FileSelector(f"{top}{folder}")):
                    if x.type == fs.FileType.File or x.type == fs.FileType.Directory and not (local and os.path.islink(x.path)):
                        paths.append(f"{folder}/{x.base_name}")
                        lengths.append(x.size)  # a folder has none
                yield pa.record_batch([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["path", "length"])

    schema, at, depth = "path string, length long", scratch(spark, "listed"), 0
    level = spark.createDataFrame([("",)], "path string")
    while True:
        level.mapInArrow(listed, schema).write.parquet(f"{at}/{depth}")
        level = spark.read.schema(schema).parquet(f"{at}/{depth}").filter(F.col("length").isNull() & ~F.substring_index("path", "/", -1).isin(*IGNORED)).select("path")
        depth += 1
        if not (n := level.count()):
            return spark.read.schema(schema).parquet(*[f"{at}/{i}" for i in range(depth)]).filter("length is not null")
        level = level.repartition(-(-n // FOLDERS), "path")


def _texts(files: DataFrame, known, root: str, lenient: bool, tidy: bool) -> DataFrame:
    """(path, content) of files, as text: of those below a folder that pyarrow ``known``, which are opened here, or of (path, content) as bytes."""

    def put(batches):
        import pyarrow as pa

        def batch_of(rows):
            return pa.record_batch([pa.array(c, pa.string()) for c in ([r[0] for r in rows], [r[1] for r in rows])], ["path", "content"])

        def opened(path):
            with place.open_input_stream(f"{top}{path}", compression=None) as f:
                return f.read()

        place, top = known or (None, "")
        for batch in batches:
            paths, rows, held = batch.column(0).to_pylist(), [], 0
            for path, content in zip(paths, map(opened, paths) if known else (x.as_py() for x in batch.column(1)), strict=True):
                try:
                    text = content.decode("utf-8", "ignore" if lenient else "strict")
                except UnicodeDecodeError:
                    continue
                rows.append((f"{root}{path}" if known else path, text.replace("\r\n", "\n").replace("\r", "\n") if tidy else text))
                held += len(content)
                if held >= HELD:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    return files.mapInArrow(put, "path string, content string")


def source_tree(spark: SparkSession, root: str, least: int = 100, most: int = 512 * 1024, per_root: int | None = None, lenient: bool = False, tidy: bool = False) -> DataFrame:
    """(path, language, content) of text files below a root.

    Names and sizes are settled by the listing, before a file is read.  ``per_root``: the first so many paths;
    ``lenient``: bytes that are no UTF-8 are left out, else their file is; ``tidy``: line ends made
    one, minified files left out.  Where pyarrow knows the file system, tasks list the folders and read many files each;
    on others Spark's reader does it, whose driver holds the names, and which passes over names that begin with a dot or a low line.
    """
    whole, known = located(spark, root)
    ext = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    fits = ext.isin(*EXTENSIONS) & F.col("length").between(least, most)
    if known:
        files = _walked(spark, *known).filter(fits)
        n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        files = files.select("path").repartition(max(1, -(-n // FILES), -(-size // BYTES)), "path")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(fits)
        below = F.split(F.substr("path", F.lit(len(whole) + 1)), "/")
        files = files.filter(~F.arrays_overlap(F.slice(below, 1, F.size(below) - 1), F.array(*map(F.lit, IGNORED)))).select("path", "content")
    rows = _texts(files, known, whole, lenient, tidy).select("path", ext.alias("language"), "content").filter(F.length(strip(F.col("content"))) > 0)
    if tidy:
        rows = rows.filter(~minified(F.col("content"), F.col("language")))
    if per_root is not None:
        rows = rows.orderBy("path").limit(per_root)
    return rows


def item_kind(item: Column) -> Column:
    """What an input is: blob, tree, raw (any other address) or path."""
    kind = F.regexp_extract(item, r"^https?://(?:www\.)?github\.com/[^/]+/[^/]+/(blob|tree)/", 1)
    return F.when(kind != "", kind).when(item.rlike("^https?://"), "raw").otherwise("path")


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """(item, remote) of a list, a line each; blank lines and those with # are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("item")).filter(~F.col("item").startswith("#") & (F.col("item") != ""))
    return lines.select("item", (F.col("item").startswith("https://") | F.col("item").startswith("git@")).alias("remote"))


def json_lines(spark: SparkSession, path: str, schema: str, objects: bool = False) -> DataFrame:
    """Rows of JSON lines; blank and malformed ones are left out, with ``objects`` also those that are no objects."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    if objects:
        lines = lines.filter(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"))
    return lines.select(F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*").filter("_bad is null").drop("_bad")


def numbered_lines(spark: SparkSession, path: str | list[str], where: Column | None = None) -> DataFrame:
    """(file, line, text) of text files (also compressed ones that can be split), lines numbered from 1; only those for which ``where``, a condition on ``text``, holds.

    Files are read in splits, twice: first the lines of each split are counted, then a line's number is what the file's splits before hold and its place in its own.
    Rows of a split are numbered as they are read, so both passes must plan the same splits: the session's settings mustn't change between them.
    """
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start")]
    lines = spark.read.text(path).select(F.col("value").alias("text"), *meta).withColumn("id", F.monotonically_increasing_id())
    splits = lines.groupBy("file_path", "file_block_start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    base = stored(splits.select("file_path", "file_block_start", "first", F.coalesce(before, F.lit(0)).alias("base")), "splits")
    kept = lines if where is None else lines.filter(where)
    return kept.join(base, ["file_path", "file_block_start"]).select(F.col("file_path").alias("file"), (F.col("base") + F.col("id") - F.col("first") + 1).alias("line"), "text")


def json_line_faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of the malformed lines, numbered from 1."""
    return numbered_lines(spark, path, (F.trim("text") != "") & F.try_parse_json("text").isNull())


def _names(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().toString() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if not s.getPath().getName().startswith(("_", ".")))


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` rows of a folder of Parquet or JSON lines, in the order of the files' names and within a file.

    Parquet: the footers tell how many rows a file has, and of the files that are needed only the rows up to the last one pass.
    JSON lines: files are counted, from the first on and twice as many each time, until they hold enough.
    """
    names = _names(spark, path)
    if not any(x.endswith(".parquet") for x in names):
        few = 1
        while few < len(names) and spark.read.text(names[:few]).filter("trim(value) <> ''").count() < n:
            few *= 2
        schema = spark.read.json(names[:few]).schema
        lines = numbered_lines(spark, names[:few], F.trim("text") != "")
        order = Window.orderBy("file", "line")  # of the lines that are needed
        first = lines.orderBy("file", "line").limit(n).withColumn("at", F.row_number().over(order))
        return first.select(F.from_json("text", schema).alias("r")).select("r.*")
    rows = spark.read.parquet(path)
    sizes = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    needed = {r.file: n - r.before for r in sizes.withColumn("before", before).filter(F.col("before") < n).collect()}
    if not needed:
        return rows.limit(0)
    at, last = F.col("_metadata.row_index"), max(needed, key=lambda f: -needed[f])
    kept = spark.read.schema(rows.schema).parquet(*needed)
    return kept.filter((F.col("_metadata.file_path") != last) | (at < needed[last]))


def dataset(spark: SparkSession, root: str, name: str, splits: tuple[str, ...] = ("train",), first: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Parquet or JSON lines of ``repo[:subset]`` below a root, a folder for each split; at most ``first`` rows of each."""
    repo, _, subset = name.partition(":")
    out = None
    for split in splits:
        path = "/".join([root, repo, *([subset] if subset else []), split])
        if not exists(spark, path):
            raise FileNotFoundError(path)
        # A folder holds one format; the first file tells.
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
        rows = spark.read.parquet(path) if any(n.endswith(".parquet") for n in names) else spark.read.json(path)
        if first is not None:
            rows = rows.orderBy(*order).limit(first) if order else first_rows(spark, path, first)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def first_that_loads(spark: SparkSession, root: str, names: list[str], **options) -> tuple[str, DataFrame] | None:
    """The first of several datasets that is there, and its name."""
    for name in names:
        try:
            return name, dataset(spark, root, name, **options)
        except FileNotFoundError:
            continue
    return None


def kept_or_built(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at a path; ``build()`` is written there if there is none that was finished."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def results(spark: SparkSession, root: str, schema: str, name: str = "*.json") -> DataFrame:
    """(file, and the schema's columns) of all JSON files of that name below a root; each is one value."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root, multiLine=True)
    return rows.withColumn("file", F.input_file_name())


def summaries(spark: SparkSession, folders: list[str], schema: str) -> tuple[DataFrame, list[str]]:
    """summary.json of each folder, and the folders without one."""
    there = [f for f in folders if exists(spark, f"{f}/summary.json")]
    rows = spark.read.schema(schema).json([f"{f}/summary.json" for f in there], multiLine=True) if there else spark.createDataFrame([], schema)
    return rows, [f for f in folders if f not in there]


def skills(spark: SparkSession, folder: str) -> DataFrame:
    """(category, pattern, insight, evidence, count, created_at) of a folder's JSON lines; rows of the old shape (tag, kind, text) are turned into the new one."""
    names = "category pattern insight evidence created_at tag kind text".split()
    rows = json_lines(spark, f"{folder}/*.jsonl", ", ".join(f"{n} string" for n in names) + ", count long", objects=True)
    old = F.col("insight").isNull()
    text = lambda name, other="": F.coalesce(F.col(name), F.lit(other))
    migrated = F.concat(F.lit("Legacy "), text("kind", "unknown"), F.lit(": "), F.substring(text("text"), 1, 100), F.lit("..."))
    return rows.select(
        F.when(old, "Legacy").otherwise(text("category", "Uncategorized")).alias("category"), F.when(old, text("pattern", "general")).otherwise(text("pattern")).alias("pattern"),
        F.when(old, migrated).otherwise(F.col("insight")).alias("insight"), F.when(old, F.substring(text("evidence"), 1, 200)).otherwise(text("evidence")).alias("evidence"),
        F.when(old, 1).otherwise(F.coalesce("count", F.lit(1))).cast("long").alias("count"), text("created_at").alias("created_at"),
    )


def schema_report(spark: SparkSession, tables: dict[str, DataFrame], expected: tuple[str, ...] = ()) -> DataFrame:
    """(table, position, column, type, n_rows, n_filled) of each column, each table read once; an expected table that isn't there has one row, of column ``missing``."""
    kinds = "table string, position long, column string, type string, n_rows long, n_filled long"
    out = spark.createDataFrame([(t, 0, "missing", "", None, None) for t in expected if t not in tables], kinds)
    for t, df in sorted(tables.items()):
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
        told = [F.struct(F.lit(t).alias("table"), F.lit(i).cast("long").alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"), F.col(f"n{i}").alias("n_filled")) for i, f in enumerate(df.schema)]
        out = out.unionAll(counts.select(F.inline(F.array(*told))))
    return out


def report_lines(df: DataFrame, most: int = 400) -> DataFrame:
    """A line for each row of (table, column, type), types cut at ``most`` characters."""
    kind = F.when(F.length("type") > most, F.concat(F.substring("type", 1, most), F.lit("..."))).otherwise(F.col("type"))
    return df.select(F.concat("table", F.lit("."), "column", F.lit(": "), kind).alias("line"))


def numbered_in_root(df: DataFrame, root: str, path: str, n: int) -> DataFrame:
    """The first ``n`` rows of each root, by path."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(root).orderBy(path))).filter(F.col("__rn") <= n).drop("__rn")


def stored_indexes(spark: SparkSession, root: str, prefer: str | None = None) -> list[str]:
    """Names of the search indexes below a root: the preferred one, then those with fts in their name, then the others."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in (fs.listStatus(at) if fs.exists(at) else [])]
    return sorted((n for n in names if exists(spark, f"{root}/{n}/manifests")), key=lambda n: (n != prefer, "fts" not in n, n))
