"""Training tasks made of Python files: what is shown, and what is to be written.

``files`` has path, source and content.  Each maker returns path, source, type, user and assistant;
choices hang on seed, path and name alone, so that reruns agree.  Only the parsing is Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import code as C
from tessera.functions import parse as P
from tessera.functions.text import shuffle_key, strip, truncated, unit
from tessera.operators.order import first_n_per_group

#: Characters shown, and what stands for the rest; least words of a docstring, import lines, characters of a rest and of a test.
SHOWN, REST, DOC_WORDS, IMPORTS, SUFFIX, TEST = 6000, "\n# ... (truncated)", 8, 2, 40, 100


def _rows(df: DataFrame, kind: str, user: Column, assistant: Column) -> DataFrame:
    return df.select("path", "source", F.lit(kind).alias("type"), user.alias("user"), assistant.alias("assistant"))


def _code(c: Column) -> Column:
    return F.concat(F.lit("```python\n"), c, F.lit("\n```"))


def _shown(c: Column) -> Column:
    return truncated(c, SHOWN, REST)


def _end(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def _between(first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` of the file, from 1; none if last is before first."""
    return F.slice("lines", first, F.greatest(last - first + 1, F.lit(0)))


def _text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def functions(files: DataFrame, per_file: int, seed: str, fits: Column | None = None) -> DataFrame:
    """One row for each of ``per_file`` functions that fit, in seeded order, with its place rn from 1."""
    lines = F.split("content", "\n", -1).alias("lines")
    rows = files.select("path", "source", lines, P.import_lines(F.col("content")).alias("imports"), F.explode(C.functions("content")).alias("f"))
    rows = rows.select("path", "source", "lines", "imports", "f.*")
    if fits is not None:
        rows = rows.filter(fits)
    return first_n_per_group(rows, ["path"], per_file, [shuffle_key(seed, F.col("path"), F.col("qualname")), "start_line"])


def _prompt(prompts: tuple[str, ...]) -> Column:
    """Prompts in turn; {name} stands for the function's name."""
    return F.replace(F.element_at(F.array(*[F.lit(p) for p in prompts]), F.pmod(F.col("rn") - 1, len(prompts)) + 1), F.lit("{name}"), F.col("name"))


def _whole() -> Column:
    return _end(_text(_between(F.col("start_line"), F.col("end_line"))))


def _stub() -> Column:
    """The function's head and docstring with nothing done in its body."""
    head = _text(_between(F.col("start_line"), F.greatest(F.col("start_line"), F.coalesce(F.col("doc_end"), F.col("body_line") - 1))))
    indent = F.regexp_extract(F.element_at("lines", F.col("body_line")), r"^\s*", 0)
    return F.concat(head, F.lit("\n"), indent, F.lit("raise NotImplementedError"))


def skeletons(files: DataFrame, per_file: int = 3, seed: str = "1", prompts: tuple[str, ...] = ("Implement the body of `{name}`.", "Write the full code of `{name}`.")) -> DataFrame:
    owner = F.when(F.col("class_name").isNotNull(), F.concat(F.lit("class "), "class_name", F.lit(":\n    ...\n\n"))).otherwise("")
    context = F.concat(F.lit("# File: "), "path", F.lit("\n\n"), _text(F.col("imports")), F.lit("\n\n"), owner, _stub())
    return _rows(functions(files, per_file, seed), "skeleton_to_impl", F.concat(_prompt(prompts), F.lit("\n\n"), _code(_shown(context))), _code(_whole()))


def partial_files(files: DataFrame, per_file: int = 3, seed: str = "2", prompts: tuple[str, ...] = ("Implement `{name}` in this file.", "`{name}` lacks its body here. Write it.")) -> DataFrame:
    """Half as many as the other makers, one at least: each shows its whole file."""
    partial = _text(F.concat(_between(F.lit(1), F.col("start_line") - 1), F.array(_stub()), _between(F.col("end_line") + 1, F.size("lines"))))
    user = F.concat(F.lit("File: `"), "path", F.lit("`\n\n"), _code(_shown(partial)), F.lit("\n\n"), _prompt(prompts))
    return _rows(functions(files, max(1, per_file // 2), seed), "partial_nav", user, _code(_whole()))


def docstrings(files: DataFrame, per_file: int = 3, seed: str = "3", prompts: tuple[str, ...] = ("Write a docstring for this function.",)) -> DataFrame:
    rows = functions(files, per_file, seed, F.size(F.split(strip(F.col("docstring")), r"\s+")) >= DOC_WORDS)
    bare = _text(F.concat(_between(F.col("start_line"), F.col("body_line") - 1), _between(F.col("doc_end") + 1, F.col("end_line"))))
    return _rows(rows, "code_to_docstring", F.concat(_prompt(prompts), F.lit("\n\n"), _code(_end(bare))), F.concat(F.lit('"""\n'), strip(F.col("docstring")), F.lit('\n"""')))


def completions(files: DataFrame, per_file: int = 3, seed: str = "4", prompts: tuple[str, ...] = ("Continue this code.",)) -> DataFrame:
    """Functions of ten body lines or more, cut at 30 to 80 % of their lines."""
    n = F.col("end_line") - F.col("start_line") + 1
    first = F.greatest(F.lit(2), F.floor(n * 0.3))
    last = F.greatest(first + 1, F.floor(n * 0.8))
    cut = (F.col("start_line") + first + F.floor(unit(seed, F.col("path"), F.col("qualname"), F.col("start_line")) * (last - first))).cast("int")
    rows = functions(files, per_file, seed, F.col("body_lines") >= 10).withColumn("cut", cut)
    rest = _text(_between(F.col("cut"), F.col("end_line")))
    user = F.concat(_prompt(prompts), F.lit("\n\n"), _code(_text(_between(F.col("start_line"), F.col("cut") - 1))))
    return _rows(rows.filter(F.length(strip(rest)) >= SUFFIX), "completion", user, _code(_end(rest)))


def imports(files: DataFrame, prompt: str = "Write the imports that this code lacks.") -> DataFrame:
    rows = files.select("path", "source", F.split("content", "\n", -1).alias("lines"), P.import_lines(F.col("content")).alias("imports")).filter(F.size("imports") >= IMPORTS)
    rest = _text(F.filter("lines", lambda x: ~F.array_contains("imports", strip(x))))
    return _rows(rows, "import_resolution", F.concat(F.lit(prompt + "\n\n"), _code(_shown(rest))), _code(_text(F.col("imports"))))


def mains(files: DataFrame, prompt: str = "Write the block that runs this file as a program.") -> DataFrame:
    rows = files.select("path", "source", F.split("content", "\n", -1).alias("lines"), C.main_lines("content").alias("m")).filter("m is not null")
    user = F.concat(F.lit("File: `"), "path", F.lit("`\n\n"), _code(_shown(_text(_between(F.lit(1), F.col("m")[0] - 1)))), F.lit("\n\n" + prompt))
    return _rows(rows, "generate_main", user, _code(strip(_text(_between(F.col("m")[0], F.col("m")[1])))))


def test_files(files: DataFrame, pairs: DataFrame, prompt: str = "Write pytest tests of this module.") -> DataFrame:
    """pairs: (path, test_path)."""
    tests = files.select(F.col("path").alias("test_path"), strip(F.col("content")).alias("test")).filter(F.length("test") >= TEST)
    rows = files.join(pairs.select("path", "test_path"), "path").join(tests, "test_path")
    user = F.concat(F.lit("File: `"), "path", F.lit("`\n\n"), _code(_shown(F.col("content"))), F.lit("\n\n" + prompt))
    return _rows(rows, "test_pair", user, _code(F.col("test")))


def completion_pairs(files: DataFrame, seed: str = "5", suffix: int = 80, most: int = 2) -> DataFrame:
    """path, prefix, suffix: files of 200 characters or more, cut where a statement of a long function begins; ``most`` a file."""
    rows = files.filter(F.length("content") >= 200).select("path", F.split("content", "\n", -1).alias("lines"), F.explode(C.cuts("content")).alias("c"))
    place = F.floor(unit(seed, F.col("path"), F.col("c.start_line")) * F.size("c.lines")).cast("int")
    rows = rows.select("path", "lines", "c.start_line", F.get("c.lines", place).alias("cut"))
    rows = rows.select("path", "start_line", F.concat(_text(_between(F.lit(1), F.col("cut") - 1)), F.lit("\n")).alias("prefix"), _text(_between(F.col("cut"), F.size("lines"))).alias("suffix"))
    rows = rows.filter(F.length(strip(F.col("suffix"))) >= suffix)
    return first_n_per_group(rows, ["path"], most, [shuffle_key(seed, F.col("path"), F.col("start_line")), "start_line"]).select("path", "prefix", "suffix")


def completion_pairs_of(lists: DataFrame, key: str, codes: str, seed: str = "5", suffix: int = 80, most: int = 2) -> DataFrame:
    """path (key and place in the list), prefix, suffix, of rows with arrays of files; choices hang on the place, not on how rows are batched."""
    one = lists.select(key, F.posexplode(codes).alias("at", "content")).select(F.concat_ws("#", F.col(key).cast("string"), F.col("at").cast("string")).alias("path"), "content")
    return completion_pairs(one, seed, suffix, most)
