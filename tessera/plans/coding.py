"""Queries of the functions on Python source, diffs and replies, and of the tasks made of files.

The tables hold no source code, so each document becomes a file whose imports, docstring, functions and faults
hang on its columns; SQL builds the same file from arithmetic and knows its lines without parsing it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import code as C
from tessera.functions import formats as X
from tessera.functions import repair as R
from tessera.operators import tasks
from tessera.plans.base import U01, query, read
from tessera.plans.cleaning import _quoted
from tessera.plans.parsing import WHITE, cat, pick, sql_pick

L = F.lit
_COLUMNS = "(doc_id % 2 = 0)::INT AS e, CAST(doc_id % 12 AS BIGINT) AS d, CAST(n_chars % 15 + 1 AS BIGINT) AS k, CAST(doc_id % 7 + 1 AS BIGINT) AS j, doc_id % 3 = 0 AS main, doc_id % 11 = 0 AS broken"
_LINES = r"""['import m_' || lang] || (CASE WHEN e = 1 THEN ['from pkg import x' || doc_id % 5] ELSE [] END) || ['', 'def f_' || doc_id || '(a, b=1):']
 || (CASE WHEN d > 0 THEN ['    \"\"\"' || words || '\"\"\"'] ELSE [] END) || list_transform(range(1, k + 1), lambda i: '    v' || i || ' = a + ' || i) || ['    return a', '', 'class C_' || lang || ':', '    def m(self, q):']
 || list_transform(range(1, j + 1), lambda i: '        w' || i || ' = q * ' || i) || ['        return self'] || (CASE WHEN main THEN ['', 'if __name__ == \"__main__\":', '    f_' || doc_id || '(1)'] ELSE [] END)
 || (CASE WHEN broken THEN ['def broken(:'] ELSE [] END)""".replace('\\"', '"')
#: files: path, source, content, its lines, and where f, its docstring and C.m stand.  functions: those of five body lines or more.
FILES = f"""WITH f0 AS (SELECT doc_id, source, lang, text, {_COLUMNS} FROM documents),
f1 AS (SELECT *, array_to_string(list_transform(range(1, d + 1), lambda i: source || i), ' ') AS words, 3 + e AS head, (d > 0)::INT AS doc FROM f0),
files AS (SELECT *, 'm' || doc_id || '.py' AS path, {_LINES} AS lines, array_to_string({_LINES}, chr(10)) AS content, head + doc + k + 1 AS f_end, head + doc + k + 4 AS m_at, head + doc + k + j + 5 AS m_end FROM f1),
functions AS (SELECT * FROM (SELECT path, source, lines, content, doc, words, 'f_' || doc_id AS name, 'f_' || doc_id AS qualname, NULL AS class_name, head AS start_line, f_end AS end_line, doc + k + 1 AS body_lines, CASE WHEN d > 0 THEN words END AS docstring FROM files WHERE NOT broken
  UNION ALL SELECT path, source, lines, content, 0, '', 'm', 'C_' || lang || '.m', 'C_' || lang, m_at, m_end, j + 1, NULL FROM files WHERE NOT broken) WHERE body_lines >= 5)
"""


def files(spark, sf_dir):
    """(doc_id, path, source, lang, content)."""
    i, text = F.col("doc_id"), lambda c: c.cast("string")
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(L(1), n.cast("int")), f)).otherwise(F.array().cast("array<string>"))
    some = lambda fits, *lines: F.when(fits, F.array(*lines)).otherwise(F.array().cast("array<string>"))
    words = F.array_join(upto(i % 12, lambda n: cat(F.col("source"), text(n))), " ")
    lines = F.concat(
        F.array(cat("import m_", F.col("lang"))), some(i % 2 == 0, cat("from pkg import x", text(i % 5))), F.array(L(""), cat("def f_", text(i), "(a, b=1):")),
        some(i % 12 > 0, cat('    """', words, '"""')), upto(F.col("n_chars") % 15 + 1, lambda n: cat("    v", text(n), " = a + ", text(n))), F.array(L("    return a"), L(""), cat("class C_", F.col("lang"), ":"), L("    def m(self, q):")),
        upto(i % 7 + 1, lambda n: cat("        w", text(n), " = q * ", text(n))), F.array(L("        return self")),
        some(i % 3 == 0, L(""), L('if __name__ == "__main__":'), cat("    f_", text(i), "(1)")), some(i % 11 == 0, L("def broken(:")),
    )
    return read(spark, sf_dir, "documents").select("doc_id", cat("m", text(i), ".py").alias("path"), "source", "lang", "text", F.array_join(lines, "\n").alias("content"))


# --- source ------------------------------------------------------------------------------------
@query("SELECT doc_id, doc_id % 11 <> 0 AS parses FROM documents")
def f12_parses(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C.parses("content").alias("parses"))


_FENCED = lambda: pick(4, cat("Here:\n```python\n", F.col("content"), "\n```\nand ```x```"), F.col("source"), F.col("content"), F.repeat(cat(F.col("source"), " "), 10))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN length(source) >= 32 WHEN 3 THEN length(source) >= 3 ELSE doc_id % 11 <> 0 END AS valid FROM documents")
def f10_valid_code_text(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C.valid_code_text(_FENCED()).alias("valid"))


#: Statements, and the violation that each is.
_STATEMENTS = (("import subprocess", "import subprocess"), ("import os, json", None), ("from socket.x import y", "import socket.x"), ("eval('1')", "call eval"), ("a.chmod(0)", "attribute chmod"), ("a.eval(1)", None), ("import pty as p, shlex", "import pty,import shlex"), ("def broken(:", "syntax error"))


@query(f"""SELECT doc_id, CASE WHEN (doc_id >> 7) % 2 = 1 THEN 'syntax error' ELSE array_to_string(list_sort(string_split(concat_ws(',', {', '.join(f"CASE WHEN (doc_id >> {i}) % 2 = 1 THEN '{v}' END" for i, (_, v) in enumerate(_STATEMENTS) if v and i < 7)}), ',')), ',') END AS violations FROM documents""")
def f24_violations(spark, sf_dir):
    source = F.concat_ws("\n", *[F.when(F.shiftright("doc_id", i) % 2 == 1, s) for i, (s, _) in enumerate(_STATEMENTS)])
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(C.violations(source), ",").alias("violations"))


@query(FILES + "SELECT path, name, qualname, class_name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, CAST(body_lines AS BIGINT) AS body_lines, docstring FROM functions")
def u01_functions(spark, sf_dir):
    f = files(spark, sf_dir).select("path", F.explode(C.functions("content")).alias("f")).select("path", "f.*")
    return f.select("path", "name", "qualname", "class_name", *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "body_lines")], "docstring")


@query(FILES + "SELECT path, qualname, coalesce(len(string_split(docstring, ' ')), 0) >= 8 AS documented, body_lines >= 10 AS long, array_length(list_filter(lines, lambda x: starts_with(x, 'import ') OR starts_with(x, 'from '))) >= 2 AS imports FROM functions")
def f25_fit_functions(spark, sf_dir):
    f = tasks.functions(files(spark, sf_dir), 10, "f25")
    words = F.size(F.split(F.trim("docstring"), r"\s+"))
    return f.select("path", "qualname", F.coalesce(words >= tasks.DOC_WORDS, L(False)).alias("documented"), (F.col("body_lines") >= 10).alias("long"), (F.size("imports") >= tasks.IMPORTS).alias("imports"))


_OUTLINE = "CASE WHEN broken THEN '# cannot be outlined: invalid syntax (<unknown>, line ' || len(lines) || ')' ELSE 'def f_' || doc_id || '(a, b): ...' || chr(10) || 'class C_' || lang || ':' || chr(10) || '    def m(self, q): ...' END"


@query(FILES + f"SELECT path, {_OUTLINE} AS outline FROM files")
def u19_outline(spark, sf_dir):
    return files(spark, sf_dir).select("path", C.outline("content").alias("outline"))


_MARKS = "list_sort(list_distinct((CASE WHEN broken THEN [len(lines)] ELSE [] END) || (CASE WHEN doc_id % 4 = 1 THEN [CAST(2 AS BIGINT)] ELSE [] END)))"
_SHOWN = "list_filter(range(1, len(lines) + 1), lambda i: len(list_filter(marks, lambda m: abs(i - m) <= 5)) > 0)"
_SNIPPET = "array_to_string(list_transform(shown, lambda i, n: (CASE WHEN n > 1 AND shown[n - 1] < i - 1 THEN '...' || chr(10) ELSE '' END) || (CASE WHEN list_contains(marks, i) THEN '>>' ELSE '  ' END) || ' ' || lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || lines[i]), chr(10))"


@query(FILES + f"""SELECT path, CASE WHEN len(marks) = 0 THEN 'The source parses.' ELSE (CASE WHEN doc_id % 4 = 1 THEN 'fails at line 2' ELSE 'SyntaxError: invalid syntax at line ' || len(lines) END) || chr(10) || chr(10) || 'Lines:' || chr(10) || {_SNIPPET} END AS context
FROM (SELECT *, {_SHOWN} AS shown FROM (SELECT *, {_MARKS} AS marks FROM files))""")
def u24_error_context(spark, sf_dir):
    said = F.when(F.col("doc_id") % 4 == 1, "fails at line 2").otherwise("")
    return files(spark, sf_dir).select("path", C.error_context("content", said).alias("context"))


# --- tasks -------------------------------------------------------------------------------------
_OPEN, _CLOSE = _quoted("```python\n"), _quoted("\n```")


def _lines(first: str, last: str) -> str:
    return f"array_to_string(lines[{first}:{last}], chr(10))"


def _task(kind: str, user: str, assistant: str, of: str) -> str:
    return FILES + f"SELECT path, source, '{kind}' AS type, {user} AS user, {assistant} AS assistant FROM {of}"


def _code(c: str) -> str:
    return f"{_OPEN} || ({c}) || {_CLOSE}"


#: Functions in the order in which a file's are taken, and the function's head with nothing done.
def _first(seed: str, n: int, fits: str = "true") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sha1('{seed}:' || path || ':' || qualname), start_line) AS rn FROM functions WHERE {fits}) WHERE rn <= {n})"


_STUB = f"{_lines('start_line', 'start_line + doc')} || chr(10) || regexp_extract(lines[start_line + 1], '^\\s*') || 'raise NotImplementedError'"
_IMPORTS = "array_to_string(list_sort(list_distinct(list_filter(lines, lambda x: starts_with(x, 'import ') OR starts_with(x, 'from ')))), chr(10))"
_TURN = "CASE rn % 2 WHEN 1 THEN {} ELSE {} END"
_WHOLE = _lines("start_line", "end_line")


@query(_task("skeleton_to_impl", _TURN.format("'Implement the body of `' || name || '`.'", "'Write the full code of `' || name || '`.'") + " || chr(10) || chr(10) || " + _code(f"'# File: ' || path || chr(10) || chr(10) || {_IMPORTS} || chr(10) || chr(10) || (CASE WHEN class_name IS NOT NULL THEN 'class ' || class_name || ':' || chr(10) || '    ...' || chr(10) || chr(10) ELSE '' END) || {_STUB}"), _code(_WHOLE), _first("1", 3)))
def u03_skeletons(spark, sf_dir):
    return tasks.skeletons(files(spark, sf_dir))


@query(_task("partial_nav", f"'File: `' || path || '`' || chr(10) || chr(10) || {_code('array_to_string(lines[1:start_line - 1] || [' + _STUB + '] || lines[end_line + 1:], chr(10))')} || chr(10) || chr(10) || 'Implement `' || name || '` in this file.'", _code(_WHOLE), _first("2", 1)))
def u04_partial_files(spark, sf_dir):
    return tasks.partial_files(files(spark, sf_dir))


@query(_task("code_to_docstring", f"'Write a docstring for this function.' || chr(10) || chr(10) || {_code('array_to_string(lines[start_line:start_line] || lines[start_line + 2:end_line], chr(10))')}", "'\"\"\"' || chr(10) || docstring || chr(10) || '\"\"\"'", _first("3", 3, "len(string_split(docstring, ' ')) >= 8")))
def u05_docstrings(spark, sf_dir):
    return tasks.docstrings(files(spark, sf_dir))


_N = "(end_line - start_line + 1)"
_LOW = f"greatest(2, CAST(floor({_N} * 0.3::DOUBLE) AS BIGINT))"
_HIGH = f"greatest({_LOW} + 1, CAST(floor({_N} * 0.8::DOUBLE) AS BIGINT))"
_U4 = U01.format("'4:' || path || ':' || qualname || ':' || start_line")


@query(FILES + f""", cut AS (SELECT *, start_line + {_LOW} + CAST(floor({_U4} * ({_HIGH} - {_LOW})) AS BIGINT) AS cut FROM {_first("4", 3, "body_lines >= 10")})
SELECT path, source, 'completion' AS type, 'Continue this code.' || chr(10) || chr(10) || {_code(_lines("start_line", "cut - 1"))} AS user, {_code(_lines("cut", "end_line"))} AS assistant FROM cut WHERE length(trim({_lines("cut", "end_line")}, {WHITE})) >= 40""")
def u06_completions(spark, sf_dir):
    return tasks.completions(files(spark, sf_dir))


_BARE = "array_to_string(list_filter(lines, lambda x: NOT (starts_with(x, 'import ') OR starts_with(x, 'from '))), chr(10))"


@query(_task("import_resolution", f"'Write the imports that this code lacks.' || chr(10) || chr(10) || {_code(_BARE)}", _code(_IMPORTS), "files WHERE e = 1"))
def u07_imports(spark, sf_dir):
    return tasks.imports(files(spark, sf_dir))


@query(_task("generate_main", f"'File: `' || path || '`' || chr(10) || chr(10) || {_code(_lines('1', 'm_end + 1'))} || chr(10) || chr(10) || 'Write the block that runs this file as a program.'", _code(_lines("m_end + 2", "m_end + 3")), "files WHERE main AND NOT broken"))
def u08_mains(spark, sf_dir):
    return tasks.mains(files(spark, sf_dir))


@query(FILES + f"""SELECT a.path, a.source, 'test_pair' AS type, 'File: `' || a.path || '`' || chr(10) || chr(10) || {_code("a.content")} || chr(10) || chr(10) || 'Write pytest tests of this module.' AS user, {_code(f"trim(b.content, {WHITE})")} AS assistant
FROM files a JOIN files b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0 AND length(trim(b.content, {WHITE})) >= 100""")
def u09_test_pairs(spark, sf_dir):
    f = files(spark, sf_dir)
    pairs = f.filter("doc_id % 2 = 0").select("path", cat("m", (F.col("doc_id") + 1).cast("string"), ".py").alias("test_path"))
    return tasks.test_files(f, pairs)


_S = "(doc + k + 1)"
_FROM = f"greatest(1, CAST(floor({_S} * 0.3::DOUBLE) AS BIGINT))"
_TO = f"greatest({_FROM} + 1, CAST(floor({_S} * 0.8::DOUBLE) AS BIGINT))"
_U5 = U01.format("'5:' || path || ':' || head")


@query(FILES + f""", cut AS (SELECT *, head + 1 + {_FROM} + CAST(floor({_U5} * (least({_TO}, {_S}) - {_FROM})) AS BIGINT) AS cut FROM files WHERE NOT broken AND length(content) >= 200 AND {_S} + 1 >= 12)
SELECT path, {_lines("1", "cut - 1")} || chr(10) AS prefix, array_to_string(lines[cut:], chr(10)) AS suffix FROM cut WHERE length(trim(array_to_string(lines[cut:], chr(10)), {WHITE})) >= 80""")
def u10_completion_pairs(spark, sf_dir):
    return tasks.completion_pairs(files(spark, sf_dir))


# --- replies -----------------------------------------------------------------------------------
_JSON = "'{\"a\": ' || to_json(source || ' \"x\" {' || lang) || ', \"n\": ' || doc_id || '}'"
_object = lambda: F.to_json(F.struct(cat(F.col("source"), ' "x" {', F.col("lang")).alias("a"), F.col("doc_id").alias("n")))


@query(f"SELECT doc_id, {_JSON} AS json FROM documents")
def t71_json_in_reply(spark, sf_dir):
    """The same object whole, fenced, in prose behind thoughts, cut short, and with bare keys and a trailing comma."""
    bare = F.regexp_replace(F.regexp_replace(_object(), '"(a|n)":', "$1: "), r"\}$", ", }")
    reply = pick(5, _object(), cat("Well:\n```json\n", _object(), "\n```"), cat("<think>{\"z\": 1}", F.col("text"), "</think>It is ", _object(), " as asked"), F.regexp_replace(_object(), r"\}$", ""), bare)
    return read(spark, sf_dir, "documents").select("doc_id", R.json_column(reply).alias("json"))


@query("SELECT doc_id, '{\"content\": ' || to_json(CASE doc_id % 3 WHEN 2 THEN lang || ' \"' || source || '\"' || chr(10) || doc_id ELSE source || doc_id END) || ', \"path\": \"' || lang || '.py\"}' AS arguments FROM documents")
def t70_tool_arguments(spark, sf_dir):
    """Arguments of write_file: sound, with a raw line break, and with quotes that nobody escaped."""
    i = F.col("doc_id").cast("string")
    text = pick(3, cat('{"path": "', F.col("lang"), '.py", "content": "', F.col("source"), i, '"}'), cat('{"content":\n"', F.col("source"), i, '",\n"path": "', F.col("lang"), '.py",}'), cat('{"path": "', F.col("lang"), '.py", "content": "', F.col("lang"), ' "', F.col("source"), '"\\n', i, '"}'))
    return read(spark, sf_dir, "documents").select("doc_id", R.arguments_column("write_file")(text).alias("arguments"))


_BODY = "'-' || source || chr(10) || ' ' || replace(replace(text, '```', ''), chr(10), chr(10) || ' ') || chr(10) || '+' || lang"
_body = lambda: cat("-", F.col("source"), "\n ", F.replace(F.replace(F.col("text"), L("```"), L("")), L("\n"), L("\n ")), "\n+", F.col("lang"))
_TIDY = f"'diff --git a/' || lang || '.py b/' || lang || '.py' || chr(10) || '--- a/' || lang || '.py' || chr(10) || '+++ b/' || lang || '.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || {_BODY} || chr(10)"


def _rough(headers: bool):
    name = cat(F.col("lang"), ".py")
    head = cat("diff --git a/", name, " b/", name, "\nindex 0a1..b2c 100644\n")
    return cat(head, *(["--- a/", name, "\n+++ b/", name, "\n"] if headers else []), "@@ -1 +1 @@\n", _body(), "\n")


@query(f"SELECT doc_id, {_TIDY} AS diff FROM documents")
def t72_tidy_diff(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", R.tidy_diff_column(pick(2, cat(_rough(False), "```\n"), _rough(True))).alias("diff"))


@query(f"SELECT doc_id, CAST(1 + (doc_id % 3 = 1)::INT AS BIGINT) AS n, {_TIDY} AS diff FROM documents")
def t73_diffs_in_reply(spark, sf_dir):
    reply = pick(3, cat("Do this:\n```diff\n", _rough(False), "```\nDone."), cat("First\n```\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n```\nthen\n```patch\n", _rough(True), "```"), cat("It is\n", _rough(True)))
    diffs = R.diffs_column(reply)
    return read(spark, sf_dir, "documents").select("doc_id", diffs.alias("d")).select("doc_id", F.size("d").cast("long").alias("n"), F.element_at("d", -1).alias("diff"))


_OWN = f"trim(replace(text, '```', ''), chr(10)) || chr(10)"  # noqa: F541


@query(f"SELECT doc_id, unnest([lang || '.py', 'b.txt']) AS path, unnest([{_OWN} || (CASE WHEN doc_id % 2 = 0 THEN 'more ' || source || chr(10) ELSE '' END), source || chr(10)]) AS content FROM documents")
def u20_file_blocks(spark, sf_dir):
    name, own = cat(F.col("lang"), ".py"), F.replace(F.col("text"), L("```"), L(""))
    again = F.when(F.col("doc_id") % 2 == 0, cat("FILE: ", name, "\nmore ", F.col("source"), "\n")).otherwise("")
    reply = cat("Hello\nFILE: ", name, "\n```python\n", own, "\n```\n## FILE: `b.txt`\n", F.col("source"), "\n", again)
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(R.files_column(reply)).alias("path", "content"))


_TEXT = "regexp_replace(text, '[^A-Za-z0-9 .]', ' ', 'g')"


@query(f"SELECT doc_id, 1 AS n, lang || '.py' AS path, 'first line of it' || chr(10) || rtrim({_TEXT}) || chr(10) AS content FROM documents UNION ALL SELECT doc_id, 2, 'c/d.py', source || ' has another file' || chr(10) FROM documents WHERE doc_id % 3 < 2")
def u21_written_files(spark, sf_dir):
    """Two blocks: ended as they should be, by the next one, or with the text; blocks of diffs and short ones are none."""
    own = F.regexp_replace("text", "[^A-Za-z0-9 .]", " ")
    first = cat("x = 1 WRITE_FILE: ", F.col("lang"), ".py now\n<<<CONTENT\nfirst line of it\n", own, pick(3, L("\nCONTENT>>>\n"), L("\n</parameter>\n</function>\n"), L("")))
    second = F.when(F.col("doc_id") % 3 < 2, cat("\nWRITE_FILE: c/d.py\n  <<<CONTENT\n", F.col("source"), " has another file\nCONTENT>>\n## Why\nWRITE_FILE: b/e.py\n<<<CONTENT\nthis is of a diff, no file\n\n-WRITE_FILE: f.py\nWRITE_FILE: g.py\n<<<CONTENT\nshort\n")).otherwise("")
    blocks = R.written_files_column(cat("Hello\n", first, second))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(blocks).alias("n", "b")).select("doc_id", (F.col("n") + 1).alias("n"), "b.path", "b.content")


@query("SELECT doc_id, unnest([lang || '.py', 'z.py']) AS path, unnest([text || chr(10), source || chr(10) || '++' || lang || chr(10)]) AS content FROM documents")
def u22_new_files(spark, sf_dir):
    added = F.replace(F.col("text"), L("\n"), L("\n+"))
    diff = cat("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n--- /dev/null\n+++ b/", F.col("lang"), ".py\n@@ -0,0 +1 @@\n+", added, "\n--- /dev/null\n+++ z.py\n@@ -0,0 +1,2 @@\n+", F.col("source"), "\n+++", F.col("lang"), "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(R.new_files_column(diff)).alias("path", "content"))


@query(FILES + """SELECT path, CASE WHEN doc_id % 4 = 3 THEN content ELSE array_to_string(lines[1:head] || (CASE WHEN doc_id % 4 = 2 THEN lines[head + 1:] ELSE ['    # put in'] || lines[head + 1:] END), chr(10)) END AS patched, CAST((doc_id % 4 = 3)::INT AS BIGINT) AS lost FROM files""")
def u23_patched_files(spark, sf_dir):
    """A line put in below a function's head: by an exact hunk, by one with other white space; by one whose outcome is there already, and by one that fits nowhere."""
    f = files(spark, sf_dir)
    head = cat("def f_", F.col("doc_id").cast("string"), "(a, b=1):")
    new = "    # put in"
    exact, loose = cat("@@ -1 +1 @@\n ", head, "\n+", new, "\n"), cat("--- a\n+++ b\n@@ -9 +9 @@\n   ", head, " \n+", new, "\n")
    there, nowhere = cat("@@ -1 +1 @@\n-what it was\n ", head, "\n"), L("@@ -1 +1 @@\n nothing like it\n-and this neither\n-nor this\n+x\n")
    out = R.patched_column("content", pick(4, exact, loose, there, nowhere))
    kept = F.when(F.col("doc_id") % 4 == 1, F.replace(out["text"], cat("  ", head, " "), head)).otherwise(out["text"])
    return f.select("path", kept.alias("patched"), out["lost"].cast("long").alias("lost"))
