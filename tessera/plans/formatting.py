"""Queries of the formatters of dataset rows.

The documents stand in for datasets: a row's columns come and go with its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formats as X
from tessera.functions import parse as P
from tessera.functions import text as T
from tessera.plans.base import query, read
from tessera.plans.cleaning import _CHATTY, _FENCE, _quoted
from tessera.plans.parsing import WHITE, cat, pick, sql_pick

#: An answer: a fence, a chatty line, bare code, or the text alone.
_ANSWERS = ("Sure\n```python\ndef f():\n    return 1\n# <flat>\n```", "Here is it\nimport os\n<text>", "class A:\n    pass\n<text>", "<text>")
_ANSWER = sql_pick(4, *[_quoted(a).replace("<text>", "' || text || '").replace("<flat>", "' || replace(text, chr(10), ' ') || '") for a in _ANSWERS])


def _answer():
    return pick(4, *[F.replace(F.replace(F.lit(a), F.lit("<flat>"), F.replace(F.col("text"), F.lit("\n"), F.lit(" "))), F.lit("<text>"), F.col("text")) for a in _ANSWERS])


def _code(c: str, most: int = 6000) -> str:
    whole = f"trim(coalesce(nullif(regexp_extract({c}, {_quoted(_FENCE)}, 1), ''), regexp_replace({c}, {_quoted(_CHATTY)}, '')), {WHITE}) || chr(10)"
    return f"(rtrim(substr({whole}, 1, {most}), {WHITE}) || chr(10))"


def _fits(c: str) -> str:
    marks = " OR ".join(f"contains({c}, '{m}')" for m in X.CODE_MARKS)
    return f"(length(trim({c}, {WHITE})) >= {X.CODE_LEAST} AND ({marks}))"


def _said(prompt: str, **values: str) -> str:
    out = _quoted(prompt)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


def _chat(user: str, assistant: str) -> str:
    return f"'User:' || chr(10) || ({user}) || chr(10) || chr(10) || 'Assistant:' || chr(10) || ({assistant}) AS text"


def _docs(spark, sf_dir, **columns):
    return read(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


_TASK = "(CASE WHEN doc_id % 7 = 0 THEN '' ELSE source || ' task ' || doc_id END)"
_task = lambda: F.when(F.col("doc_id") % 7 == 0, "").otherwise(cat(F.col("source"), " task ", F.col("doc_id").cast("string")))


@query(f"SELECT doc_id, {_chat(_said(X.TO_CODE, task=_TASK), 'code')} FROM (SELECT *, {_code(_ANSWER)} AS code FROM documents) WHERE {_TASK} <> '' AND doc_id % 5 <> 1 AND {_fits('code')}")
def t47_problem_rows(spark, sf_dir):
    lang = F.when(F.col("doc_id") % 5 == 1, "java").when(F.col("doc_id") % 5 == 2, "Python3").when(F.col("doc_id") % 5 == 3, "")
    rows = _docs(spark, sf_dir, problem=F.when(F.col("doc_id") % 2 == 0, _task()), instruction=_task(), output=_answer(), lang=lang)
    return X.problems(rows).select("doc_id", "text")


_BARE = "'from a import b' || chr(10) || source || chr(10) || text"


@query(f"""SELECT doc_id, {_chat("CASE WHEN ok THEN " + _said(X.TO_CODE, task=_TASK) + " ELSE 'Write it.' END", 'CASE WHEN ok THEN code ELSE bare END')}
FROM (SELECT *, {_TASK} <> '' AND {_fits('code')} AS ok FROM (SELECT *, {_code(_ANSWER)} AS code, {_code(_BARE)} AS bare FROM documents)) WHERE ok OR {_fits('bare')}""")
def t47_instruction_rows(spark, sf_dir):
    rows = _docs(spark, sf_dir, prompt=_task(), solution=_answer(), body=cat("from a import b\n", F.col("source"), "\n", F.col("text")))
    return X.instructions(rows, raw="Write it.").select("doc_id", "text")


_TESTS = "list_transform(range(1, CAST(doc_id % 8 AS BIGINT) + 1), lambda i: 'assert ' || lang || '_f(' || i || ') == ' || doc_id)"


def _tested(spark, sf_dir):
    places = F.slice(F.array(*map(F.lit, range(1, 9))), F.lit(1), (F.col("doc_id") % 8).cast("int"))
    tests = F.transform(places, lambda i: cat("assert ", F.col("lang"), "_f(", i.cast("string"), ") == ", F.col("doc_id").cast("string")))
    return _docs(spark, sf_dir, text=_task(), code=_answer(), test_list=tests)


@query(f"""SELECT doc_id, {_chat(_said(X.WITH_TESTS, task=_TASK, tests=f"array_to_string(({_TESTS})[1:5], chr(10))"), f"trim(code, {WHITE})")} FROM (SELECT *, {_code(_ANSWER)} AS code FROM documents) WHERE {_TASK} <> '' AND {_fits('code')}""")
def t49_tested_problems(spark, sf_dir):
    return X.tested_problems(_tested(spark, sf_dir)).select("doc_id", "text")


@query(f"""SELECT doc_id, {_chat("CASE WHEN doc_id % 8 = 0 THEN " + _said(X.TO_CODE, task=_TASK) + " ELSE " + _said(X.NAMED, task=_TASK, entry="lang || '_f'") + " END", 'code')}
FROM (SELECT *, {_code(_ANSWER)} AS code FROM documents) WHERE {_TASK} <> '' AND {_fits('code')}""")
def t47_named_problems(spark, sf_dir):
    return X.named_problems(_tested(spark, sf_dir)).select("doc_id", "text")


@query(f"""SELECT doc_id, {_chat(_said(X.COMPLETE, code="'def f_' || doc_id || '():'"), f"trim(text, {WHITE})")} FROM documents WHERE doc_id % 9 > 0""")
def t49_continuations(spark, sf_dir):
    rows = _docs(spark, sf_dir, prompt=cat("def f_", F.col("doc_id").cast("string"), "():"), canonical_solution=F.when(F.col("doc_id") % 9 > 0, F.col("text")))
    return X.continuations(rows).select("doc_id", "text")


_DIFF = sql_pick(4, "'diff --git a b' || chr(10) || text", "'--- a' || chr(10) || text", "''", "text")
_diff = lambda: pick(4, cat("diff --git a b\n", F.col("text")), cat("--- a\n", F.col("text")), F.lit(""), F.col("text"))


@query(f"""SELECT doc_id, {_chat(_said(X.PATCH, task="(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || ' ...' ELSE text END)"), f"trim({_DIFF}, {WHITE})")} FROM documents WHERE trim({_DIFF}, {WHITE}) <> ''""")
def t48_patch_rows(spark, sf_dir):
    rows = _docs(spark, sf_dir, commit_message=F.when(F.col("doc_id") % 3 == 0, F.col("text")), title=F.col("text"), patch=_diff())
    return X.patches(rows).select("doc_id", "text")


@query(f"""SELECT doc_id, {_chat(_TASK, f"trim({_DIFF}, {WHITE}) || chr(10)")} FROM documents WHERE {_TASK} <> '' AND (contains({_DIFF}, 'diff --git') OR starts_with(trim({_DIFF}, {WHITE}), '---'))""")
def t47_patch_rows(spark, sf_dir):
    return X.patches(_docs(spark, sf_dir, prompt=_task(), patch=_diff()), strict=True).select("doc_id", "text")


@query(f"SELECT doc_id, {_chat('substr(text, 1, 700)', 'substr(text, 300, 700)')} FROM documents WHERE text <> '' AND substr(text, 300, 700) <> '' AND length(substr(text, 1, 700)) + length(substr(text, 300, 700)) + 19 >= 400")
def r25_private_chats(spark, sf_dir):
    """Both sides are cut: that is the operator."""
    return X.private_chats(_docs(spark, sf_dir, user=F.col("text"), assistant=F.substr("text", F.lit(300))), 700, 400).select("doc_id", "text")


def _mixed(spark, sf_dir, **more):
    i = F.col("doc_id") % 5
    return _docs(spark, sf_dir, prompt=F.when(i < 2, F.col("source")), completion=F.when(i == 0, F.col("text")), instruction=F.when(i == 2, F.col("lang")), output=F.when(i > 1, F.col("text")), **more)


_FILLED = f"length(trim(text, {WHITE})) > 0"
_PLAIN = f"CASE doc_id % 5 WHEN 0 THEN CASE WHEN text <> '' THEN source || chr(10) || text ELSE source END WHEN 1 THEN source WHEN 2 THEN CASE WHEN text <> '' THEN lang || chr(10) || text ELSE lang END ELSE CASE WHEN {_FILLED} THEN text END END"


@query(f"SELECT * FROM (SELECT doc_id, {_PLAIN} AS text FROM documents) WHERE text IS NOT NULL")
def r29_public_texts(spark, sf_dir):
    return X.plain_texts(_mixed(spark, sf_dir)).select("doc_id", "text")


@query(f"SELECT * FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source ELSE {_PLAIN} END AS text FROM documents) WHERE text IS NOT NULL")
def t41_local_texts(spark, sf_dir):
    return X.local_texts(_mixed(spark, sf_dir, content=F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(" "))).select("doc_id", "text")


_DOC = sql_pick(3, "'Return ' || text", "text", "' ' || chr(10)")


@query(f"""SELECT doc_id, 'Write the Python ' || (CASE WHEN doc_id % 2 = 0 THEN 'class' ELSE 'function' END) || ' `' || source || '`' || (CASE WHEN doc_id % 3 = 0 THEN '' ELSE ', `' || lang || '(x)`' END) ||
(CASE WHEN line = '' THEN '; see `' || lang || '.py`' ELSE '; it ' || (CASE WHEN starts_with(low, 'return ') THEN 'returns ' || substr(low, 8) ELSE low END) END) || '.' AS task
FROM (SELECT *, lower(substr(line, 1, 1)) || substr(line, 2) AS low FROM (SELECT *, rtrim(trim(string_split(trim({_DOC}, {WHITE}), chr(10))[1], {WHITE}), '.') AS line FROM documents))""")
def t50_task_sentence(spark, sf_dir):
    doc = pick(3, cat("Return ", F.col("text")), F.col("text"), F.lit(" \n"))
    sentence = X.task_sentence(F.col("source"), F.when(F.col("doc_id") % 2 == 0, "class").otherwise("function"), F.when(F.col("doc_id") % 3 > 0, cat(F.col("lang"), "(x)")), doc, cat(F.col("lang"), ".py"))
    return read(spark, sf_dir, "documents").select("doc_id", sentence.alias("task"))


@query("SELECT doc_id, 'User:' || chr(10) || source || chr(10) || chr(10) || 'Assistant:' || chr(10) || text AS plain, '<|im_start|>user' || chr(10) || source || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' AS marked FROM documents")
def t37_chat_text(spark, sf_dir):
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role"), F.col(c).alias("content")) for i, (r, c) in enumerate((("user", "source"), ("assistant", "text")))])
    return read(spark, sf_dir, "documents").select("doc_id", T.chat(F.col("source"), F.col("text")).alias("plain"), P.chatml(turns).alias("marked"))
