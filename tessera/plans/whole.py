"""Queries of text operators over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import parse as P
from tessera.functions import text as T
from tessera.operators import order as O
from tessera.plans.base import query, read, simple
from tessera.plans.mixes import _ORDER, docs
from tessera.plans.parsing import WHITE, cat, pick, sql_pick

WHOLE = lambda: F.col("text")
#: What strip takes off, but for the newline: the lines of a text hold none.
INNER = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

simple("t02_page_url", "documents", {"url": (lambda: T.page_url(F.lit("https://x.org/wiki/"), WHOLE()), "'https://x.org/wiki/' || replace(text, ' ', '_')")})
simple("t11_strip_quotes", "documents", {"plain": (lambda: F.regexp_replace(cat("'''", WHOLE(), "''"), "'{2,}", ""), "regexp_replace('''''''' || text || '''''', '''{2,}', '', 'g')")})
simple("t35_file_header", "documents", {"cpt": (lambda: cat("# File: ", F.col("source"), "\n# Language: ", F.col("lang"), "\n\n", WHOLE()), "'# File: ' || source || chr(10) || '# Language: ' || lang || chr(10) || chr(10) || text")})
simple("t36_completion_prompt", "documents", {"prompt": (lambda: cat("Complete the following code:\n\n", WHOLE()), "'Complete the following code:' || chr(10) || chr(10) || text")})
simple("t46_final_answer_cut", "documents", {"body": (lambda: T.gsm_answer(cat(WHOLE(), "\n#### 42")), r"regexp_replace(text || chr(10) || '#### 42', '(?m)\s*####.*$', '', 'g')")})
_PARTS = f"trim(string_split(text, chr(10))[1], {WHITE})", f"trim(trim(text, {WHITE}) || chr(10) || '#### ' || doc_id, {WHITE})"
_CHAT = "'<|im_start|>system' || chr(10) || '" + P.TUTOR + "<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || " + _PARTS[0] + " || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || " + rf"trim(regexp_replace({_PARTS[1]}, '(?m)\s*####.*$', '', 'g'), {WHITE}) || '<|im_end|>'"
simple("t46_problem_chat", "documents", {"chat": (lambda: P.problem_chat(F.substring_index("text", "\n", 1), cat(T.strip(WHOLE()), "\n#### ", F.col("doc_id").cast("string"))), f"CASE WHEN {_PARTS[0]} <> '' THEN {_CHAT} END")})
simple("t79_file_name", "documents", {"name": (lambda: F.regexp_replace(WHOLE(), r"[^A-Za-z0-9._-]+", "_"), "regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g')")})
simple("t52_reasoning_row", "documents", {"row": (lambda: P.reasoning_row(cat("<think> ", WHOLE(), "</think>\n"), F.col("lang")), f"'{P.THOUGHT}' || trim(regexp_replace('<think> ' || text || '</think>' || chr(10), '</?think>', '', 'g'), {WHITE}) || '{P.THOUGHT_END}{P.SOLUTION}' || lang || '{P.SOLUTION_END}'")})

_reply = lambda: pick(4, cat("Sure\n```python\n", WHOLE(), "\n```"), cat("```\n", WHOLE(), "\n```"), cat("Well.\ndef f():\n", WHOLE()), WHOLE())
_REPLY = sql_pick(4, "'Sure' || chr(10) || '```python' || chr(10) || text || chr(10) || '```'", "'```' || chr(10) || text || chr(10) || '```'", "'Well.' || chr(10) || 'def f():' || chr(10) || text", "text")
simple("t19_generated_code", "documents", {"code": (lambda: P.generated_code(_reply()), rf"coalesce(nullif(regexp_extract({_REPLY}, '(?s)```(?:python|py)[ \t]*\n(.*?)```', 1), ''), nullif(regexp_extract({_REPLY}, '(?s)```[^\n]*\n(.*?)```', 1), ''), nullif(regexp_extract({_REPLY}, '(?ms)^((?:def |class |import |from |@).*)\z', 1), ''), {_REPLY})")})
simple("t20_after_fence", "documents", {"code": (lambda: P.after_fence(_reply()), rf"trim(CASE WHEN contains({_REPLY}, '```') THEN regexp_replace(string_split({_REPLY}, '```')[2], '^(?:python|py)\n', '') ELSE {_REPLY} END, {WHITE})")})

_diff = lambda: cat("--- a/x.py\n+++ b/x", (F.col("doc_id") % 3).cast("string"), ".py\n@@ -1 +1 @@\n-", F.replace(WHOLE(), F.lit("\n"), F.lit("\n-")), "\n+new\n+++ b/a.py\n+more\n+++ b/a.py")
_REMOVED = "list_transform(string_split(text, chr(10)), lambda x: '-' || x)"
simple("a24_diff_paths", "documents", {"paths": (lambda: F.array_join(P.diff_paths(_diff()), ","), "'a.py,x' || doc_id % 3 || '.py'"), "changed": (lambda: P.changed_lines(_diff()), f"CAST(2 + len(list_filter({_REMOVED}, lambda x: NOT starts_with(x, '---'))) AS BIGINT)")})
simple("d09_import_lines", "documents", {"imports": (lambda: F.array_join(P.import_lines(cat("import b\nfrom a import c\n", WHOLE(), "\n  import b\nimport z", F.col("lang"))), ";"), rf"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split('import b' || chr(10) || 'from a import c' || chr(10) || text || chr(10) || '  import b' || chr(10) || 'import z' || lang, chr(10)), lambda x: trim(x, {INNER})), lambda x: starts_with(x, 'import ') OR starts_with(x, 'from ')))), ';')")})

_chat = lambda: cat("USER: ", F.left(WHOLE(), F.lit(30)), " ASSISTANT: <functioncall> {\"a\": 1} FUNCTION RESPONSE: {\"b\": 2} ASSISTANT: ", F.substr(WHOLE(), F.lit(31)))


@query(rf"""SELECT doc_id, role, content FROM (SELECT doc_id, CASE WHEN starts_with(p, 'USER:') THEN 'user' WHEN starts_with(p, 'ASSISTANT:') THEN 'assistant' WHEN starts_with(p, 'FUNCTION RESPONSE:') THEN 'tool' END AS role,
trim(regexp_replace(regexp_replace(p, '^(USER:|ASSISTANT:|FUNCTION RESPONSE:)', ''), '(?s)<functioncall>\s*(\{{.*?\}})\s*', '<tool_call>\1</tool_call>', 'g'), {WHITE}) AS content FROM
(SELECT doc_id, unnest(string_split(regexp_replace('USER: ' || substr(text, 1, 30) || ' ASSISTANT: <functioncall> {{"a": 1}} FUNCTION RESPONSE: {{"b": 2}} ASSISTANT: ' || substr(text, 31), '(USER:|ASSISTANT:|FUNCTION RESPONSE:)', chr(1) || '\1', 'g'), chr(1))) AS p FROM documents)) WHERE role IS NOT NULL AND content <> ''""")
def t44_chat_turns(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.inline(P.chat_turns(_chat())))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 1 AND trim(text, {WHITE}) <> '' THEN text ELSE source END AS value FROM documents {_ORDER.format(18)} LIMIT 40")
def m18_sampled_texts(spark, sf_dir):
    value = T.first_not_blank(F.when(F.col("doc_id") % 2 == 1, WHOLE()).otherwise(""), F.col("source"))
    return O.sample_n(docs(spark, sf_dir, value.alias("value")), 40, "18", "doc_id")


_QUESTION = "how to query a web page under the licensed terms"
_LEX = f"5 * contains('{_QUESTION}', lower(source))::INT + least(5, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_]{{3,}}')), lambda w: contains('{_QUESTION}', w))))"


@query(f"SELECT doc_id, CAST({_LEX} AS BIGINT) AS score FROM documents WHERE {_LEX} >= 2 ORDER BY 2 DESC, 1 LIMIT 6")
def m02_lexical_top_k(spark, sf_dir):
    score = P.lexical_score(F.col("source"), WHOLE(), _QUESTION)
    return docs(spark, sf_dir, score.cast("long").alias("score")).filter("score >= 2").orderBy(F.desc("score"), "doc_id").limit(6)
