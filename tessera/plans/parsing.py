"""Queries of the parsing functions: generated text, logs, chats, rewards, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import parse as P
from tessera.functions import text as T
from tessera.operators.tokens import token_rows
from tessera.plans.base import U01, query, read, simple

TEXT, L = F.col, F.lit


def cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def pick(n, *cs):
    """The doc_id modulo n chooses."""
    out = F.when(F.col("doc_id") % n == 0, cs[0])
    for i, c in enumerate(cs[1:-1], 1):
        out = out.when(F.col("doc_id") % n == i, c)
    return out.otherwise(cs[-1])


def sql_pick(n, *cs):
    return "CASE doc_id % " + str(n) + "".join(f" WHEN {i} THEN {c}" for i, c in enumerate(cs[:-1])) + f" ELSE {cs[-1]} END"


NL, WHITE = "chr(10)", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# --- generated code ----------------------------------------------------------------------------
simple("t21_trimmed_code", "documents", {"code": (lambda: P.trimmed_code(F.col("text"), 90), f"rtrim(substr(text, 1, 90), {WHITE}) || chr(10)")})
simple("t32_repo_slug", "pages", {"slug": (lambda: P.repo_slug(F.col("url")), r"CASE WHEN regexp_extract(url, '^https?://[^/]+/([^/?#]+)/([^/?#]+)', 1) <> '' THEN regexp_extract(url, '^https?://[^/]+/([^/?#]+)/([^/?#]+)', 1) || '__' || regexp_replace(regexp_extract(url, '^https?://[^/]+/([^/?#]+)/([^/?#]+)', 2), '\.git$', '') ELSE left(sha1(url), 12) END")}, None, "page_id")
_tests = lambda: pick(3, cat("assert f", F.col("doc_id").cast("string"), "(1) == 2"), cat("x = 1\nassert  ", F.col("lang"), "_run(", F.col("source"), ")"), L(""))
_TESTS = sql_pick(3, "'assert f' || doc_id || '(1) == 2'", "'x = 1' || chr(10) || 'assert  ' || lang || '_run(' || source || ')'", "''")
_problem = lambda: pick(2, cat("Write a function add_", F.col("lang"), " to sum ", F.col("text")), cat("one named ", F.col("source"), "_x ", F.col("text")))
_PROBLEM = sql_pick(2, "'Write a function add_' || lang || ' to sum ' || text", "'one named ' || source || '_x ' || text")
simple("t38_entry_point", "documents", {"name": (lambda: P.entry_point(_tests(), _problem()), rf"coalesce(nullif(regexp_extract({_TESTS}, 'assert\s+(\w+)\s*\(', 1), ''), nullif(regexp_extract({_PROBLEM}, 'function\s+(\w+)', 1), ''), nullif(regexp_extract({_PROBLEM}, 'named\s+(\w+)', 1), ''))")})
simple("t85_model_spec", "documents", {"kind": (lambda: P.model_spec(pick(3, cat("openai:m", F.col("lang")), cat("/models/", F.col("lang"), "/"), cat("org/", F.col("lang"))))[0], sql_pick(3, "'openai'", "'local'", "'hub'")), "name": (lambda: P.model_spec(pick(3, cat("openai:m", F.col("lang")), cat("/models/", F.col("lang"), "/"), cat("org/", F.col("lang"))))[1], sql_pick(3, "'m' || lang", "lang", "lang"))})
_patch = lambda: pick(3, cat("diff --git a b", F.col("text")), cat("--- a", F.col("text")), F.col("text"))
_PATCH = sql_pick(3, "'diff --git a b' || text", "'--- a' || text", "text")
simple("f14_patch", "documents", {"patch": (lambda: F.contains(_patch(), L("diff --git")) | _patch().startswith("---"), f"(contains({_PATCH}, 'diff --git') OR starts_with({_PATCH}, '---'))")})
simple("f23_line_range", "documents", {"shown": (lambda: P.line_range(F.col("text"), 2, 4), r"array_to_string(list_transform(range(2, least(4, len(string_split(text, chr(10)))) + 1), lambda i: lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || string_split(text, chr(10))[i]), chr(10))")})
_LOW, _HIGH, _N = "greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT))", "greatest(1, CAST(floor(n * 0.8::DOUBLE) AS BIGINT))", "len(string_split(text, chr(10)))"


@query(f"""SELECT doc_id, array_to_string(l[1:cut], chr(10)) AS before, array_to_string(l[cut + 1:], chr(10)) AS after FROM (SELECT doc_id, l, n, {_LOW} + CAST(floor({U01.format("'3:' || doc_id")} * ({_HIGH} - {_LOW} + 1)) AS BIGINT) AS cut
FROM (SELECT doc_id, string_split(text, chr(10)) AS l, {_N} AS n FROM documents)) WHERE n >= 3""")
def u11_line_completion(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").filter(F.size(F.split("text", "\n", -1)) >= 3)
    before, after = P.line_completion(F.col("text"), "3", F.col("doc_id"), T.unit)
    return docs.select("doc_id", before.alias("before"), after.alias("after"))


# --- chats -------------------------------------------------------------------------------------


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || left(text, 200) || '<|im_end|>', chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def t45_chatml(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.left(F.col("text"), L(200)).alias("content")).alias("t"))
    return c.groupBy("conv_id").agg(P.chatml(F.array_sort(F.collect_list("t"))).alias("chat"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS arguments FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def a26_assembled_deltas(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("arguments"))


# --- rewards -----------------------------------------------------------------------------------
def _answer():
    e = F.col("event_id") % 6
    return F.when(e == 0, "42").when(e == 1, " 42").when(e == 2, "45").when(e == 3, "50").when(e == 4, "1,042").otherwise("none")


_completion = lambda: F.when(F.col("event_id") % 7 == 0, cat("no marks ", _answer())).otherwise(cat("w", P.THOUGHT_END, "\n", P.SOLUTION, _answer(), P.SOLUTION_END))
_MARKED = "event_id % 7 <> 0"
simple("t53_format_reward", "events", {"reward": (lambda: P.format_reward(_completion()), f"CASE WHEN {_MARKED} THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END")}, None, "event_id")
simple("t54_marks_reward", "events", {"reward": (lambda: P.marks_reward(_completion()), f"CASE WHEN {_MARKED} THEN 1.5::DOUBLE ELSE -3.0::DOUBLE END")}, None, "event_id")
simple("t55_answer_reward", "events", {"reward": (lambda: P.solution_reward(_completion(), L("42")), f"CASE WHEN NOT ({_MARKED}) THEN -2.0::DOUBLE WHEN event_id % 6 = 0 THEN 5.0::DOUBLE WHEN event_id % 6 = 1 THEN 3.5::DOUBLE WHEN event_id % 6 = 2 THEN 2.0::DOUBLE WHEN event_id % 6 = 3 THEN 1.5::DOUBLE ELSE -4.5::DOUBLE END")}, None, "event_id")
simple("t56_number_reward", "events", {"reward": (lambda: P.number_reward(_completion(), L("42")), f"CASE WHEN NOT ({_MARKED}) OR event_id % 6 = 5 THEN -2.5::DOUBLE WHEN event_id % 6 < 2 THEN 3.5::DOUBLE ELSE -1.5::DOUBLE END")}, None, "event_id")

# --- logs and specifications -------------------------------------------------------------------
_FILL = "repeat('The sun sets in the west. ', CAST(ceil(greatest(64, user_id) * 4 / 26.0) AS INTEGER))"
_AT = f"CAST(floor(length({_FILL}) * least(event_id / 10000.0::DOUBLE, 1.0::DOUBLE)) AS BIGINT)"
simple("t58_passkey_context", "events", {"context": (lambda: P.passkey_context(F.col("user_id"), F.col("event_id"), F.col("event_id") / 10000.0), f"substr({_FILL}, 1, {_AT}) || chr(10) || 'The secret passkey is ' || event_id || '.' || chr(10) || substr({_FILL}, {_AT} + 1)")}, None, "event_id")
simple("t59_prefill", "events", {"n": (lambda: F.octet_length(P.repeated_to("Some words. ", F.col("user_id") + 1)).cast("long"), "CAST(12 * ceil((user_id + 1) * 4 / 12.0) AS BIGINT)")}, None, "event_id")
_log = lambda: cat("base pass@1: 0.", F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), "\nplus pass@1:  ", (F.col("event_id") % 97).cast("string"))
simple("t60_pass_scores", "events", {"base": (lambda: F.round(P.pass_score(_log(), 1), 4), "round((event_id % 100)::DOUBLE, 4)"), "plus": (lambda: P.pass_score(_log(), 2), "CASE WHEN event_id % 97 <= 1 THEN (event_id % 97) * 100.0::DOUBLE ELSE (event_id % 97)::DOUBLE END")}, None, "event_id")
simple("t61_positive_ints", "events", {"n": (lambda: F.size(P.positive_ints(F.concat_ws(",", F.col("user_id") - 5, L("x"), L(" 7"), F.col("event_id") % 7 - 3))).cast("long"), "CAST(1 + (user_id > 5)::INT + (event_id % 7 > 3)::INT AS BIGINT)")}, None, "event_id")
_spec = lambda: F.concat_ws(",", cat("name=", F.col("event_type")), F.when(F.col("event_id") % 3 > 0, cat("prefill=", F.col("user_id").cast("string"))), F.when(F.col("event_id") % 2 > 0, cat("model=m", (F.col("event_id") % 7).cast("string"))))
_SPEC = "concat_ws(',', 'name=' || event_type, CASE WHEN event_id % 3 > 0 THEN 'prefill=' || user_id END, CASE WHEN event_id % 2 > 0 THEN 'model=m' || event_id % 7 END)"
simple("t62_assignments", "events", {k: ((lambda k=k: P.assignments(_spec())[k]), f"nullif(regexp_extract({_SPEC}, '(?:^|,){k}=([^,]*)', 1), '')") for k in ("name", "prefill", "model")}, None, "event_id")
_CAP = {}
for _mark, _tag in P.CAPABILITIES.items():
    _CAP.setdefault(_tag, []).append(f"contains(lower(text), '{_mark}')")
_TAGS = ", ".join(f"CASE WHEN {' OR '.join(m)} THEN '{t}' END" for t, m in _CAP.items()) + ", CASE WHEN doc_id % 2 = 0 THEN 'script_execution' END"
simple("t64_capabilities", "documents", {"tags": (lambda: F.array_join(P.capabilities(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "main.py").otherwise("")), ","), f"coalesce(nullif(array_to_string(list_filter([{_TAGS}], lambda x: x IS NOT NULL)[1:8], ','), ''), 'general_automation')")})
_words = [*P.FAILURES, "odd", "Execution FAILED"]
_said = lambda: F.concat_ws("; ", *[F.when(F.shiftright("doc_id", i) % 2 == 1, w) for i, w in enumerate(_words)])
_SAID = "concat_ws('; ', " + ", ".join(f"CASE WHEN (doc_id >> {i}) % 2 = 1 THEN '{w}' END" for i, w in enumerate(_words)) + ")"
_MODES = ", ".join(f"CASE WHEN contains(lower({_SAID}), '{w}') THEN '{t}' END" for w, t in P.FAILURES.items())
simple("t65_failure_modes", "documents", {"modes": (lambda: F.array_join(F.array_sort(P.failure_modes(_said())), ","), f"CASE WHEN {_SAID} = '' THEN '' ELSE coalesce(nullif(array_to_string(list_sort(list_filter([{_MODES}], lambda x: x IS NOT NULL)), ','), ''), 'sandbox_issue') END")})


_TRACE = "'Traceback' || chr(10) || array_to_string(list_transform(range(1, CAST(doc_id % 5 + 2 AS BIGINT)), lambda i: '  File \"' || lang || i || '.py\", line ' || doc_id * i || ', in f' || chr(10) || '    ' || source || i || '()' || chr(10)), '') || text"


@query(rf"""SELECT doc_id, unnest(regexp_extract_all(trace, 'File "([^"]+)", line (\d+)', 1)) AS file, CAST(unnest(regexp_extract_all(trace, 'File "([^"]+)", line (\d+)', 2)) AS BIGINT) AS line FROM (SELECT doc_id, {_TRACE} AS trace FROM documents)""")
def t74_trace_places(spark, sf_dir):
    frames = F.transform(F.sequence(L(1).cast("long"), F.col("doc_id") % 5 + 1), lambda i: cat('  File "', F.col("lang"), i.cast("string"), '.py", line ', (F.col("doc_id") * i).cast("string"), ", in f\n    ", F.col("source"), i.cast("string"), "()\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.inline(P.trace_places(cat("Traceback\n", F.array_join(frames, ""), F.col("text")))))


simple("t75_missing_package", "documents", {"package": (lambda: P.missing_package(pick(3, L("x\nModuleNotFoundError: No module named 'cv2'"), cat("ImportError: No module named '", F.col("lang"), "'"), L("fine"))), sql_pick(3, "'opencv-python'", "lang", "NULL"))})
simple("t82_key_path", "events", {"v": (lambda: F.get_json_object(cat('{"a": {"b": ', F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise('"x"'), "}}"), "$.a.b").try_cast("double"), "CASE WHEN event_id % 2 = 0 THEN event_id::DOUBLE END")}, None, "event_id")
_key = lambda: cat(F.when(F.col("event_id") % 2 == 0, "module.").otherwise(""), F.when(F.col("event_id") % 3 == 0, "head.").otherwise("body.head."), F.col("event_type"))
_KEY = "(CASE WHEN event_id % 2 = 0 THEN 'module.' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN 'head.' ELSE 'body.head.' END || event_type)"
simple("t84_renamed_keys", "events", {"k": (lambda: F.array_join(F.map_keys(F.transform_keys(F.create_map(_key(), L(1)), lambda k, v: F.regexp_replace(F.regexp_replace(k, r"^module\.", ""), r"^head\.", "heads.0."))), ","), rf"regexp_replace(regexp_replace({_KEY}, '^module\.', ''), '^head\.', 'heads.0.')")}, None, "event_id")
simple("t86_busy", "events", {"busy": (lambda: P.busy(cat("# help\nrunning{m=\"a\"} ", (F.col("event_id") % 3).cast("string"), "\nother 99\nwaiting 0.0"), ("running", "waiting"), 2), "event_id % 3 >= 2")}, None, "event_id")

# --- predicates, token arrays ------------------------------------------------------------------
simple("f04_extension", "pages", {"kept": (lambda: F.regexp_extract(F.col("url"), r"\.[^./?]+(?=\?|$)", 0).isin("", ".html") & ~F.arrays_overlap(F.split("url", "/", -1), F.array(L("fr"), L("es"))), r"(NOT (contains(url || '/', '/fr/') OR contains(url || '/', '/es/')) AND regexp_extract(url, '(\.[^./?]+)(\?|$)', 1) IN ('', '.html'))")}, None, "page_id")
simple("f05_byte_size", "documents", {"n": (lambda: F.octet_length("text").cast("long"), "strlen(text)")}, (lambda: F.octet_length("text").between(200, 4000), "strlen(text) BETWEEN 200 AND 4000"))
_bytes = lambda: F.concat(F.encode("text", "UTF-8"), F.unhex(pick(4, L("C3"), L(""), L("E282"), L("C3A9"))))
simple("f06_readable", "documents", {"fine": (lambda: F.is_valid_utf8(_bytes().cast("string")), "doc_id % 4 IN (1, 3)")})
simple("f07_no_nul", "pages", {"text_like": (lambda: ~F.contains(F.col("html"), L("\x00")), "NOT contains(html, chr(0))")}, None, "page_id")
simple("f17_token_cap", "documents", {"n": (lambda: F.size(F.split("text", " ", -1)).cast("long"), "CAST(len(string_split(text, ' ')) AS BIGINT)")}, (lambda: F.size(F.split("text", " ", -1)) <= 100, "len(string_split(text, ' ')) <= 100"))
simple("f19_exact_length", "documents", {"last": (lambda: F.element_at(F.slice(F.split("text", " ", -1), 1, 64), -1), "string_split(text, ' ')[64]")}, (lambda: F.size(F.slice(F.split("text", " ", -1), 1, 64)) == 64, "len(string_split(text, ' ')) >= 64"))
simple("f22_file_glob", "pages", {"url": (lambda: F.col("url"), "url")}, (lambda: F.lower(F.substring_index("url", "/", -1)).rlike("1.*2"), "regexp_matches(lower(list_extract(string_split(url, '/'), -1)), '1.*2')"), "page_id")
_ids = lambda: F.transform(F.sequence(L(0), (F.col("vec_id") % 9 + 4).cast("int")), lambda i: i % 5)
_IDS = "list_transform(range(0, vec_id % 9 + 5), lambda i: i % 5)"


#: The most ids of a text.
_MOST = 512


@query(f"""WITH b AS (SELECT doc_id, hex(encode(text)) AS h, least({_MOST}, strlen(text)) AS n FROM documents),
i AS (SELECT doc_id, list_transform(range(n), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER)) AS ids FROM b)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, array_to_string(ids[1:40], ',') AS head, CAST(list_sum(ids) AS BIGINT) AS total, true AS same FROM i""")
def u14_ids_and_labels(spark, sf_dir):
    """Rows of a tokenizer whose ids are the bytes, cut at {_MOST}; labels are the ids."""
    rows = token_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", None, _MOST)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n"), F.array_join(F.slice("ids", 1, 40), ",").alias("head"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), (F.col("ids") == F.col("labels")).alias("same"))


@query()
def u14_token_rows(spark, sf_dir):
    """The same with a vocabulary's file."""
    import public_tokenizers

    rows = token_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", public_tokenizers.path("word_bpe_49k.json"), _MOST)
    return rows.select("doc_id", "ids", "labels")


simple("u15_masked_labels", "embeddings", {"labels": (lambda: F.array_join(P.masked_labels(_ids(), F.array(L(1), L(2))), ","), f"array_to_string(list_transform({_IDS}, lambda x, i: CASE WHEN i <= (CASE WHEN vec_id % 9 = 8 THEN 13 WHEN vec_id % 9 >= 3 THEN 8 ELSE 3 END) THEN -100 ELSE x END), ',')")}, None, "vec_id")
simple("u28_shifted_targets", "embeddings", {"targets": (lambda: F.array_join(P.shifted_targets(_ids()), ","), f"array_to_string(list_concat(list_concat({_IDS}, {_IDS})[2:], [-100]), ',')")}, None, "vec_id")
simple("u31_padded", "embeddings", {"ids": (lambda: F.array_join(P.padded(_ids(), 8, 0), ","), f"array_to_string(list_concat({_IDS}, [0, 0, 0, 0, 0, 0, 0, 0])[1:8], ',')")}, None, "vec_id")
