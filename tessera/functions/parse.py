"""Column expressions that take apart generated text, logs, specifications and chats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import answer_reward, gsm_answer, strip

#: Marks of a reasoning answer.
THOUGHT, THOUGHT_END, SOLUTION, SOLUTION_END = "<start_working_out>", "<end_working_out>", "<SOLUTION>", "</SOLUTION>"
#: Imported names whose package is called otherwise.
PACKAGES = {"sklearn": "scikit-learn", "PIL": "Pillow", "cv2": "opencv-python", "yaml": "PyYAML", "bs4": "beautifulsoup4", "dotenv": "python-dotenv", "dateutil": "python-dateutil"}
#: What a text must mention for a capability, in order.
CAPABILITIES = {"analy": "data_analysis", "monitor": "system_monitoring", "geo": "geospatial_processing", "plot": "visualization", "chart": "visualization", "query": "query_execution", "calc": "numerical_computation", "forecast": "forecasting", "clean": "data_cleaning", "json": "json_processing"}
#: What a message must mention for a failure mode, in order.
FAILURES = {"dependency installation failed": "missing_dependency", "execution failed": "runtime_error", "timed out": "timeout", "not valid json": "invalid_output_format", "security block": "security_restriction"}


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def generated_code(c: Column) -> Column:
    """A Python fence, any fence, what follows the first line of code, or all."""
    return F.coalesce(_found(c, r"(?s)```(?:python|py)[ \t]*\n(.*?)```"), _found(c, r"(?s)```[^\n]*\n(.*?)```"), _found(c, r"(?ms)^((?:def |class |import |from |@).*)\z"), c)


def after_fence(c: Column) -> Column:
    """What stands in the first fence, which need not end."""
    inner = F.element_at(F.split(c, "```", -1), 2)
    return F.when(F.contains(c, F.lit("```")), strip(F.regexp_replace(inner, r"^(?:python|py)\n", ""))).otherwise(strip(c))


def trimmed_code(c: Column, n: int) -> Column:
    return F.concat(F.rtrim(F.substring(c, 1, n), F.lit(" \t\n\x0b\x0c\r")), F.lit("\n"))


def repo_slug(url: Column) -> Column:
    """owner__repo, or twelve digits of the address's digest."""
    owner, repo = (F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)/([^/?#]+)", g) for g in (1, 2))
    return F.when(owner != "", F.concat(owner, F.lit("__"), F.regexp_replace(repo, r"\.git$", ""))).otherwise(F.left(F.sha1(url.cast("binary")), F.lit(12)))


def entry_point(tests: Column, problem: Column) -> Column:
    return F.coalesce(_found(tests, r"assert\s+(\w+)\s*\("), _found(problem, r"function\s+(\w+)"), _found(problem, r"named\s+(\w+)"))


def chat_turns(c: Column) -> Column:
    """Array of (role, content) of a chat with USER:, ASSISTANT: and FUNCTION RESPONSE: marks."""
    parts = F.split(F.regexp_replace(c, "(USER:|ASSISTANT:|FUNCTION RESPONSE:)", "\x01$1"), "\x01", -1)
    role = lambda p: F.when(p.startswith("USER:"), "user").when(p.startswith("ASSISTANT:"), "assistant").when(p.startswith("FUNCTION RESPONSE:"), "tool")
    body = lambda p: strip(F.regexp_replace(F.regexp_replace(p, "^(USER:|ASSISTANT:|FUNCTION RESPONSE:)", ""), r"(?s)<functioncall>\s*(\{.*?\})\s*", "<tool_call>$1</tool_call>"))
    turns = F.transform(parts, lambda p: F.struct(role(p).alias("role"), body(p).alias("content")))
    return F.filter(turns, lambda t: t["role"].isNotNull() & (t["content"] != ""))


def chatml(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("user")), F.lit("\n"), F.coalesce(t["content"], F.lit("")), F.lit("<|im_end|>"))
    return F.array_join(F.transform(turns, one), "\n")


#: What the system says in a chat about a problem.
TUTOR = "You teach mathematics. Work the problem out one step at a time; a short check in Python is welcome."


def problem_chat(question: Column, answer: Column, system: str = TUTOR) -> Column:
    """A chat of system, question and worked answer, without the line of the final result; null if question or answer is blank."""
    question, answer = strip(question), strip(answer)
    body = strip(gsm_answer(answer))
    turns = F.array(*[F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in (("system", F.lit(system)), ("user", question), ("assistant", body))])
    return F.when((question != "") & (answer != ""), chatml(turns))


def reasoning_row(thoughts: Column, answer: Column) -> Column:
    plain = strip(F.regexp_replace(thoughts, "</?think>", ""))
    return F.concat(F.lit(THOUGHT), plain, F.lit(THOUGHT_END + SOLUTION), answer, F.lit(SOLUTION_END))


def solution(c: Column) -> Column:
    """What the completion gives as its solution; null without all the marks."""
    return _found(c, f"(?s){THOUGHT_END}.*?{SOLUTION}(.+?){SOLUTION_END}")


def format_reward(c: Column) -> Column:
    return F.when(solution(c).isNotNull(), 3.0).otherwise(0.0)


def marks_reward(c: Column) -> Column:
    one = lambda mark: F.when(F.regexp_count(c, F.lit(mark)) == 1, 0.5).otherwise(-1.0)
    return one(THOUGHT_END) + one(SOLUTION) + one(SOLUTION_END)


def solution_reward(c: Column, answer: Column) -> Column:
    return answer_reward(solution(c), answer)


def number_reward(c: Column, answer: Column) -> Column:
    """-2.5 without a number, 0 if one side can't be read, 3.5 if equal, else -1.5."""
    text = _found(c, rf"(?s){SOLUTION}.*?\s*(-?[0-9.,]+)")
    guess, want = F.replace(text, F.lit(","), F.lit("")).try_cast("double"), strip(answer).try_cast("double")
    return F.when(text.isNull(), -2.5).when(guess.isNull() | want.isNull(), 0.0).when(guess == want, 3.5).otherwise(-1.5)


def repeated_to(seed: str, tokens: Column) -> Column:
    """``seed`` again and again, until four characters a token are reached."""
    return F.repeat(F.lit(seed), F.ceil(tokens * 4 / len(seed)).cast("int"))


def passkey_context(tokens: Column, passkey: Column, depth: Column, filler: str = "The sun sets in the west. ") -> Column:
    """Fillers with the passkey's line among them; it is laid between whole fillers and the two parts of one, so no long text is walked through."""
    times = F.ceil(F.greatest(F.lit(64), tokens) * 4 / len(filler))
    at = F.floor(times * len(filler) * F.greatest(F.lit(0.0), F.least(depth, F.lit(1.0))))
    before, cut = F.floor(at / len(filler)), (at % len(filler)).cast("int")
    needle = F.concat(F.lit("\nThe secret passkey is "), passkey.cast("string"), F.lit(".\n"))
    tail = F.when(cut > 0, F.substring(F.lit(filler), cut + 1, F.lit(len(filler)))).otherwise("")
    after = times - before - F.when(cut > 0, 1).otherwise(0)
    return F.concat(F.repeat(F.lit(filler), before.cast("int")), F.left(F.lit(filler), cut), needle, tail, F.repeat(F.lit(filler), after.cast("int")))


def pass_score(log: Column, nth: int) -> Column:
    """The nth pass@1 of a log, in per cent."""
    x = F.try_element_at(F.regexp_extract_all(log, F.lit(r"pass@1:\s*([0-9.]+)"), F.lit(1)), F.lit(nth)).try_cast("double")
    return F.when(x <= 1, x * 100).otherwise(x)


def positive_ints(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ",", -1), lambda x: F.trim(x).try_cast("long")), lambda x: x > 0)


def assignments(c: Column) -> Column:
    """Map of k=v,k=v."""
    return F.str_to_map(c, F.lit(","), F.lit("="))


def _tags(c: Column, rules: dict[str, str]) -> list[Column]:
    marks: dict[str, list[str]] = {}
    for mark, tag in rules.items():
        marks.setdefault(tag, []).append(mark)
    any_of = lambda ms: F.greatest(F.lit(False), *[F.contains(F.lower(c), F.lit(m)) for m in ms])
    return [F.when(any_of(ms), tag) for tag, ms in marks.items()]


def capabilities(text: Column, entrypoint: Column) -> Column:
    """At most eight tags; a package with an entry point is a script."""
    tags = F.array_compact(F.array(*_tags(text, CAPABILITIES), F.when(F.length(entrypoint) > 0, "script_execution")))
    return F.when(F.size(tags) == 0, F.array(F.lit("general_automation"))).otherwise(F.slice(tags, 1, 8))


def failure_modes(message: Column) -> Column:
    tags = F.array_compact(F.array(*_tags(message, FAILURES)))
    return F.when(F.length(F.coalesce(message, F.lit(""))) == 0, F.slice(tags, 1, 0)).when(F.size(tags) == 0, F.array(F.lit("sandbox_issue"))).otherwise(tags)


def trace_places(c: Column) -> Column:
    """Array of (file, line) of a traceback."""
    pattern = F.lit(r'File "([^"]+)", line (\d+)')
    files, lines = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    return F.zip_with(files, lines, lambda f, n: F.struct(f.alias("file"), n.cast("long").alias("line")))


def missing_package(c: Column) -> Column:
    name = F.coalesce(_found(c, r"ModuleNotFoundError: No module named '(.+?)'"), _found(c, r"ImportError: No module named '(.+?)'"))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PACKAGES.items() for x in kv])[name], name)


def model_spec(c: Column) -> tuple[Column, Column]:
    """(kind, name) of openai:name, a directory or a hub id."""
    kind = F.when(c.startswith("openai:"), "openai").when(c.startswith("/"), "local").otherwise("hub")
    return kind, F.when(c.startswith("openai:"), F.substring(c, 8, 1 << 20)).otherwise(F.substring_index(F.rtrim(c, F.lit("/")), "/", -1))


def busy(metrics: Column, gauges: tuple[str, ...], limit: float) -> Column:
    """Whether a gauge of a metrics page stands at ``limit`` or more."""
    fits = lambda x: F.greatest(F.lit(False), *[x.startswith(g) for g in gauges])
    value = lambda x: F.element_at(F.split(F.trim(x), r"\s+"), -1).try_cast("double")
    return F.exists(F.split(metrics, "\n", -1), lambda x: fits(x) & F.coalesce(value(x) >= limit, F.lit(False)))


def diff_paths(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^\+\+\+ b/(\S+)"), F.lit(1))))


def changed_lines(c: Column) -> Column:
    return (F.regexp_count(c, F.lit(r"(?m)^[+-]")) - F.regexp_count(c, F.lit(r"(?m)^(?:\+\+\+|---)"))).cast("long")


def import_lines(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n", -1), lambda x: strip(x))
    return F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.startswith("import ") | x.startswith("from "))))


def lexical_score(pattern: Column, insight: Column, query: str, hit: int = 5, most: int = 5) -> Column:
    """``hit`` if the pattern stands in the query, and up to ``most`` for distinct words of the insight in it."""
    q = F.lit(query.lower())
    words = F.array_distinct(F.regexp_extract_all(F.lower(insight), F.lit("[a-zA-Z0-9_]{3,}"), F.lit(0)))
    return F.when((pattern != "") & F.contains(q, F.lower(pattern)), hit).otherwise(0) + F.least(F.lit(most), F.size(F.filter(words, lambda w: F.contains(q, w))))


def masked_labels(ids: Column, template: Column) -> Column:
    """Ids with all up to the end of the last template replaced by -100; without it, all are."""
    k = F.size(template)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids) - k + 1, F.lit(1))), lambda i: F.slice(ids, i, k) == template)
    cut = F.coalesce(F.try_element_at(starts, F.lit(-1)) + k - 1, F.size(ids))
    return F.transform(ids, lambda x, i: F.when(i < cut, F.lit(-100)).otherwise(x))


def padded(ids: Column, n: int, pad: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), n)), 1, n)


def shifted_targets(ids: Column) -> Column:
    """A sequence twice, its next tokens, and -100 at the end."""
    twice = F.concat(ids, ids)
    return F.concat(F.slice(twice, F.lit(2), F.size(twice) - 1), F.array(F.lit(-100)))


def line_range(c: Column, first: int, last: int) -> Column:
    """Numbered lines first to last, as far as they exist."""
    lines = F.slice(F.split(c, "\n", -1), first, last - first + 1)
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def line_completion(c: Column, seed: str, key: Column, unit) -> tuple[Column, Column]:
    """Lines before and from a cut at 20 to 80 % that depends on seed and key."""
    lines = F.split(c, "\n", -1)
    n = F.size(lines)
    low, high = F.greatest(F.lit(1), F.floor(n * 0.2)), F.greatest(F.lit(1), F.floor(n * 0.8))
    cut = (low + F.floor(unit(seed, key) * (high - low + 1))).cast("int")
    return F.array_join(F.slice(lines, F.lit(1), cut), "\n"), F.array_join(F.slice(lines, cut + 1, n), "\n")
