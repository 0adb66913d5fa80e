"""Rows of public datasets as chats: instructions, problems with tests, patches.

Each maker takes a DataFrame and the columns that are there, and returns it with ``text``; rows that lack what a
chat needs are left out.  Which of several names a dataset uses is settled when the plan is made;
which of several columns holds a value is settled row by row.  Prompts are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import parse as P
from tessera.functions import text as T

#: The names that datasets use for the same thing, first choice first.
PROBLEM, SOLUTION, LANGUAGE = ("problem", "instruction"), ("solution", "output", "answer"), ("lang", "language")
INSTRUCTION, OUTPUT = ("instruction", "problem", "prompt"), ("output", "solution", "answer")
RAW_CODE = ("text", "code", "content", "body")
MESSAGE = ("message", "commit_message", "subject", "instruction", "prompt", "issue", "title")
DIFF = ("diff", "patch", "changes", "git_diff")
#: What a text that passes for Python code holds, and how long it is at least.
CODE_MARKS, CODE_LEAST = ("def ", "class ", "import ", "from ", "return ", "if __name__ ==", "try:", "except ", "lambda "), 20

#: Prompts of this engine; {task}, {tests}, {code} and {entry} stand for the row's own.
TO_CODE = "Solve this task in Python. Answer with code alone.\n\n{task}\n"
WITH_TESTS = "Solve this task in Python so that the tests pass. Answer with code alone.\n\n{task}\n\nTests:\n{tests}\n"
NAMED = "Solve this task in Python. Answer with code alone; name the function {entry}.\n\n{task}\n"
COMPLETE = "Go on with this Python function. Answer with code alone.\n\n{code}"
PATCH = "Make this change. Answer with a unified diff alone.\n\n{task}\n"


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that are there to hold more than nothing; empty if none does."""
    have = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(""))


def filled(prompt: str, **values: Column) -> Column:
    """The prompt with its marks replaced, in the order given."""
    c = F.lit(prompt)
    for name, value in values.items():
        c = F.replace(c, F.lit("{" + name + "}"), value)
    return c


def passes_for_code(c: Column) -> Column:
    marks = F.lit(False)
    for m in CODE_MARKS:
        marks = marks | F.contains(c, F.lit(m))
    return (F.length(T.strip(c)) >= CODE_LEAST) & marks


def python_or_unnamed(lang: Column) -> Column:
    return (F.coalesce(lang, F.lit("")) == "") | F.contains(F.lower(lang), F.lit("python"))


def code_of(c: Column, most: int) -> Column:
    """The code of an answer, at most so many characters."""
    return P.trimmed_code(T.code_only(c), most)


def _chats(df: DataFrame, user: Column, assistant: Column, fits: Column) -> DataFrame:
    return df.filter(fits).withColumn("text", T.chat(user, assistant))


def problems(df: DataFrame, most: int = 6000, prompt: str = TO_CODE) -> DataFrame:
    """Problem and solution, of Python or of no named language."""
    task, answer, lang = (first_of(df, n) for n in (PROBLEM, SOLUTION, LANGUAGE))
    code = code_of(answer, most)
    fits = (task != "") & (answer != "") & python_or_unnamed(lang) & passes_for_code(code)
    return _chats(df, filled(prompt, task=task), code, fits)


def instructions(df: DataFrame, most: int = 6000, prompt: str = TO_CODE, raw: str | None = None) -> DataFrame:
    """Instruction and output; with ``raw``, a prompt, rows without them but with bare code are shown as answers to it."""
    task, answer = first_of(df, INSTRUCTION), first_of(df, OUTPUT)
    code = code_of(answer, most)
    both = (task != "") & (answer != "") & passes_for_code(code)
    if raw is None:
        return _chats(df, filled(prompt, task=task), code, both)
    bare = code_of(first_of(df, RAW_CODE), most)
    return _chats(df, F.when(both, filled(prompt, task=task)).otherwise(raw), F.when(both, code).otherwise(bare), both | passes_for_code(bare))


def tested_problems(df: DataFrame, task: str = "text", code: str = "code", tests: str = "test_list", first: int = 5, most: int = 6000, prompt: str = WITH_TESTS) -> DataFrame:
    """A problem with its first tests, and code that passes for such."""
    answer = code_of(F.coalesce(code, F.lit("")), most)
    shown = F.array_join(F.slice(F.coalesce(F.col(tests), F.array().cast("array<string>")), 1, first), "\n")
    return _chats(df, filled(prompt, task=F.coalesce(task, F.lit("")), tests=shown), T.strip(answer), (F.coalesce(task, F.lit("")) != "") & passes_for_code(answer))


def named_problems(df: DataFrame, task: str = "text", code: str = "code", tests: str = "test_list", most: int = 6000, prompt: str = NAMED) -> DataFrame:
    """A problem and the name that its tests call, or its own words give, if there is one."""
    answer = code_of(F.coalesce(code, F.lit("")), most)
    wanted = F.coalesce(task, F.lit(""))
    entry = P.entry_point(F.array_join(F.coalesce(F.col(tests), F.array().cast("array<string>")), "\n"), wanted)
    user = F.when(entry.isNull(), filled(TO_CODE, task=wanted)).otherwise(filled(prompt, task=wanted, entry=entry))
    return _chats(df, user, answer, (wanted != "") & passes_for_code(answer))


def continuations(df: DataFrame, head: str = "prompt", rest: str = "canonical_solution", prompt: str = COMPLETE) -> DataFrame:
    return _chats(df, filled(prompt, code=F.col(head)), T.strip(F.col(rest)), F.col(head).isNotNull() & F.col(rest).isNotNull())


def patches(df: DataFrame, shown: int = 200, prompt: str = PATCH, strict: bool = False) -> DataFrame:
    """A change in words, cut at ``shown`` characters, and its diff; ``strict``: only what looks like a diff, words uncut and needed."""
    words, diff = first_of(df, MESSAGE), T.strip(first_of(df, DIFF))
    if strict:
        return _chats(df, words, F.concat(diff, F.lit("\n")), (words != "") & (F.contains(diff, F.lit("diff --git")) | diff.startswith("---")))
    return _chats(df, filled(prompt, task=T.truncated(words, shown, " ...")), diff, diff != "")


def private_chats(df: DataFrame, most: int, least: int) -> DataFrame:
    """User and assistant, each cut at ``most`` characters; neither empty, ``least`` characters together."""
    user, assistant = (F.substring(F.coalesce(c, F.lit("")), 1, most) for c in ("user", "assistant"))
    out = _chats(df, user, assistant, (user != "") & (assistant != ""))
    return out.filter(F.length("text") >= least)


def plain_texts(df: DataFrame, candidates: tuple[str, ...] = ("content", "text", "code", "prompt", "completion", "instruction", "output")) -> DataFrame:
    """``text``: prompt with completion, instruction with output, or the first candidate that isn't blank; rows without are left out."""

    def both(a: str, b: str) -> Column:
        x, y = first_of(df, (a,)), first_of(df, (b,))
        return F.when((x != "") & (y != ""), F.concat(x, F.lit("\n"), y))

    plain = [F.col(f"`{c}`").cast("string") for c in candidates if c in df.columns]
    return df.withColumn("text", F.coalesce(both("prompt", "completion"), both("instruction", "output"), *([T.first_not_blank(*plain)] if plain else []))).filter("text is not null")


def local_texts(df: DataFrame) -> DataFrame:
    """``text``: content, else text, else as ``plain_texts``."""
    own = [F.col(f"`{c}`").cast("string") for c in ("content", "text") if c in df.columns]
    held = df.withColumn("__own", T.first_not_blank(*own) if own else F.lit(None).cast("string"))
    return plain_texts(held, ("__own", "code", "prompt", "completion", "instruction", "output")).withColumn("text", F.coalesce("__own", "text")).drop("__own")


def task_sentence(name: Column, kind: Column, signature: Column, docstring: Column, path: Column) -> Column:
    """One sentence that asks for a function or class, from its signature and the first line of its docstring."""
    line = F.rtrim(T.strip(F.substring_index(T.strip(docstring), "\n", 1)), F.lit("."))
    low = F.concat(F.lower(F.substring(line, 1, 1)), F.substr(line, F.lit(2)))
    does = F.when(low.startswith("return "), F.concat(F.lit("returns "), F.substr(low, F.lit(8)))).otherwise(low)
    purpose = F.when(F.coalesce(line, F.lit("")) != "", F.concat(F.lit("; it "), does)).otherwise(F.concat(F.lit("; see `"), path, F.lit("`")))
    signed = F.when(F.coalesce(signature, F.lit("")) != "", F.concat(F.lit(", `"), signature, F.lit("`"))).otherwise("")
    return F.concat(F.lit("Write the Python "), F.when(kind == "class", "class").otherwise("function"), F.lit(" `"), name, F.lit("`"), signed, purpose, F.lit("."))
