"""Tasks made of Python files, outlines and error contexts."""

import ast

from tessera.functions import code as C
from tessera.operators import tasks as K

SOURCE = '''import json
from os import path


class Store:
    @property
    def names(self):
        """The names of all things that this store holds, sorted."""
        found = []
        for x in self.things:
            found.append(x.name)
        found.sort()
        return found


def load(where, *, deep=False):
    with open(where) as f:
        rows = json.load(f)
    out = []
    for row in rows:
        if row.get("skip"):
            continue
        out.append(row)
    if deep:
        out = [dict(x) for x in out]
    count = len(out)
    print("loaded", count, "rows from", path.basename(where))
    return out, count


if __name__ == "__main__":
    print(load("x.json"))
'''
TESTS = "import m\n\n\ndef test_load():\n    assert m.load('x.json')\n" + "# more\n" * 20


def files(spark):
    return spark.createDataFrame([("m.py", "s", SOURCE), ("test_m.py", "s", TESTS), ("bad.py", "s", "def ("), ("none.py", "s", None), ("empty.py", "s", "")], "path string, source string, content string")


def bodies(rows, column="assistant"):
    return [r[column].split("```python\n", 1)[1].rsplit("\n```", 1)[0] for r in rows]


def test_functions_are_shown_bare_and_wanted_whole(spark):
    rows = K.skeletons(files(spark)).collect()
    assert len(rows) == 2 and all("raise NotImplementedError" in r.user for r in rows)
    assert {b.split("def ")[1].split("(")[0] for b in bodies(rows)} == {"names", "load"}
    assert "    @property\n" in "".join(bodies(rows)) and any("class Store:" in r.user for r in rows)
    [row] = K.partial_files(files(spark)).collect()
    assert ast.parse(bodies([row], "user")[0]) and row.type == "partial_nav"


def test_docstrings_imports_mains(spark):
    [d] = K.docstrings(files(spark)).collect()
    assert "The names of" not in d.user and "The names of" in d.assistant
    [i] = K.imports(files(spark)).collect()
    assert "import json" not in i.user and bodies([i]) == ["from os import path\nimport json"]
    [m] = K.mains(files(spark)).collect()
    assert "__main__" not in m.user and bodies([m])[0].startswith("if __name__")


def test_cuts_lose_nothing(spark):
    [c] = K.completions(files(spark)).collect()
    whole = SOURCE[SOURCE.index("def load"): SOURCE.index("\n\n\nif __name__")]
    assert bodies([c], "user")[0] + "\n" + bodies([c])[0] == whole
    [p] = K.completion_pairs(files(spark)).collect()
    assert p.prefix + p.suffix == SOURCE and p.prefix.count("def load") == 1


def test_pairs_of_tests(spark):
    pairs = spark.createDataFrame([("m.py", "test_m.py"), ("m.py", "empty.py")], "path string, test_path string")
    [t] = K.test_files(files(spark), pairs).collect()
    assert t.path == "m.py" and bodies([t]) == [TESTS.strip()]


def test_outline_and_errors(spark):
    assert C.outline_of(SOURCE) == "class Store:\n    def names(self): ...\ndef load(where): ..."
    assert C.outline_of("x = 1") == "# nothing to outline"
    assert C.outline_of("def (").startswith("# cannot")
    assert C.error_context_of("x = 1") == "The source parses."
    assert ">>    2 | y = (" in C.error_context_of("x = 1\ny = (\nz")
    far = C.snippets_of("\n".join("abcdefghijklmnopqrstuvwxyz"), [2, 4, 20], 1).split("\n")
    assert len(far) == 9 and far[5] == "..." and far[1] == ">>    2 | b"
    prompt = C.debug_prompt_of('File "m.py", line 17, in load\nFile "/lib/x.py", line 3', {"m.py": SOURCE}, 1)
    assert ">>   17 |" in prompt and "x.py" not in prompt.split("Outline")[1]
    got = files(spark).select(C.outline("content").alias("o"), C.error_context("content", "path").alias("e")).collect()
    assert len(got) == 5


ODD = '''"""A module.

def not_a_function(): in its text
"""
from functools import (
    lru_cache,
    wraps,
)


def outer(a,
          b=(1,
             2)):
    # a comment before the first statement
    text = """def inner():
    not code
"""

    @wraps(a)
    def inner(*args):
        return a(*args)

    return inner, text


@lru_cache(
    maxsize=None,
)
async def fetch(url: str, *, tries: int = 3) -> "bytes":
    \'\'\'Fetch the address again and again until it
    answers, at most as often as told.\'\'\'
    for i in range(tries):
        if url:
            return b"" + \\
                b"x"
    async def again():
        return await fetch(url)
    return await again()


class Tabs(dict):
\t@staticmethod
\tdef many(x):
\t\t"""One line of nine words that tells what happens."""
\t\ty = x
\t\tz = [
\t\t\ty,
\t\t]
\t\tif z:
\t\t\treturn z
\t\treturn None
'''


def test_tasks_of_odd_grammar(spark):
    """Decorated, nested, async and tabbed functions, signatures and strings over several lines."""
    files_ = spark.createDataFrame([("odd.py", "s", ODD)], "path string, source string, content string")
    found = {f["qualname"]: f for f in C.functions_of(ODD)}
    assert set(found) == {"outer", "fetch", "Tabs.many"}
    lines = ODD.split("\n")
    whole = {n: "\n".join(lines[f["start_line"] - 1 : f["end_line"]]) for n, f in found.items()}
    assert whole["fetch"].startswith("@lru_cache(\n    maxsize") and whole["Tabs.many"].startswith("\t@staticmethod")
    rows = K.skeletons(files_, 9).collect()
    assert sorted(bodies(rows)) == sorted(whole.values())
    for r in K.partial_files(files_, 20).collect():
        shown = r.user.split("```python\n", 1)[1].split("\n```", 1)[0]
        assert "raise NotImplementedError" in shown and ast.parse(shown) and len(C.functions_of(shown, 1)) >= 2
    assert {r.assistant.split("\n")[1].split()[0] for r in K.docstrings(files_, 9).collect()} == {"Fetch", "One"}
    for r, bare in zip(rows := K.docstrings(files_, 9).collect(), [r.user.split("```python\n", 1)[1].rsplit("\n```", 1)[0] for r in rows], strict=True):
        assert "nine words" not in bare and "again and again" not in bare
    cut = K.completions(files_, 9).collect()
    for r in cut:
        head = r.user.split("```python\n", 1)[1].rsplit("\n```", 1)[0]
        assert head + "\n" + r.assistant.split("```python\n", 1)[1].rsplit("\n```", 1)[0] in set(whole.values())
    assert [d["name"] for d in C.definitions_of(ODD)] == ["outer", "fetch", "Tabs"]
    assert "async def fetch(url: str, *, tries: int=3) -> 'bytes'" == C.definitions_of(ODD)[1]["signature"]
    assert C.violations_of(ODD) == [] and C.valid_code_text_of("```python\n" + ODD + "```")
