"""Functions that must parse Python source; Arrow-batched, since the JVM has no such parser."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.formats import CODE_LEAST, CODE_MARKS

#: What a package must not import, call or reach for.
BANNED_IMPORTS = ("pty", "subprocess", "shlex", "socket")
BANNED_CALLS = ("eval", "exec", "__import__", "open")
BANNED_ATTRIBUTES = ("system", "popen", "remove", "rmdir", "chmod", "chown", "fork", "rmtree")
FUNCTIONS = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("name", T.StringType()), ("qualname", T.StringType()), ("class_name", T.StringType()), ("start_line", T.IntegerType()), ("body_line", T.IntegerType()), ("end_line", T.IntegerType()), ("body_lines", T.IntegerType()), ("docstring", T.StringType()), ("doc_end", T.IntegerType()))]))
DEFINITIONS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "signature", "decorators", "docstring")]))
#: The lines of a function at which a completion may begin.
CUTS = T.ArrayType(T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("lines", T.ArrayType(T.IntegerType()))]))


def violations_of(source: str) -> list[str]:
    """What in a file is banned, each once, sorted; source that doesn't parse is a violation."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return ["syntax error"]
    found = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Attribute):
            found |= {f"attribute {node.attr}"} if node.attr in BANNED_ATTRIBUTES else set()
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else None
            found |= {f"call {name}"} if name in BANNED_CALLS else set()
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names]
            found |= {f"import {n}" for n in names if n.split(".")[0] in BANNED_IMPORTS}
    return sorted(found)


def valid_code_text_of(text: str | None, least: int = 32, block: int = 20) -> bool:
    """Whether a text has ``least`` characters and its fenced blocks of ``block`` or more parse; without
    fences, whether it parses if it passes for code."""
    if text is None or len(text) < least:
        return False
    blocks = re.findall(r"(?si)```(?:python)?\s*(.*?)```", text)
    if not blocks:
        return not passes_for_code_of(text) or parses_of(text)
    return all(parses_of(b.strip()) for b in blocks if len(b.strip()) >= block)


def passes_for_code_of(text: str) -> bool:
    return len(text.strip()) >= CODE_LEAST and any(m in text for m in CODE_MARKS)


def parses_of(source: str | None) -> bool:
    try:
        ast.parse(source)
        return True
    except (SyntaxError, ValueError, TypeError, RecursionError):
        return False


def functions_of(source: str, least: int = 5) -> list[dict]:
    """Functions and methods with ``least`` body lines or more, methods under their class's name.

    body_line and doc_end are the first line of the body and the last of the docstring, which is the body's first.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    owned = [(n, c.name) for c in tree.body if isinstance(c, ast.ClassDef) for n in c.body]
    out = []
    for node, owner in [(n, None) for n in tree.body] + owned:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            lines = node.end_lineno - node.body[0].lineno + 1
            if lines >= least:
                doc = ast.get_docstring(node)
                out.append({"name": node.name, "qualname": f"{owner}.{node.name}" if owner else node.name, "class_name": owner, "start_line": min([node.lineno, *(d.lineno for d in node.decorator_list)]), "body_line": node.body[0].lineno, "end_line": node.end_lineno, "body_lines": lines, "docstring": doc, "doc_end": None if doc is None else node.body[0].end_lineno})
    return out


def definitions_of(source: str) -> list[dict]:
    """Top-level functions and classes: kind, name, signature as it would be written, decorators and docstring."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            kind, head = "class", f"class {node.name}" + (f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else "")
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "function"
            head = ("async " if isinstance(node, ast.AsyncFunctionDef) else "") + f"def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        else:
            continue
        out.append({"kind": kind, "name": node.name, "signature": head, "decorators": " ".join("@" + ast.unparse(d) for d in node.decorator_list), "docstring": ast.get_docstring(node)})
    return out


def cuts_of(source: str, least: int = 12) -> list[dict]:
    """For functions of ``least`` lines and two statements or more, where the statements from 30 to 80 % begin."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and len(node.body) > 1 and node.end_lineno - node.lineno + 1 >= least:
            first = max(1, int(len(node.body) * 0.3))
            last = max(first + 1, int(len(node.body) * 0.8))
            out.append({"start_line": node.lineno, "lines": [x.lineno for x in node.body[first:last]]})
    return out


def main_lines_of(source: str) -> list[int] | None:
    """First and last line of the block that runs when the file is the program."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    for node in tree.body:
        if isinstance(node, ast.If) and "__name__" in (test := ast.unparse(node.test)) and "__main__" in test:
            return [node.lineno, node.end_lineno]
    return None


def outline_of(source: str) -> str:
    """Top-level functions and classes with their methods, each with the names of its positional arguments."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return f"# cannot be outlined: {e}"

    def line(node, indent: str) -> str:
        return f"{indent}def {node.name}({', '.join(a.arg for a in node.args.args)}): ..."

    out = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef):
            out.append(line(node, ""))
        elif isinstance(node, ast.ClassDef):
            out.append(f"class {node.name}:")
            out += [line(n, "    ") for n in node.body if isinstance(n, ast.FunctionDef)]
    return "\n".join(out) or "# nothing to outline"


def snippets_of(source: str, marked: list[int], window: int = 5) -> str:
    """Numbered lines up to ``window`` from a marked one; ranges that meet are one, others stand apart."""
    lines = source.split("\n")
    shown = sorted({i for m in marked for i in range(max(1, m - window), min(len(lines), m + window) + 1)})
    out = []
    for before, i in zip([None, *shown], shown):
        if before is not None and i > before + 1:
            out.append("...")
        out.append(f"{'>>' if i in marked else '  '} {i:4d} | {lines[i - 1]}")
    return "\n".join(out)


def error_context_of(source: str, message: str = "", window: int = 5) -> str:
    """The lines that a message names or where the source fails to parse, with those around them."""
    marked = {int(n) for n in re.findall(r"line (\d+)", message)}
    try:
        ast.parse(source)
    except SyntaxError as e:
        if e.lineno:
            marked.add(e.lineno)
            message = message or f"SyntaxError: {e.msg} at line {e.lineno}"
    except (ValueError, RecursionError):
        pass
    if not marked:
        return f"{message}\n(it names no line)" if message else "The source parses."
    return f"{message}\n\nLines:\n{snippets_of(source, sorted(marked), window)}"


def debug_prompt_of(trace: str, files: dict[str, str], window: int = 15) -> str:
    """A traceback, then an outline and the marked lines of each file in it that is one of ``files``."""
    places: dict[str, list[int]] = {}
    for path, n in re.findall(r'File "([^"]+)", line (\d+)', trace):
        if path in files:
            places.setdefault(path, []).append(int(n))
    parts = [f"Traceback:\n{trace.strip()}"]
    for path, marked in places.items():
        parts.append(f"File: {path}\n\nOutline:\n{outline_of(files[path])}\n\nLines:\n{snippets_of(files[path], marked, window)}")
    return "\n\n".join(parts)


@F.pandas_udf(T.BooleanType())
def parses(source: pd.Series) -> pd.Series:
    return source.map(parses_of)


@F.pandas_udf(T.BooleanType())
def valid_code_text(text: pd.Series) -> pd.Series:
    return text.map(valid_code_text_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def violations(source: pd.Series) -> pd.Series:
    return source.map(lambda x: violations_of(x or ""))


@F.pandas_udf(FUNCTIONS)
def functions(source: pd.Series) -> pd.Series:
    return source.map(lambda x: functions_of(x or ""))


@F.pandas_udf(DEFINITIONS)
def definitions(source: pd.Series) -> pd.Series:
    return source.map(lambda x: definitions_of(x or ""))


@F.pandas_udf(T.StringType())
def debug_prompt(trace: pd.Series, files: pd.Series) -> pd.Series:
    return pd.Series([debug_prompt_of(t or "", dict(f or {})) for t, f in zip(trace, files, strict=True)])


@F.pandas_udf(CUTS)
def cuts(source: pd.Series) -> pd.Series:
    return source.map(lambda x: cuts_of(x or ""))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def main_lines(source: pd.Series) -> pd.Series:
    return source.map(lambda x: main_lines_of(x or ""))


@F.pandas_udf(T.StringType())
def outline(source: pd.Series) -> pd.Series:
    return source.map(lambda x: outline_of(x or ""))


@F.pandas_udf(T.StringType())
def error_context(source: pd.Series, message: pd.Series) -> pd.Series:
    return pd.Series([error_context_of(s or "", m or "") for s, m in zip(source, message, strict=True)])
