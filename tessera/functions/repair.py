"""Functions that need a state machine: JSON repair, diffs, file blocks, message compression.

Plain Python on one value, and Arrow-batched columns of the same name with ``_column``.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructType

#: Fixed value: what stands where a message was cut.
CUT = "\n...[TRUNCATED TO FIT CONTEXT]...\n"


def _loads(text: str):
    try:
        return json.loads(text, strict=False)
    except (ValueError, RecursionError):
        return None


def balanced(text: str, start: int) -> tuple[int, list[str]]:
    """End of the JSON value that starts at ``start``, and the closers that it still lacks."""
    open_, quoted, skip = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
            if not open_:
                return i + 1, []
    return len(text), (['"'] if quoted else []) + open_[::-1]


def json_of(text: str | None) -> str | None:
    """Canonical JSON of the object or array in a model's reply, or null.

    Tried in turn: the whole reply without its thoughts, each fence, each balanced
    stretch, the same with unquoted keys quoted and trailing commas gone, and a
    truncated value with its closers added.
    """
    if text is None:
        return None
    text = re.sub(r"(?s)<think>.*?(?:</think>|\Z)", "", text).strip()
    candidates = [text, *re.findall(r"(?s)```(?:json)?[ \t]*\n(.*?)```", text)]
    first = re.search(r"[{\[]", text)
    if first:
        end, missing = balanced(text, first.start())
        candidates.append(text[first.start() : end] + "".join(missing))
    for c in candidates + [re.sub(r",\s*([}\]])", r"\1", re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', c)) for c in candidates]:
        got = _loads(c)
        if isinstance(got, (dict, list)):
            return json.dumps(got, sort_keys=True, ensure_ascii=False)
    return None


def arguments_of(text: str | None, tool: str = "") -> str | None:
    """Canonical JSON of a tool's arguments; a broken write_file gives path and content by pattern."""
    got = json_of(text)
    if got is None and text is not None and tool == "write_file":
        m = re.search(r'(?s)"path"\s*:\s*"([^"]+)".*?"content"\s*:\s*"(.*)"\s*\}?\s*\Z', text)
        if m:
            body = m.group(2).replace("\\n", "\n").replace('\\"', '"')
            got = json.dumps({"content": body, "path": m.group(1)}, ensure_ascii=False)
    return got


def diffs_of(text: str | None) -> list[str]:
    """Unified diffs in a reply: those in fences, else those that stand free."""
    text = text or ""
    fenced = [x for x in re.findall(r"(?s)```(?:diff|patch)?[ \t]*\n(.*?)```", text) if re.search(r"(?m)^(?:diff --git|--- |@@ )", x)]
    if not fenced:
        fenced = re.findall(r"(?ms)^(?:diff --git [^\n]*\n|--- [^\n]*\n\+\+\+ ).*?(?=^diff --git |\Z)", text)
    return [d for d in (tidy_diff(x) for x in fenced) if d]


def tidy_diff(text: str | None) -> str:
    """A diff without fences and index lines; hunks below a ``diff --git`` line get the headers that they lack."""
    out: list[str] = []
    pending: tuple[str, str] | None = None
    for line in (text or "").split("\n"):
        if line.startswith("```") or re.match(r"index [0-9a-f]+\.\.[0-9a-f]+", line):
            continue
        named = re.match(r"diff --git (a/\S+) (b/\S+)", line)
        if named:
            pending = named.groups()
        elif line.startswith("--- "):
            pending = None
        elif line.startswith("@@") and pending:
            out += [f"--- {pending[0]}", f"+++ {pending[1]}"]
            pending = None
        out.append(line)
    body = "\n".join(out).strip("\n")
    return body + "\n" if body else ""


def hunks_of(diff: str | None) -> list[tuple[list[str], list[str]]]:
    """The lines that each hunk expects and those that it leaves in their place; a line without a mark is context."""
    out: list[tuple[list[str], list[str]]] = []
    for part in re.split(r"(?m)^@@[^\n]*\n", diff or "")[1:]:
        body = re.split(r"(?m)^(?:diff --git |--- )", part)[0].removesuffix("\n").split("\n")
        marked = [(x[:1], x[1:]) if x[:1] in (" ", "+", "-") else (" ", x) for x in body if not x.startswith("\\")]
        out.append(([x for m, x in marked if m != "+"], [x for m, x in marked if m != "-"]))
    return out


def _stands(lines: list[str], block: list[str]) -> bool:
    have, want = [x.strip() for x in lines], [x.strip() for x in block]
    return any(have[i : i + len(want)] == want for i in range(len(have) - len(want) + 1))


def placed(lines: list[str], old: list[str], least: float = 0.5) -> tuple[int, int] | None:
    """Where the lines that a hunk expects stand: first line and number of lines.

    White space at the ends of lines doesn't count.  If they stand nowhere, the range between their
    first and last line (each found once) is taken, of at most twice their number; else the place where the
    largest share of them agrees, if that is ``least`` or more; of equals, the first.
    """
    have, want = [x.strip() for x in lines], [x.strip() for x in old]
    n = len(want)
    if not n:
        return (0, 0)
    last = len(have) - n
    for i in range(last + 1):
        if have[i : i + n] == want:
            return (i, n)
    if want[0] and want[-1] and have.count(want[0]) == 1 == have.count(want[-1]):
        i, k = have.index(want[0]), have.index(want[-1]) + 1
        if 0 < k - i <= 2 * n:
            return (i, k - i)
    agree = [sum(map(str.__eq__, have[i : i + n], want)) / n for i in range(last + 1)]
    best = max(agree, default=0.0)
    return (agree.index(best), n) if agree and best >= least else None


def patched(source: str | None, diff: str | None) -> tuple[str, int]:
    """The text with a diff's hunks put in, and the number of hunks that fit nowhere.

    A hunk whose outcome stands there already is left out.
    """
    lines, lost = (source or "").split("\n"), 0
    for old, new in hunks_of(diff):
        if old and new and _stands(lines, new):
            continue
        at = placed(lines, old)
        if at is None:
            lost += 1
        else:
            lines[at[0] : at[0] + at[1]] = new
    return "\n".join(lines), lost


def new_files_of(diff: str | None) -> dict[str, str]:
    """Contents of the files that a diff creates."""
    out: dict[str, str] = {}
    for part in re.split(r"(?m)^(?=--- )", diff or ""):
        named = re.match(r"--- /dev/null\n\+\+\+ (?:b/)?(\S+)\n", part)
        if named:
            lines = [x[1:] for x in part[named.end() :].split("\n") if x.startswith("+")]
            out[named.group(1)] = "\n".join(lines) + "\n"
    return out


def files_of(text: str | None) -> dict[str, str]:
    """Blocks below ``FILE: path`` marks, fences taken off; a path that comes again is appended."""
    out: dict[str, str] = {}
    parts = re.split(r"(?m)^(?:#+\s*)?FILE:\s*`?([^\s`]+)`?[ \t]*$", text or "")
    for path, body in zip(parts[1::2], parts[2::2], strict=True):
        inner = re.search(r"(?s)```[^\n]*\n(.*?)(?:```|\Z)", body)
        content = (inner.group(1) if inner else body).strip("\n") + "\n"
        out[path] = out[path] + content if path in out else content
    return out


#: What ends a block besides its own mark: the next block, a diff, a heading, a fence.
_NEXT = r"\n[^\n]*WRITE_FILE:|\ndiff --git|\n##\s|\n```"


def written_files_of(text: str | None, least: int = 15) -> list[tuple[str, str]]:
    """(path, content) of the blocks below ``WRITE_FILE: path`` and ``<<<CONTENT``, in order.

    A block ends at ``CONTENT>>`` or ``CONTENT>>>``, before what cannot be part of it, or with the text.  Closing tags of a
    tool's template at its end are left out, and blocks of removed lines, of diff paths and of fewer
    than ``least`` characters.
    """
    out = []
    for m in re.finditer(rf"(?s)(?:^|\n)(?!-)[^\n]*?WRITE_FILE:[ \t]*(\S+)[^\n]*\n\s*<<<CONTENT\n(.*?)(?:CONTENT>>>?|<<<CONTENT\s*\Z|(?={_NEXT})|\Z)", text or ""):
        path, body = m.group(1), re.sub(r"(?:\s*</\w+>)+\s*\Z", "", m.group(2).replace("CONTENT>>>", "").replace("<<<CONTENT", ""))
        if not path.startswith(("a/", "b/")) and path != "/dev/null" and len(body.strip()) >= least:
            out.append((path, body.rstrip() + "\n"))
    return out


def compressed(contents: list[str], tokens: int) -> list[str]:
    """Messages cut in the middle, the longest first, until four characters a token fit.

    The first two stay while any other can be cut.
    """
    out = list(contents)
    while sum(len(x) // 4 for x in out) > tokens:
        movable = [i for i in range(2, len(out)) if out[i]] or [i for i in range(1, len(out)) if out[i]]
        if not movable:
            break
        at = max(movable, key=lambda i: (len(out[i]), -i))
        keep = int(len(out[at]) * 0.45)
        if len(out[at]) < 400 or 2 * keep + len(CUT) >= len(out[at]):
            break
        out[at] = out[at][:keep] + CUT + out[at][-keep:]
    return out


def untemplated(text: str | None) -> str | None:
    """Wiki markup without its templates, however deep they stand in each other; braces that nothing closes stay."""
    if text is None:
        return None
    kept, at = [], 0
    for start, end in _outermost(text):
        kept.append(text[at:start])
        at = end
    return " ".join([*kept, text[at:]])


def _outermost(text: str) -> list[tuple[int, int]]:
    """Start and end of the closed templates that stand in no other closed one."""
    starts, spans = [], []
    for m in re.finditer(r"\{\{|\}\}", text):
        if m.group() == "{{":
            starts.append(m.start())
        elif starts:
            start = starts.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, m.end()))
    return spans


@F.pandas_udf(StringType())
def untemplated_column(texts: pd.Series) -> pd.Series:
    return texts.map(untemplated)


@F.pandas_udf(StringType())
def json_column(texts: pd.Series) -> pd.Series:
    return texts.map(json_of)


def arguments_column(tool: str):
    """Column function on the arguments of one tool."""

    @F.pandas_udf(StringType())
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: arguments_of(x, tool))

    return made


@F.pandas_udf(ArrayType(StringType()))
def diffs_column(texts: pd.Series) -> pd.Series:
    return texts.map(diffs_of)


@F.pandas_udf(MapType(StringType(), StringType()))
def files_column(texts: pd.Series) -> pd.Series:
    return texts.map(files_of)


@F.pandas_udf(ArrayType(StructType().add("path", StringType()).add("content", StringType())))
def written_files_column(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: [{"path": p, "content": c} for p, c in written_files_of(x)])


@F.pandas_udf(StringType())
def tidy_diff_column(texts: pd.Series) -> pd.Series:
    return texts.map(tidy_diff)


@F.pandas_udf(MapType(StringType(), StringType()))
def new_files_column(texts: pd.Series) -> pd.Series:
    return texts.map(new_files_of)


def compressed_column(tokens: int):
    """Column function on an array of contents; a conversation is one value."""

    @F.pandas_udf(ArrayType(StringType()))
    def made(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: None if x is None else compressed([c or "" for c in x], tokens))

    return made


@F.pandas_udf(StructType().add("text", StringType()).add("lost", IntegerType()))
def patched_column(sources: pd.Series, diffs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([patched(s, d) for s, d in zip(sources, diffs, strict=True)], columns=["text", "lost"])
