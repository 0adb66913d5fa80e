"""Plain text of wiki markup, by one pass with one stack over templates, links, tables and tags."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tags whose content isn't text, tags that stand alone, and what links to files and categories begin with.
HIDDEN = {"ref", "references", "gallery", "imagemap", "math", "score", "timeline", "includeonly", "categorytree", "templatestyles"}
ALONE = {"br", "hr", "wbr", "img"}
FILES = {"file", "image", "文件", "图像", "檔案"}
CATEGORIES = {"category", "分类", "分類"}

_TOKEN = re.compile(
    r"(?s)(?P<comment><!--.*?(?:-->|\Z))|(?P<nowiki><nowiki>(?P<raw>.*?)</nowiki>)|(?P<tag></?(?P<name>[A-Za-z][A-Za-z0-9]*)\b[^<>]*?(?P<own>/?)>)"
    r"|(?P<table>^[ \t:]*\{\|[^\n]*)|(?P<end>^[ \t]*\|\}(?!\}))|(?P<row>^[ \t]*\|[-+][^\n|]*)|(?P<cell>^[ \t]*[|!])|(?P<next>\|\||!!)"
    r"|(?P<open>\{\{|\[\[)|(?P<close>\}\}|\]\])|(?P<outer>\[(?=(?:https?:)?//))|(?P<shut>\])|(?P<pipe>\|)"
    r"|(?P<heading>^=+[ \t]*(?=\S)|(?<=\S)[ \t]*=+[ \t]*$)|(?P<list>^[*#:;]+[ \t]*)|(?P<quotes>'{2,5})",
    re.M,
)


class _Frame:
    """What has been opened: its kind, the markup that opened it, and its parts, each a list of pieces."""

    def __init__(self, kind: str, opened: str = ""):
        self.kind, self.opened, self.parts, self.attributes = kind, opened, [[]], False

    def put(self, piece: str) -> None:
        self.parts[-1].append(piece)

    def texts(self) -> list[str]:
        return ["".join(p) for p in self.parts]


def _link(frame: _Frame) -> str:
    target, *labels = frame.texts()
    space = target.lstrip(" :").partition(":")[0].strip().lower()
    if space in CATEGORIES and not target.lstrip().startswith(":"):
        return ""
    if space in FILES:  # of a file's options the last is its caption
        return labels[-1] if labels else ""
    return "|".join(labels) if labels else target.lstrip(":")


def plain_of(text: str | None) -> str | None:
    """Text without markup.

    Templates, comments and notes go, links become their labels, files their captions, tables their cells (one a line), other tags their content, and headings,
    lists, bold and italic lose their marks, at any depth within each other.  What nothing closes stays as it is written.
    """
    if text is None:
        return None
    stack, at = [_Frame("text")], 0
    open_: dict[str, int] = {}

    def begin(kind: str, opened: str) -> None:
        stack.append(_Frame(kind, opened))
        open_[kind] = open_.get(kind, 0) + 1

    def undo() -> None:
        """The top frame was none: its markup and parts are text of the one below."""
        frame = stack.pop()
        open_[frame.kind] -= 1
        stack[-1].put(frame.opened + ("\n" if frame.kind == "table" else "|").join(frame.texts()))

    def finish(kind: str) -> _Frame | None:
        """The nearest frame of the kind, taken off; those above it were never closed."""
        if not open_.get(kind):
            return None
        while stack[-1].kind != kind:
            undo()
        open_[kind] -= 1
        return stack.pop()

    for m in _TOKEN.finditer(text):
        stack[-1].put(text[at : m.start()])
        at, kind, said = m.end(), m.lastgroup, m.group()
        kind = next(k for k in ("comment", "nowiki", "tag", "table", "end", "row", "cell", "next", "open", "close", "outer", "shut", "pipe", "heading", "list", "quotes") if m.group(k) is not None)
        top = stack[-1]
        if kind in ("comment", "heading", "list", "quotes"):
            if kind == "heading" and top.kind != "text":
                top.put(said)
            continue
        if kind == "nowiki":
            top.put(m["raw"])
        elif kind == "tag":
            name = m["name"].lower()
            if m["own"] or name in ALONE:
                top.put("\n" if name == "br" else "")
            elif not said.startswith("</"):
                begin(f"<{name}", said)
            elif frame := finish(f"<{name}"):
                stack[-1].put("" if name in HIDDEN else "|".join(frame.texts()))
        elif kind == "table":
            begin("table", said)
        elif kind == "end":
            if frame := finish("table"):
                cells = [c.strip() for c in frame.texts()]
                stack[-1].put("\n" + "\n".join(c for c in cells if c) + "\n")
            else:
                top.put(said)
        elif kind in ("row", "cell", "next"):
            if top.kind == "table":
                top.parts.append([])
                top.attributes = True
            elif kind == "next" or top.kind == "text":
                top.put(said)
            else:  # a line that begins with a pipe within a link or a template
                top.put(said[: said.index(said.strip()[0])])
                top.parts.append([said.strip()[1:]]) if said.strip()[0] == "|" else top.put(said.strip())
        elif kind == "open":
            begin(said, said)
        elif kind == "close":
            frame = finish("{{" if said == "}}" else "[[")
            if frame is None:
                top.put(said)
            elif said == "]]":
                stack[-1].put(_link(frame))
        elif kind == "outer":
            begin("[", said)
        elif kind == "shut":
            if top.kind == "[":
                label = "|".join(finish("[").texts()).partition(" ")[2]
                stack[-1].put(label)
            else:
                top.put(said)
        elif top.kind == "table":  # what stands before the first pipe of a cell are its attributes
            if top.attributes:
                top.parts[-1], top.attributes = [], False
            else:
                top.put(said)
        elif top.kind in ("[[", "{{"):
            top.parts.append([])
        else:
            top.put(said)
    stack[-1].put(text[at:])
    while len(stack) > 1:
        undo()
    out = html.unescape(stack[0].texts()[0])
    out = re.sub(r"[ \t\xa0]+", " ", out.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


@F.pandas_udf(StringType())
def plain(texts: pd.Series) -> pd.Series:
    return texts.map(plain_of)
