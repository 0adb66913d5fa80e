"""Queries of the wiki cleaner, on markup built around the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.base import SQL, simple
from tessera.plans.parsing import WHITE, cat, pick, sql_pick

#: Markup in pieces; names of columns stand in angle brackets.
_MARKUP = """{{Infobox|a={{lang|<lang>}}|b={{x|{{y}}}}}}
<!-- note
<doc_id> -->'''<source>''' [[File:x|<lang>]][[Kategorie:x]][[CATEGORY:<lang>]]
== <source> ==
* [[<lang>#part|  <source> ]] and [[ <source>#part]]
 :# [https://x.org/<doc_id>  <lang>] [https://y.org ]<br/>
<ref name="a"><lang>
</ref>b<ref name=b/>
{| class=x
| <lang>
|}
"""
_ENDS = ("\n== References ==\n* tail", "\n\n\n SEE also \nx", "\r\n== 参考文献 ==", "")


def _pieces() -> list[tuple[str, bool]]:
    """The markup's pieces, and whether each is a column."""
    out, rest = [], _MARKUP
    while rest:
        at = min((i for n in ("<lang>", "<doc_id>", "<source>") if (i := rest.find(n)) >= 0), default=len(rest))
        out.append((rest[:at], False))
        name, _, rest = rest[at + 1 :].partition(">") if at < len(rest) else ("", "", "")
        if name:
            out.append((name, True))
    return out


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


WIKI = " || ".join(f"CAST({p} AS VARCHAR)" if named else _quoted(p) for p, named in _pieces()) + " || text || " + sql_pick(4, *map(_quoted, _ENDS))


def wiki():
    return cat(*[F.col(p).cast("string") if named else p for p, named in _pieces()], F.col("text"), pick(4, *map(F.lit, _ENDS)))


#: The steps again, for the other engine: pattern, replacement, flags.
_STEPS = {
    "notes": [(r"<!--.*?-->", " ", "gs"), (r"<ref[^>/]*>.*?</ref>", " ", "gis"), (r"<ref[^>]*/>", " ", "gis"), (r"\{\|.*?\|\}", " ", "gs")],
    "files": [(r"\[\[(?:file|image|文件|图像|圖像):[^\]]*\]\]", " ", "gi"), (r"\[\[(?:category|分类|分類):[^\]]*\]\]", " ", "gi")],
    "templates": [(r"\{\{[^{}]*\}\}", " ", "g")] * 8,
    "headings": [(r"(?m)^=+[ \t]*([^=\n]+?)[ \t]*=+[ \t]*$", "\n\\1\n", "g")],
    "tags": [(r"<[^>]+>", " ", "gis")],
    "outer": [(r"\[https?://[^\s\]]+[ \t]+([^\]]+)\]", r"\1", "g"), (r"\[(https?://[^\s\]]+)[ \t]*\]", r"\1", "g")],
    "links": [(r"\[\[[^\]|]*\|[ \t]*([^\]]*?)[ \t]*\]\]", r"\1", "g"), (r"\[\[[ \t]*([^\]|#]*)(?:#[^\]|]*)?\]\]", r"\1", "g")],
    "quotes": [("'{2,}", "", "g")],
    "lists": [(r"(?m)^[ \t]*[*#:;]+[ \t]*", "", "g")],
    "spaces": [(r"\r\n?", "\n", "g"), (r"[ \t]+", " ", "g"), (r"\n{3,}", "\n\n", "g")],
}


def _replaced(c: str, *steps: str) -> str:
    for step in steps:
        for pattern, to, flags in _STEPS[step]:
            c = f"regexp_replace({c}, {_quoted(pattern)}, {_quoted(to)}, '{flags}')"
    return c


def _cut(c: str) -> str:
    """SQL of the lines of ``c``, a column, before the first title of a trailing section."""
    titles = ", ".join(f"'{t}'" for t in T.TRAILING_SECTIONS)
    first = f"list_position(list_transform(string_split({c}, chr(10)), lambda x: lower(trim(x, {WHITE})) IN ({titles})), true)"
    return f"CASE WHEN coalesce({first}, 0) > 0 THEN trim(array_to_string(string_split({c}, chr(10))[1:{first} - 1], chr(10)), {WHITE}) ELSE {c} END"


def _step(name: str, of: tuple, *steps: str) -> None:
    simple(name, "documents", {"plain": (lambda: T.replaced(wiki(), of), _replaced(WIKI, *steps))})


_step("t04_notes_and_tables", T.NOTES, "notes")
_step("t05_file_links", T.FILES, "files")
_step("t06_templates", T.TEMPLATES, "templates")
_step("t07_headings", T.HEADINGS, "headings")
_step("t09_outer_links", T.OUTER_LINKS, "outer")
_step("t10_links", T.LINKS, "links")
_step("t12_list_marks", T.LISTS, "lists")
simple("t24_newline_normalised", "documents", {"plain": (lambda: T.newlines(F.replace(wiki(), F.lit("=="), F.lit("\r"))), rf"regexp_replace(replace({WIKI}, '==', chr(13)), '\r\n?', chr(10), 'g')")})

_SECTIONS = ("\n  See Also\t\nx", "\nNotes\nSources", "\nNotes too")
_CUTS = "'a' || chr(10) || text || " + sql_pick(3, *[_quoted(x).replace("\t", "' || chr(9) || '") for x in _SECTIONS])
_ALL = ("notes", "files", "templates", "headings", "tags", "outer", "links", "quotes", "lists", "spaces")


def _trailing(name: str, made, sql: str) -> None:
    simple(name, "documents", {"plain": (made, "")})
    SQL[name] = f"SELECT doc_id, {_cut('c')} AS plain FROM (SELECT doc_id, {sql} AS c FROM documents)"


_trailing("t16_trailing_sections", lambda: T.cut_trailing(cat("a\n", F.col("text"), pick(3, *map(F.lit, _SECTIONS)))), _CUTS)
_trailing("t03_wikitext", lambda: T.clean_wikitext(wiki()), f"trim({_replaced(f'substr({WIKI}, 1, {T.MAX_WIKITEXT})', *_ALL)}, {WHITE})")

_REPLIES = ("Sure thing\n```python \n<>\n```\nbye", " Below is it:\n<>", "Why ```py\n<>```", "<>")
_REPLY = sql_pick(4, *[_quoted(r).replace("<>", "' || text || '") for r in _REPLIES])
_FENCE, _CHATTY = r"(?s)```(?:python|py)?[ \t]*\n(.*?)```", r"^\s*(?:Sure|Here's|Here is|Below is|Certainly|Absolutely)[^\n]*\n"
simple("t18_code_only", "documents", {"code": (lambda: T.code_only(pick(4, *[cat(*[x for p in r.split("<>") for x in (p, F.col("text"))][:-1]) for r in _REPLIES])), f"trim(coalesce(nullif(regexp_extract({_REPLY}, {_quoted(_FENCE)}, 1), ''), regexp_replace({_REPLY}, {_quoted(_CHATTY)}, '')), {WHITE}) || chr(10)")})
