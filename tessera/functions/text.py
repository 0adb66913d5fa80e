"""Scalar functions on text columns; all are column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Section titles after which an article's text ends.
TRAILING_SECTIONS = ("references", "external links", "see also", "further reading", "notes", "bibliography", "sources", "参考文献", "参考资料", "外部链接", "外部連結", "参见", "參見", "注释")
MAX_WIKITEXT = 800_000
BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2002\u2003\u2009\u3000"


def strip(c: Column) -> Column:
    """White space off both ends, as Unicode has it."""
    return F.btrim(c, F.lit(BLANK))


def readable(c: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes ``?``."""
    return F.replace(F.make_valid_utf8(c.cast("string")), F.lit("\ufffd"), F.lit("?"))


def sanitised_query(c: Column) -> Column:
    """Control characters and runs of white space are one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f\s]+", " "))


def stamp(at: Column) -> Column:
    """A time as it stands in names of runs."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def page_url(base: Column, title: Column) -> Column:
    return F.concat(base, F.replace(title, F.lit(" "), F.lit("_")))


#: (pattern, replacement) in the order they are applied.
NOTES = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<ref[^>/]*>.*?</ref>", " "),
    (r"(?is)<ref[^>]*/>", " "),
    (r"(?s)\{\|.*?\|\}", " "),
)
FILES = (
    (r"(?iu)\[\[(?:file|image|文件|图像|圖像):[^\]]*\]\]", " "),
    (r"(?iu)\[\[(?:category|分类|分類):[^\]]*\]\]", " "),
)
#: Templates from the inside out; at most eight deep.
TEMPLATES = ((r"\{\{[^{}]*\}\}", " "),) * 8
HEADINGS = ((r"(?dm)^=+[ \t]*([^=\n]+?)[ \t]*=+[ \t]*$", "\n$1\n"),)
TAGS = ((r"(?is)<[^>]+>", " "),)
OUTER_LINKS = (
    (r"\[https?://[^\s\]]+[ \t]+([^\]]+)\]", "$1"),
    (r"\[(https?://[^\s\]]+)[ \t]*\]", "$1"),
)
LINKS = (
    (r"\[\[[^\]|]*\|[ \t]*([^\]]*?)[ \t]*\]\]", "$1"),
    (r"\[\[[ \t]*([^\]|#]*)(?:#[^\]|]*)?\]\]", "$1"),
)
QUOTES = ((r"'{2,}", ""),)
LISTS = ((r"(?dm)^[ \t]*[*#:;]+[ \t]*", ""),)
SPACES = (
    (r"\r\n?", "\n"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
)


def replaced(c: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def clean_wikitext(c: Column, drop_trailing: bool = True) -> Column:
    """Readable text of wiki markup."""
    c = strip(replaced(F.substring(c, 1, MAX_WIKITEXT), NOTES + FILES + TEMPLATES + HEADINGS + TAGS + OUTER_LINKS + LINKS + QUOTES + LISTS + SPACES))
    return cut_trailing(c) if drop_trailing else c


def cut_trailing(c: Column) -> Column:
    """The lines before the first that is a trailing section's title."""
    lines = F.split(c, "\n", -1)
    hits = F.filter(F.transform(lines, lambda x, i: F.when(F.lower(strip(x)).isin(*TRAILING_SECTIONS), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, strip(F.array_join(F.slice(lines, 1, F.greatest(F.element_at(hits, 1), F.lit(0))), "\n"))).otherwise(c)


def snippet(c: Column, n: int = 260) -> Column:
    return strip(F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" ")))


def truncated(c: Column, n: int, marker: str) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def preview(c: Column, n: int = 300) -> Column:
    flat = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def sentences(c: Column) -> Column:
    """Parts after a full stop, exclamation or question mark and white space; none is empty."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda x: x != "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def first_present(*cs: Column) -> Column:
    return F.coalesce(*cs)


def first_not_blank(*cs: Column) -> Column:
    return F.coalesce(*[F.when(F.length(strip(c)) > 0, c) for c in cs])


def minified(text: Column, ext: Column) -> Column:
    lines = F.size(F.split(text, "\n", -1))
    return ext.isin("js", "ts", "css", "json") & (((lines <= 2) & (F.length(text) > 2000)) | (F.length(text) / lines > 500))


#: File extensions and their languages.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp", "cc": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "sql": "sql", "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown"}


def language_of(ext: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    bare = F.lower(F.ltrim(ext, F.lit(".")))
    return F.coalesce(F.create_map(*pairs)[bare], bare)


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key; a key without one is shown in words."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    own = F.replace(key, F.lit("_"), F.lit(" "))
    return F.coalesce(F.create_map(*pairs)[key], own) if pairs else own


def path_depth(path: Column) -> Column:
    return F.size(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)).cast("long")


def code_only(c: Column) -> Column:
    """The first fenced block, or the text without one chatty first line; ends in a newline."""
    fenced = F.regexp_extract(c, r"(?s)```(?:python|py)?[ \t]*\n(.*?)```", 1)
    plain = F.regexp_replace(c, r"^\s*(?:Sure|Here's|Here is|Below is|Certainly|Absolutely)[^\n]*\n", "")
    return F.concat(strip(F.when(F.length(fenced) > 0, fenced).otherwise(plain)), F.lit("\n"))


def chat(user: Column, assistant: Column) -> Column:
    return F.concat(F.lit("User:\n"), user, F.lit("\n\nAssistant:\n"), assistant)


def unit(seed: str | Column, *keys: Column) -> Column:
    """A number from 0 to 1 that depends on seed and keys alone."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    h = F.substring(F.sha1(F.concat_ws(":", seed, *[k.cast("string") for k in keys]).cast("binary")), 1, 8)
    return F.conv(h, 16, 10).cast("long") / F.lit(float(1 << 32))


def shuffle_key(seed: str, *keys: Column) -> Column:
    return F.sha1(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]).cast("binary"))


def fill_in_middle(c: Column, seed: str, key: Column, rate: float = 0.5, least: int = 32, end: str = "", short: str = "stays") -> Column:
    """Text with its middle moved behind sentinels at ``rate``, else as it is, and ``end`` behind either.

    A text of under ``least`` characters ``stays`` as it is (with the end) or is ``dropped``: null.
    """
    n = F.length(c)
    size = F.greatest(F.lit(1), F.least(F.floor(n * (0.1 + 0.2 * unit(seed + "m", key))).cast("int"), n - 1))
    start = F.floor(unit(seed + "s", key) * (n - size + 1)).cast("int")
    moved = F.concat(F.lit("<|fim_prefix|>"), F.substring(c, F.lit(1), start), F.lit("<|fim_suffix|>"), F.substring(c, start + size + 1, n), F.lit("<|fim_middle|>"), F.substring(c, start + 1, size))
    out = F.concat(F.when((unit(seed + "r", key) < rate) & (n >= least), moved).otherwise(c), F.lit(end))
    return F.when(n >= least, out) if short == "dropped" else out


def html_text(c: Column) -> Column:
    """Text between tags, white space collapsed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))


def gsm_answer(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)\s*####.*$", "")


def number_or_null(c: Column) -> Column:
    return c.try_cast("double")


def answer_reward(guess: Column, answer: Column) -> Column:
    """5 exact, 3.5 but for white space, 2 within 10 %, 1.5 within 20 %, -2.5 farther, -4.5 not numbers, -2 no guess."""
    g, a = number_or_null(strip(guess)), number_or_null(strip(answer))
    ratio = F.try_divide(g, a)
    return (
        F.when(guess.isNull(), -2.0).when(guess == answer, 5.0).when(strip(guess) == strip(answer), 3.5)
        .when(ratio.isNull(), -4.5).when(ratio.between(0.9, 1.1), 2.0).when(ratio.between(0.8, 1.2), 1.5).otherwise(-2.5)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
