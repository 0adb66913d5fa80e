"""Full-text search: tokens, BM25, snippets, and a MATCH query language.

BM25 is that of the common embedded full-text engine: k1 = 1.2, b = 0.75, an idf that is
never below 1e-6, smaller scores are better.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _folds() -> dict[str, str]:
    """Letters that are a letter of ASCII with one mark, and that letter; marks by themselves become nothing."""
    out = {}
    for c in map(chr, range(0xC0, 0x1F00)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0] < "\x80" and parts[0].isalpha() and unicodedata.combining(parts[1]):
            out[c] = parts[0].lower()
    return out | {chr(c): "" for c in range(0x300, 0x370)}


FOLDS = _folds()
_WITH = [c for c in FOLDS if FOLDS[c]] + [c for c in FOLDS if not FOLDS[c]]


#: What a token is before it is folded: letters and digits, with any marks.
TOKEN = r"[\u0300-\u036f]*[\p{L}\p{N}][\p{L}\p{N}\u0300-\u036f]*"
#: A hit's place is its field's number times this, and its position.
FIELD = 1 << 32


def folded(c: Column) -> Column:
    """Lower-cased, without marks on Latin letters; letters of ASCII have none."""
    marked = F.translate(F.lower(c), "".join(_WITH), "".join(FOLDS[x] for x in _WITH))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(marked)


def fold(text: str) -> str:
    return "".join(FOLDS.get(c, c) for c in text.lower())


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def cut(docs: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, dl, t0, t1, ...): the length of each document and the tokens of its fields."""
    each = [tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(fields)]
    size = sum((F.size(f"t{i}") for i in range(len(fields))), F.lit(0)).cast("double")
    return docs.select(key, *each).select(key, size.alias("dl"), *[f"t{i}" for i in range(len(fields))])


def placed(fields: list[Column], kept) -> Column:
    """(at, term) of each token of fields whose term is ``kept``; others are passed over before they get a place."""

    def of(i: int) -> Column:
        return F.filter(F.transform(fields[i], lambda term, pos: F.when(kept(term), F.struct((F.lit(i * FIELD) + pos).alias("at"), term.alias("term")))), lambda h: h.isNotNull())

    return F.concat(*map(of, range(len(fields))))


def cut_fields(n: int) -> list[Column]:
    """The token columns of ``cut``."""
    return [F.col(f"t{i}") for i in range(n)]


@dataclass(frozen=True)
class Phrase:
    """Words one after the other, the last a prefix if ``prefix``, at a field's beginning if ``first``; in
    one of ``fields`` (None: any; with ``but``: in any other)."""

    words: tuple[str, ...]
    fields: tuple[str, ...] | None = None
    prefix: bool = False
    first: bool = False
    but: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases with at most ``distance`` words between the end of each and the start of the last."""

    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str
    left: object
    right: object


class SyntaxProblem(ValueError):
    pass


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", fold(text)))


def parse(query: str) -> object:
    """AND (or nothing between), OR, binary NOT, parentheses, "phrases", prefix*, a + b, ^first, field: and
    {fields}: and -field:, NEAR(a b, n).  NOT binds closest, then AND, then OR; what is none of these is refused.
    """
    items, end = [], 0
    for m in re.finditer(r'"(?:[^"]|"")*"|\w+|[()+*:,{}^-]', query):
        items.append(m.group())
        if query[end : m.start()].strip():
            break
        end = m.end()
    if query[end:].strip():
        raise SyntaxProblem(f"near {query[end:].strip()[:20]!r}")
    at, words = 0, ("AND", "OR", "NOT")

    def peek(ahead: int = 0) -> str | None:
        return items[at + ahead] if at + ahead < len(items) else None

    def take(wanted: str | None = None) -> str:
        nonlocal at
        item = peek()
        if item is None or (wanted is not None and item != wanted):
            raise SyntaxProblem(f"near {item!r}" + (f", lacks {wanted}" if wanted else ""))
        at += 1
        return item

    def is_text(item: str | None) -> bool:
        return item is not None and (item[0] == '"' or (item[0].isalnum() or item[0] == "_") and item not in words)

    def text() -> str:
        if not is_text(peek()):
            raise SyntaxProblem(f"near {peek()!r}")
        item = take()
        return item[1:-1].replace('""', '"') if item[0] == '"' else item

    def phrase(fields, but) -> Phrase:
        first = peek() == "^" and bool(take())
        parts, prefix = words_of(text()), False
        while True:
            if peek() == "*":
                take()
                prefix = True
            if peek() != "+" or prefix:
                return Phrase(parts, fields, prefix, first, but)
            take()
            parts += words_of(text())

    def columns():
        """The fields that stand before a colon, if any do, and whether all others are meant."""
        nonlocal at
        was, but, names = at, False, ()
        if peek() == "-":
            take()
            but = True
        if peek() == "{":
            take()
            while peek() != "}":
                names += (text(),)
            take("}")
        elif is_text(peek()):
            names = (text(),)
        if names and peek() == ":":
            take()
            return names, but
        if but:
            raise SyntaxProblem("near '-'")
        at = was
        return None, False

    def primary(fields=None, but=False):
        own, own_but = columns()
        if own:
            fields, but = own, own_but
        if peek() == "(":
            take()
            inner = any_of(fields, but)
            take(")")
            return inner
        if peek() == "NEAR" and peek(1) == "(":
            take()
            take("(")
            phrases = ()
            while peek() not in (",", ")", None):
                phrases += (phrase(fields, but),)
            distance = 10
            if peek() == ",":
                take()
                item = take()
                if not item.isdigit():
                    raise SyntaxProblem(f"near {item!r}")
                distance = int(item)
            take(")")
            if not phrases:
                raise SyntaxProblem("NEAR of nothing")
            return Near(phrases, distance)
        return phrase(fields, but)

    def chain(below, names, kind, fields, but):
        left = below(fields, but)
        while (item := peek()) is not None and (item in names or ("" in names and item not in (")", "OR", "AND", "NOT"))):
            if item in names:
                take()
            left = Op(kind, left, below(fields, but))
        return left

    def but_of(fields, but):
        return chain(primary, ("NOT",), "NOT", fields, but)

    def all_of(fields, but):
        return chain(but_of, ("AND", ""), "AND", fields, but)

    def any_of(fields=None, but=False):
        return chain(all_of, ("OR",), "OR", fields, but)

    tree = any_of()
    if at < len(items):
        raise SyntaxProblem(f"near {peek()!r}")
    return tree


def needed(tree) -> tuple[set[str], set[str]]:
    """Words and prefixes of a query."""
    if isinstance(tree, Op):
        (a, b), (c, d) = needed(tree.left), needed(tree.right)
        return a | c, b | d
    phrases = tree.phrases if isinstance(tree, Near) else (tree,)
    whole = {w for p in phrases for w in (p.words[:-1] if p.prefix else p.words)}
    return whole, {p.words[-1] for p in phrases if p.prefix and p.words}


def is_needed(tree):
    """The condition on a term that some phrase of the query asks for."""
    whole, begun = needed(tree)

    def kept(term: Column) -> Column:
        fits = term.isin(*sorted(whole)) if whole else F.lit(False)
        for p in sorted(begun):
            fits = fits | term.startswith(p)
        return fits

    return kept


def starts(hits: Column, phrase: Phrase, fields: tuple[str, ...]) -> Column:
    """Places at which a phrase starts, among (at, term) of a document."""
    allowed = [i for i, f in enumerate(fields) if phrase.fields is None or (f in phrase.fields) != phrase.but]
    if not phrase.words or not allowed:
        return F.array().cast("array<bigint>")
    held = hits if len(allowed) == len(fields) else F.filter(hits, lambda h: F.floor(h["at"] / FIELD).isin(*allowed))
    n = len(phrase.words)

    def of(i: int) -> Column:
        word = phrase.words[i]
        fits = (lambda h: h["term"].startswith(word)) if phrase.prefix and i == n - 1 else (lambda h: h["term"] == word)
        return F.transform(F.filter(held, fits), lambda h: h["at"] - i)

    found = reduce(F.array_intersect, map(of, range(n)))
    return F.filter(found, lambda s: s % FIELD == 0) if phrase.first else found


def _reaches(phrase: Phrase, distance: int, start: Column, last: Column) -> Column:
    return start.between(last - len(phrase.words) - distance, last)


def _parts(tree) -> tuple[list[Phrase], list[Near]]:
    """All phrases and groups of a query, each once."""
    if isinstance(tree, Phrase):
        return [tree], []
    if isinstance(tree, Near):
        return list(dict.fromkeys(tree.phrases)), [tree]
    (a, b), (c, d) = _parts(tree.left), _parts(tree.right)
    return list(dict.fromkeys(a + c)), list(dict.fromkeys(b + d))


def _phrases(tree) -> list[tuple[Phrase, Near | None]]:
    """What is scored: all but the right of NOT."""
    if isinstance(tree, Phrase):
        return [(tree, None)]
    if isinstance(tree, Near):
        return [(p, tree) for p in tree.phrases]
    return _phrases(tree.left) + ([] if tree.kind == "NOT" else _phrases(tree.right))


def scored_parts(tree) -> list[tuple[Phrase, Near | None]]:
    return list(dict.fromkeys(_phrases(tree)))


def holds(tree, there) -> Column:
    """The query as a condition; ``there`` gives that of a phrase or a group."""
    if not isinstance(tree, Op):
        return there(tree)
    left, right = holds(tree.left, there), holds(tree.right, there)
    return left | right if tree.kind == "OR" else left & (right if tree.kind == "AND" else ~right)


def evaluated(rows: DataFrame, key: str, tree, fields: tuple[str, ...]) -> DataFrame:
    """(key, dl, matched, n, tf) of (key, dl, hits): whether a document matches, how often it has each scored phrase,
    and how often as the query wants it (near others).

    All of a document is in its row, so nothing is joined; its hits must fit in a task.
    """
    phrases, nears = _parts(tree)
    s = {p: F.col(f"s{i}") for i, p in enumerate(phrases)}
    last = {n: F.col(f"l{i}") for i, n in enumerate(nears)}
    rows = rows.select(key, "dl", *[starts(F.col("hits"), p, fields).alias(f"s{i}") for i, p in enumerate(phrases)])

    def lasts(near: Near) -> Column:
        """Starts of phrases at which every phrase of the group has one near enough before."""
        every = F.array_distinct(F.concat(*[s[p] for p in near.phrases]))
        reached = lambda p, x: F.exists(s[p], lambda y: _reaches(p, near.distance, y, x))
        return F.filter(every, lambda x: reduce(and_, [reached(p, x) for p in near.phrases]))

    rows = rows.select("*", *[lasts(n).alias(f"l{i}") for i, n in enumerate(nears)])

    def times(phrase: Phrase, near: Near | None) -> Column:
        if near is None:
            return F.size(s[phrase])
        return F.size(F.filter(s[phrase], lambda y: F.exists(last[near], lambda x: _reaches(phrase, near.distance, y, x))))

    pairs = scored_parts(tree)
    matched = holds(tree, lambda x: F.size(last[x] if isinstance(x, Near) else s[x]) > 0)
    return rows.select(key, "dl", matched.alias("matched"), F.array(*[F.size(s[p]) for p, _ in pairs]).alias("n"), F.array(*[times(*x) for x in pairs]).alias("tf"))


def idf(n_docs: float, df: float) -> float:
    got = math.log((n_docs - df + 0.5) / (df + 0.5))
    return LEAST_IDF if got <= 0 else got


def gain(tf: Column, dl: Column, avgdl: float) -> Column:
    """What a phrase's occurrences in a document of the length are worth, before its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def best(rows: DataFrame, key: str, idfs: list[float], avgdl: float, k: int) -> DataFrame:
    """(key, score) of the k best of ``evaluated``, best first, ties to the smaller key."""
    score = sum((F.lit(w) * gain(F.col("tf")[i], F.col("dl"), avgdl) for i, w in enumerate(idfs)), F.lit(0.0))
    return rows.filter("matched").select(key, (-score).alias("score")).orderBy("score", key).limit(k)


def counted(rows: DataFrame, key: str, tree, n_docs: float | None = None, avgdl: float | None = None) -> tuple[DataFrame, list[float], float]:
    """The matching rows of ``evaluated``, written, the idf of each scored phrase (which is as rare as it is anywhere) and the mean length.

    One pass: the counts are observed while rows are written.  ``n_docs`` and ``avgdl``: if rows aren't all documents.
    """
    told = Observation()
    sums = [F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("dl")]
    sums += [F.count_if(F.col("n")[i] > 0).alias(f"df{i}") for i in range(len(scored_parts(tree)))]
    kept = stored(rows.observe(told, *sums).filter("matched"), "hits")
    got = told.get
    n_docs = float(got["n_docs"] or 0) if n_docs is None else n_docs
    if avgdl is None:
        avgdl = (got["dl"] or 0.0) / n_docs if n_docs else 0.0
    return kept, [idf(n_docs, got[f"df{i}"] or 0) for i in range(len(scored_parts(tree)))], avgdl or 1.0


def search(docs: DataFrame, query: str, k: int = 10, key: str = "doc_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(key, score) of the k best matches, best first, ties to the smaller key; documents without a key count, but aren't found.

    The texts are read once; what matches is written with its counts, and ranked.
    """
    tree = parse(query)
    kept = is_needed(tree)
    each = cut_fields(len(fields))
    hits = placed(each, kept)
    whole, begun = needed(tree)
    if whole and not begun:  # places are made only where a word stands at all
        words = F.array(*map(F.lit, sorted(whole)))
        hits = F.when(reduce(or_, [F.arrays_overlap(t, words) for t in each]), hits).otherwise(F.array().cast("array<struct<at:bigint,term:string>>"))
    rows = cut(docs, key, fields).select(key, "dl", hits.alias("hits"))
    matching, idfs, avgdl = counted(evaluated(rows, key, tree, fields), key, tree)
    return best(matching.filter(F.col(key).isNotNull()), key, idfs, avgdl, k)


def marks(hits: Column, tree, fields: tuple[str, ...], field: str) -> Column:
    """Positions in ``field`` of the tokens that belong to an occurrence of a scored phrase."""
    base = fields.index(field) * FIELD
    spread = lambda p: F.flatten(F.transform(starts(hits, p, fields), lambda s: F.sequence(s, s + (len(p.words) - 1))))
    of = [spread(p) for p in dict.fromkeys(p for p, _ in _phrases(tree)) if p.words]
    every = F.array_distinct(F.concat(*of)) if of else F.array().cast("array<bigint>")
    return F.transform(F.filter(every, lambda a: a.between(base, base + FIELD - 1)), lambda a: (a - base).cast("int"))


def snippet(text: Column, marked: Column, n: int = 12) -> Column:
    """The stretch of ``n`` tokens with most marked ones (the first of several), these in brackets, dots where text is left out.

    A stretch that can't be moved left without losing a mark ends with one, so only those are compared.
    """
    text = F.coalesce(text, F.lit(""))
    words, gaps = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
    from_ = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(marked, lambda m: F.greatest(F.lit(0), m - (n - 1)))))
    ranked = F.transform(from_, lambda b: F.struct((-F.size(F.filter(marked, lambda m: m.between(b, b + (n - 1))))).alias("few"), b.alias("begin")))
    begin = F.array_min(ranked)["begin"]
    size = F.size(words)
    end = F.least(begin + (n - 1), size - 1)
    shown = F.transform(F.sequence(begin, end), lambda i: F.concat(F.when(F.array_contains(marked, i), F.concat(F.lit("["), words[i], F.lit("]"))).otherwise(words[i]), F.when(i < end, gaps[i + 1]).otherwise("")))
    whole = F.concat(F.when(begin == 0, gaps[0]).otherwise("…"), F.array_join(shown, ""), F.when(end == size - 1, F.element_at(gaps, -1)).otherwise("…"))
    return F.when(size == 0, text).otherwise(whole)


def with_snippets(rows: DataFrame, query: str, field: str = "text", n: int = 12, fields: tuple[str, ...] = ("text",), to: str = "snippet") -> DataFrame:
    """``rows`` of a result with the snippet of a field."""
    tree = parse(query)
    hits = placed([tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields], is_needed(tree))
    found = rows.withColumn("__marks", marks(hits, tree, fields, field))
    return found.withColumn(to, snippet(F.col(field), F.col("__marks"), n)).drop("__marks")


def found_with_snippets(docs: DataFrame, query: str, k: int = 10, field: str = "text", n: int = 12, key: str = "doc_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(key, score, the fields, snippet) of the k best matches of one search; what was found is few rows, so that no text is dealt."""
    found = stored(search(docs, query, k, key, fields), "found")
    return with_snippets(docs.select(key, *fields).join(F.broadcast(found), key), query, field, n, fields)
