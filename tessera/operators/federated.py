"""Search over several collections at once, and title discovery."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators.order import first_per_key

FIELDS = ("title", "text")


def sanitised(query: str) -> str:
    """Control characters and runs of white space are one space; empty means no rows."""
    return re.sub(r"[\x00-\x1f\x7f\s]+", " ", query).strip()


def as_phrase(query: str) -> str:
    return f'"{query}"' if len(query) >= 2 and '"' not in query else query


#: The collections that are searched for a language.
PROVIDERS = {"zh": ("zhwiki", "zhwikisource"), "en": ("enwiki", "enwikisource")}


def providers_of(language: Column) -> Column:
    """The names of a language's collections, or of all, with commas between."""
    every = F.lit(",".join(x for p in PROVIDERS.values() for x in p))
    return F.coalesce(F.create_map(*[F.lit(x) for k, p in PROVIDERS.items() for x in (k, ",".join(p))])[language], every)


def phrase_of(query: Column) -> Column:
    """As ``as_phrase``, of a column."""
    return F.when((F.length(query) >= 2) & ~F.contains(query, F.lit('"')), F.concat(F.lit('"'), query, F.lit('"'))).otherwise(query)


def title_query(title: Column) -> Column:
    return F.concat(F.lit("title:"), F.when(F.length(title) >= 2, F.concat(F.lit('"'), title, F.lit('"'))).otherwise(title))


def hits(docs: DataFrame, query: str, k: int = 10, with_text: bool = False, tokens: int = 24, most_text: int = 4000) -> DataFrame:
    """(rank, doc_id, score, project, title, url, snippet[, text]) of the k best documents; columns of ``docs``: doc_id, project, title, text, url."""
    query = sanitised(query)
    if not query:
        found = docs.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    else:
        k = max(1, min(50, k))
        found = S.search(docs, query, k, "doc_id", FIELDS)
    rows = docs.join(F.broadcast(found), "doc_id")  # at most 50 rows
    ranked = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("score", "doc_id", "project", "title", "url", "text"))).alias("r")).select(F.posexplode("r").alias("i", "r")).select((F.col("i") + 1).alias("rank"), "r.*")
    shown = S.with_snippets(ranked, query, "text", tokens, FIELDS) if query else ranked.withColumn("snippet", F.lit(""))
    out = shown.withColumn("snippet", F.coalesce(F.nullif("snippet", F.lit("")), F.substring("text", 1, 320)))
    return out.withColumn("text", F.substring("text", 1, most_text)) if with_text else out.drop("text")


def title_hits(docs: DataFrame, title: str, k: int = 10) -> DataFrame:
    """Documents whose title has the phrase; a plain substring match where it can't be a query."""
    try:
        S.parse(f'title:"{title}"' if len(title) >= 2 else f"title:{title}")
    except S.SyntaxProblem:
        near: Column = F.contains(F.lower("title"), F.lit(title.lower()))
        return docs.filter(near).orderBy("doc_id").limit(k).select(F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("score"), "doc_id", "project", "title", "url", F.lit("").alias("snippet"))
    return hits(docs, f'title:"{title}"' if len(title) >= 2 else f"title:{title}", k)


def search(explain: dict[str, DataFrame], primary: dict[str, DataFrame], query: str, limits: tuple[int, int, int] = (5, 5, 5), prefer_phrase: bool = False, title_mode: bool = False, image: bool = True) -> DataFrame:
    """Explaining texts, works by title, primary texts and a placeholder for images, in this order.

    A row stands once for its url, or without one for provider and title, at its first place.
    """
    plain = sanitised(query)
    by_title = f'title:"{plain}"'
    jobs = [("explain", p, d, by_title if title_mode else plain, limits[0]) for p, d in explain.items()]
    jobs += [("book", p, d, None, limits[1]) for p, d in primary.items()]
    jobs += [("primary_text", p, d, by_title if title_mode else (as_phrase(plain) if prefer_phrase else plain), limits[2]) for p, d in primary.items()]
    parts = []
    for place, (kind, provider, docs, text, k) in enumerate(jobs):
        got = title_hits(docs, plain, k) if kind == "book" else hits(docs, text, k, tokens=12)
        parts.append(got.select(F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(provider).alias("provider"), F.col("rank").cast("long").alias("rank"), F.col("doc_id").cast("string").alias("id"), "score", "project", "title", "url", "snippet"))
    if image and parts:
        row = {"place": F.lit(len(jobs)), "kind": F.lit("image"), "provider": F.lit("commons"), "rank": F.lit(1).cast("long"), "id": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "project": F.lit("commons"), "title": F.lit(f"(image search is not available: {plain})"), "url": F.lit(""), "snippet": F.lit("")}
        parts.append(parts[0].sparkSession.range(1).select(*[c.alias(n) for n, c in row.items()]))
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat_ws("\x01", "provider", "title"))
    return first_per_key(everything, [key], ["place", "rank", "id"]).orderBy("place", "rank", "id")
