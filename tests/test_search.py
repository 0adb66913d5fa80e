import sqlite3

import pytest

from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import search as S

DOCS = [(1, "the quick brown fox"), (2, "the quick dog sleeps; the fox too"), (3, "brown bear brown fox brown"), (4, "nothing here"), (5, "quick quick quick"), (6, "zebra and fox quick brown")]


@pytest.mark.parametrize("query", ["quick", "quick fox", "quick AND brown", "fox OR bear", "quick NOT fox", '"brown fox"', "bro*", "(bear OR dog) AND fox", "text:zebra", "NEAR(quick fox, 1)", "NEAR(quick fox, 0)", 'NEAR("brown fox" bear)', "NEAR(fox bro* quick, 2) OR nothing", "fox NOT NEAR(the fox, 0)"])
def test_ranks_like_the_embedded_engine(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", DOCS)
    want = con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY 2, 1 LIMIT 10", (query,)).fetchall()
    got = S.search(spark.createDataFrame(DOCS, "doc_id long, text string"), query).collect()
    assert {r.doc_id: round(r.score, 5) for r in got} == {i: round(s, 5) for i, s in want}


MARKED = [(1, "Café crème à Zürich"), (2, "cafe creme"), (3, "CAFÉ, naïve coöperation"), (4, "東京 タワー 東京"), (5, "e\u0301te\u0301 œuvre ångström Ångström"), (6, "ête ete ÉTÉ Straße strasse"), (7, "Ελλάδα ελλαδα привет Й й и")]


@pytest.mark.parametrize("query", ["cafe", "café", "crème OR Zurich", "東京", "ete", "été NOT café", "ang*", '"cafe creme"', "Ελλάδα", "й", "стр* OR стра", "strasse", "^cafe", '"cafe" + creme', "{text} : naive", "-text : naive OR 東京", 'na"i"', '"na""ive" OR naive', "cooper*"])
def test_marks_and_syntax_like_the_embedded_engine(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize = 'unicode61')")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", MARKED)
    want = con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY 2, 1 LIMIT 10", (query,)).fetchall()
    got = S.search(spark.createDataFrame(MARKED, "doc_id long, text string"), query).collect()
    assert {r.doc_id: round(r.score, 5) for r in got} == {i: round(s, 5) for i, s in want}


def test_letters_fold_like_the_embedded_engine():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize = 'unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    letters = [chr(c) for c in range(0xC0, 0x1F00) if chr(c).isalpha() and chr(c).lower() in S.FOLDS or 0xC0 <= c < 0x250 and chr(c).isalpha()]
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", [(ord(c), c) for c in letters])
    told = dict(con.execute("SELECT doc, term FROM v"))
    wrong = [c for c in letters if S.fold(c) != told.get(ord(c)) and len(c.lower()) == 1]
    assert len(wrong) <= 0.03 * len(letters), wrong


def test_stored_index_and_its_upkeep(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = I.Index(spark)
    assert index.search("quick").collect() == []
    index.put(frame(DOCS[:4])).put(frame([(5, "old words quick fox"), (6, "zebra")])).put(frame(DOCS[4:]))
    for change in (lambda i: i, lambda i: i.merge(), lambda i: i.put(frame([(9, "quick")])).delete(frame([(9, "")]))):
        change(index)
        index = I.Index(spark, index.path)
        for query in ("quick", "bro* NOT bear", '"brown fox"', "NEAR(quick fox, 1)"):
            rows = lambda d: [(r.doc_id, round(r.score, 9)) for r in d.collect()]
            assert rows(index.search(query)) == rows(S.search(frame(DOCS), query))
    with pytest.raises(I.Conflict):
        late = I.Index(spark, index.path)
        index.merge()
        late.put(frame([(10, "x")]))
    assert index.ready()


@pytest.mark.parametrize("query", ["AND", "a AND", "(a", "NOT a", "", "NEAR()", "-", "a - b", "a # b", "a.b", "(a))", "a +", "text:", "{a b}", '"a', "a & b", "*"])
def test_bad_queries_are_refused(query):
    with pytest.raises(S.SyntaxProblem):
        S.parse(query)


def many(n=600, seed=5):
    """Documents of few words, some of which are rare, some of which stand in a few documents often."""
    import random

    rng = random.Random(seed)
    words = ["the", "of", "quick", "brown", "fox", "lazy", "dog", "licence", "licensed", "license", "café"] + [f"w{i}" for i in range(40)]
    weights = [40, 30, 8, 8, 4, 3, 3, 1, 1, 1, 1] + [2] * 40
    out = []
    for i in range(n):
        text = rng.choices(words, weights, k=rng.choice([3, 10, 40, 150]))
        if i % 90 == 7:
            text += ["fox"] * rng.randint(3, 9)
        out.append((i * 3, " ".join(text)))
    return out


QUERIES = ["fox", "the OR fox", "fox AND dog", "quick OR brown OR lazy", "the NOT of", "(fox OR dog) AND licensed", "fox NOT (quick OR the)", "licen*", '"quick brown"', "NEAR(fox dog, 3)", '"the fox" OR cafe', "nothere", "nothere OR fox", "^fox"]


@pytest.fixture(scope="module")
def large(spark):
    frame = spark.createDataFrame(many(), "doc_id long, text string")
    return frame, I.Index(spark, width=20, tokens=2000).put(frame)


def rows(d):
    return [(r.doc_id, round(r.score, 9)) for r in d.collect()]


@pytest.mark.parametrize("query, k", [(q, 10) for q in QUERIES] + [("fox", 1), ("the OR fox", 1), ("the NOT of", 1)])
def test_pruned_search_equals_full_scoring(large, query, k):
    frame, index = large
    assert rows(index.search(query, k)) == rows(S.search(frame, query, k))


def test_windows_that_can_t_matter_are_not_scored(large):
    _, index = large
    index.search("fox", 3)
    assert index.last["windows"] > 20 and index.last["windows_read"] < index.last["windows"]
    index.search("the", 600)
    assert index.last["windows_read"] == index.last["windows"]


def test_words_and_prefixes_read_the_files_of_their_range(large):
    _, index = large
    assert index.search("licen*").count() > 0
    files, read = index.last["files"], index.last["files_read"]
    assert files >= 5 and read <= 2
    index.search("fox")
    assert index.last["files_read"] <= 2
    index.search("zzz*")
    assert index.last["files_read"] <= 1


def test_segments_are_merged_by_size_class(spark):
    frame = spark.createDataFrame(many(80), "doc_id long, text string")
    index = I.Index(spark, width=10, tokens=500)
    for i in range(8):
        index.put(frame.filter(f"doc_id div 30 = {i}"))
    index.delete(frame.filter("doc_id % 5 = 0"))
    left = frame.filter("doc_id % 5 <> 0")
    assert len(index._names("lengths")) == 8
    for query in ("fox", "licen*", '"quick brown"', "the OR fox"):
        assert rows(index.search(query)) == rows(S.search(left, query))
    index = I.Index(spark, index.path, width=10, tokens=500).compact(4)
    assert len(index._names("lengths")) < 4
    index.put(frame.filter("doc_id = 5")).put(frame.filter("doc_id = 10").withColumn("text", F.lit("fox fox")))
    left = left.unionByName(frame.filter("doc_id = 5")).unionByName(frame.filter("doc_id = 10").withColumn("text", F.lit("fox fox")))
    for change in (lambda i: i, lambda i: i.compact(2), lambda i: i.merge()):
        change(index)
        for query in ("fox", "licen*", "the OR fox"):
            assert rows(index.search(query)) == rows(S.search(left, query))
    assert not index._names("gone") and len(index._names("blocks")) == 1


def test_fields_and_empty_indexes(spark):
    frame = spark.createDataFrame([(1, "a title", "fox in text"), (2, "fox", None), (None, "fox", "fox"), (3, "", "")], "doc_id long, title string, text string")
    index = I.Index(spark, fields=("title", "text")).put(frame)
    for query in ("fox", "title: fox", "-title: fox", "a OR in", '"fox in"', "^fox", "{title text}: fox"):
        assert rows(index.search(query)) == rows(S.search(frame.filter("doc_id is not null"), query, fields=("title", "text")))
    empty = I.Index(spark).put(frame.select("doc_id", "text").limit(0))
    assert empty.search("fox").collect() == [] and empty.merge().search("fox*").collect() == []


def brute_snippet(text, marked, n):
    import re

    spots = [m.span() for m in re.finditer(r"[^\W_]+", text or "")]
    if not spots:
        return text or ""
    first = max(range(max(1, len(spots) - n + 1)), key=lambda b: (sum(b <= m < b + n for m in marked), -b))
    last = min(first + n, len(spots)) - 1
    out, at = ("" if first == 0 else "…"), (0 if first == 0 else spots[first][0])
    for i in range(first, last + 1):
        a, b = spots[i]
        out, at = out + text[at:a] + (f"[{text[a:b]}]" if i in marked else text[a:b]), b
    return out + (text[at:] if last == len(spots) - 1 else "…")


@pytest.mark.parametrize("query, fits", [("cafe", lambda w, i: w[i] == "cafe"), ("licens* OR the", lambda w, i: w[i].startswith("licens") or w[i] == "the"), ('"quick brown"', lambda w, i: w[i : i + 2] == ["quick", "brown"] or (i > 0 and w[i - 1 : i + 1] == ["quick", "brown"]))])
def test_snippets_mark_what_was_found(spark, query, fits):
    texts = [t for _, t in many(60)] + ["Café, CAFÉ! a cafe", "", None, "a b c d e f the g licensed h i j, k l m.", "…quick  brown\nquick", "é the-the café"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.snippet for r in S.with_snippets(frame, query, n=5).collect()}
    import re

    for i, t in enumerate(texts):
        words = [S.fold(w) for w in re.findall(r"[^\W_]+", t or "")]
        assert got[i] == brute_snippet(t, {j for j in range(len(words)) if fits(words, j)}, 5)
    index = I.Index(spark, width=7).put(frame)
    found = index.search(query, 8)
    assert {r.doc_id: r.snippet for r in index.snippets(found, frame, query, n=5).collect()} == {r.doc_id: got[r.doc_id] for r in found.collect()}
    assert "[Café], [CAFÉ]! a [cafe]" in {r.snippet for r in index.snippets(index.search("cafe"), frame, "cafe", n=5).collect()}
