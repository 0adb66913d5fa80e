"""Federated search, snippets, sanitising."""

from tessera.operators import federated as X
from tessera.operators import mix as M
from tessera.operators import search as S

SCHEMA = "doc_id long, project string, title string, text string, url string"


def pool(spark, project, texts):
    return spark.createDataFrame([(i, project, f"title {t.split()[0]}", t, f"http://{project}/{t.split()[0]}{i}") for i, t in enumerate(texts)], SCHEMA)


def test_kinds_stand_in_order_and_urls_once(spark):
    a = pool(spark, "w", ["apple pie is good", "pear cake", "apple tart"])
    b = pool(spark, "s", ["apple sonnet by someone", "sea song"])
    rows = X.search({"wiki": a}, {"source": b}, "apple").collect()
    assert [r.kind for r in rows] == ["explain", "explain", "book", "image"]  # the primary text's url stood under book already
    assert rows[0].score <= rows[1].score and "[apple]" in rows[0].snippet
    assert rows[-1].provider == "commons"
    assert X.search({"wiki": a}, {}, " \x00 ", image=False).count() == 0


def test_hits_and_titles(spark):
    a = pool(spark, "w", ["apple pie", "pear cake with apple"])
    got = X.hits(a, "apple", with_text=True).collect()
    assert [r["rank"] for r in got] == [1, 2] and {r.text for r in got} == {"apple pie", "pear cake with apple"}
    assert [r.doc_id for r in X.title_hits(a, "pear").collect()] == [1]


def test_snippet(spark):
    frame = spark.createDataFrame([("a b c d e f hit g hit h i j k l m",), ("",), (None,), ("hit.",)], "text string")
    got = [r.snippet for r in S.with_snippets(frame, "hit", n=4).collect()]
    assert got == ["…f [hit] g [hit]…", "", "", "[hit]."]


def test_quota_arithmetic():
    assert M.capped_target(1000, 0.1, 200, 150) == 150 and M.capped_target(1000, 0.1, 200, 150, most_first=True) == 200
    assert M.share_beside(75, 0.25) == 25
    assert M.shrunk({"a": 50, "b": 5}, {"a": 40, "b": 10}, 30, 20, ["b", "a"]) == {"a": 25, "b": 5}
    assert M.by_weight({"a": 10, "b": 1}, {"a": 1, "b": 1}, 8) == {"a": 4, "b": 1}


def test_numbered_equals_a_plain_order(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, g string")
    got = M.numbered(frame, ["g"], "1", "id").collect()
    for g in ("hot", None):
        assert sorted(r["at"] for r in got if r.g == g) == list(range(sum(x[1] == g for x in rows)))
    assert M.numbered(frame.limit(0), [], "1", "id").count() == 0
    assert M.with_replacement(frame.limit(0), "g", {"hot": 1.0}, 5, "1", "id").count() == 0
