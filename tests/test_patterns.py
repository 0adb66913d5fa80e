"""Many patterns, token rows and chats of problems."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.functions import parse as P
from tessera.functions import text as T
from tessera.operators import patterns as X
from tessera.operators.tokens import token_rows


def texts(n=150, seed=1):
    rng = random.Random(seed)
    letters = "abcde é"
    return [(i, "".join(rng.choices(letters, k=rng.choice([0, 3, 40, 400])))) for i in range(n)] + [(n, None), (n + 1, "aaaaaaaaaaaa")]


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_ten_thousand_patterns(spark, bound):
    """One walk of an automaton, and the meeting of grams beyond its bound."""
    rng, rows = random.Random(2), texts()
    words = {"".join(rng.choices("abcdé ", k=rng.choice([1, 2, 3, 5, 7, 9, 12]))) for _ in range(40_000)}
    words = sorted(words)[:10_000]
    assert len(words) == 10_000
    frame = spark.createDataFrame(rows, "id long, body string")
    known = spark.createDataFrame([(w,) for w in words] + [(None,), ("",), (words[0],)], "p string")
    got = {tuple(r) for r in X.matches(frame, "id", "body", known, "p", bound).collect()}
    want = {(i, t[a:b]) for i, t in rows if t for a in range(len(t)) for b in range(a + 1, min(len(t), a + 12) + 1)}
    assert got == {(i, w) for i, w in want if w in set(words)} and len(got) > 1000


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_no_patterns_and_no_texts(spark, bound):
    frame, known = spark.createDataFrame(texts(5), "id long, body string"), spark.createDataFrame([("ab",)], "p string")
    assert X.matches(frame, "id", "body", known.limit(0), "p", bound).collect() == []
    assert X.matches(frame.limit(0), "id", "body", known, "p", bound).collect() == []


def test_relevant_skills_equal_scores_of_all_pairs(spark):
    rng = random.Random(3)
    words = ["parse", "json", "the", "web", "page", "file", "Read", "of", "io"]
    skills = [(f"s{i}", rng.choice(["", "web page", "READ the", "json"]), " ".join(rng.choices(words, k=6))) for i in range(40)]
    queries = [(i, " ".join(rng.choices(words, k=5))) for i in range(30)] + [(99, None)]
    got = X.relevant(spark.createDataFrame(skills, "skill string, pattern string, insight string"), spark.createDataFrame(queries, "query_id long, query string"), k=4).collect()
    want = set()
    for q, text in queries:
        scored = []
        for name, pattern, insight in skills:
            low = (text or "").lower()
            n = 5 * bool(pattern and pattern.lower() in low) + min(5, sum(w in low for w in {w for w in insight.lower().split() if len(w) >= 3}))
            scored += [(-n, name)] if n >= 2 and text else []
        want |= {(q, name, -n, i + 1) for i, (n, name) in enumerate(sorted(scored)[:4])}
    assert {tuple(r) for r in got} == want


def test_first_of_a_list(spark):
    frame = spark.createDataFrame([(1, "/x/en__src10/a"), (2, "/x/en__src1/a"), (3, "/own")], "id long, path string")
    known = spark.createDataFrame([("en__src1", "one", 2), ("en__src10", "ten", 1), ("zz", "z", 0)], "slug string, url string, place int")
    assert {r.id: r.url for r in X.first_of(frame, "id", "path", known, "slug", "url", "place").collect()} == {1: "ten", 2: "one", 3: None}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_rows_are_the_tokenizer_s(spark, name):
    rows = [(1, "Hello there, it's 12.5!"), (2, None), (3, ""), (4, "word " * 300), (5, "é 唐 <|endoftext|>")]
    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.encode_special_tokens = True
    got = {r.id: r for r in token_rows(spark.createDataFrame(rows, "id long, text string"), "text", public_tokenizers.path(name), 20).collect()}
    for i, t in rows:
        assert got[i].ids == got[i].labels == made.encode(t or "", add_special_tokens=False).ids[:20]


def test_bytes_as_ids(spark):
    rows = [(1, "aé"), (2, None), (3, ""), (4, "唐" * 9)]
    got = {r.id: r.ids for r in token_rows(spark.createDataFrame(rows, "id long, text string"), "text", None, 5).collect()}
    assert got == {i: list((t or "").encode()[:5]) for i, t in rows}


def test_chats_of_problems(spark):
    frame = spark.createDataFrame([(" How many? ", "2 + 2 = 4\n#### 4\n"), ("", "x"), ("q", None), ("q", " ")], "q string, a string")
    first, *rest = [r[0] for r in frame.select(P.problem_chat(F.col("q"), F.col("a"))).collect()]
    assert first == f"<|im_start|>system\n{P.TUTOR}<|im_end|>\n<|im_start|>user\nHow many?<|im_end|>\n<|im_start|>assistant\n2 + 2 = 4<|im_end|>"
    assert rest == [None] * 3


def test_fill_in_the_middle_ends_and_drops(spark):
    frame = spark.createDataFrame([(i, "0123456789" * 5) for i in range(40)] + [(90, "short"), (91, None)], "id long, t string")
    got = {r.id: r for r in frame.select("id", T.fill_in_middle(F.col("t"), "s", F.col("id"), end="<end>", short="dropped").alias("d"), T.fill_in_middle(F.col("t"), "s", F.col("id")).alias("k")).collect()}
    assert got[90].d is None and got[90].k == "short" and got[91].d is None and got[91].k is None
    moved = 0
    for i in range(40):
        d = got[i].d
        assert d.endswith("<end>") and d == got[i].k + "<end>"
        if d.startswith("<|fim_prefix|>"):
            a, b = d[len("<|fim_prefix|>") : -len("<end>")].split("<|fim_suffix|>")
            suffix, middle = b.split("<|fim_middle|>")
            assert a + middle + suffix == "0123456789" * 5 and 5 <= len(middle) <= 15
            moved += 1
    assert 8 < moved < 32
