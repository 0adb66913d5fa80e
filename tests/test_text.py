import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


@pytest.mark.parametrize("raw, clean", [
    ("a<!-- x --> b", "a b"),
    ("x<ref name=a>y</ref>z<ref n/>", "x z"),
    ("{{a|{{b}}}}text", "text"),
    ("[[Target#s|label]] and [[Plain]]", "label and Plain"),
    ("[https://x.org a label] [https://y.org]", "a label https://y.org"),
    ("'''bold''' ''it''", "bold it"),
    ("* one\n# two", "one\ntwo"),
    ("[[File:a.png|thumb]]t[[Category:C]]", "t"),
    ("body\n== See also ==\n* x", "body"),
    ("a\r\nb\n\n\n\nc", "a\nb\n\nc"),
    ("", ""),
])
def test_clean_wikitext(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "x string").select(T.clean_wikitext(F.col("x"))).first()[0] == clean


def test_fill_in_middle_keeps_the_text(spark):
    texts = [(i, "word " * (7 + i)) for i in range(40)]
    rows = spark.createDataFrame(texts, "id long, x string").select("x", T.fill_in_middle(F.col("x"), "3", F.col("id"), 1.0).alias("y")).collect()
    for x, y in rows:
        p, rest = y.removeprefix("<|fim_prefix|>").split("<|fim_suffix|>")
        s, m = rest.split("<|fim_middle|>")
        assert p + m + s == x and len(m) >= 1


@pytest.mark.parametrize("guess, answer, reward", [("4", "4", 5.0), (" 4", "4", 3.5), ("4.2", "4", 2.0), ("4.7", "4", 1.5), ("9", "4", -2.5), ("x", "4", -4.5), ("4", "0", -4.5), (None, "4", -2.0)])
def test_answer_reward(spark, guess, answer, reward):
    assert spark.createDataFrame([(guess, answer)], "g string, a string").select(T.answer_reward(F.col("g"), F.col("a"))).first()[0] == reward
