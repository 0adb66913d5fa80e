"""Markup within markup."""

import random

import pytest

from tessera.functions.markup import plain_of


@pytest.mark.parametrize("text, want", [
    (None, None), ("", ""), ("plain words", "plain words"),
    ("a {{t|{{u|[[x]]}}|b}} c", "a c"),
    ("{{open and [[link]]", "{{open and link"), ("shut}} and ]]", "shut}} and ]]"),
    ("[[Target]] and [[Target|the label]] and [[:Category:X]]", "Target and the label and Category:X"),
    ("[[File:a.jpg|thumb|200px|A cap with [[link|inner [[deep]]]] and {{t}}.]] after", "A cap with inner deep and . after"),
    ("[[Category:Things|key]]x", "x"), ("[[图像:a.jpg]]y", "y"),
    ("see [https://x.org/a the '''site'''] or [//y.org] and [not a link]", "see the site or and [not a link]"),
    ("a<ref name=\"n\">note {{t}} [[x]]</ref>b<ref name=\"n\"/>c", "abc"),
    ("<div class=\"c\">in <b>bold</b></div> <br/>out<!-- gone {{ [[ --> end <!-- open", "in bold \nout end"),
    ("<nowiki>[[kept]] {{too}}</nowiki> [[x|y]]", "[[kept]] {{too}} y"),
    ("== Head ==\ntext '''''both''''' ''it''\n* one\n** two\n# three\n; term : d", "Head\ntext both it\none\ntwo\nthree\nterm : d"),
    ("{| class=\"w\"\n|+ Caption\n|-\n! H1 !! H2\n|-\n| style=\"a\" | one || [[two|2]]\n| plain\n|}\nafter", "H1\nH2\none\n2\nplain\n\nafter"),
    ("before\n{|\n| outer\n{|\n| inner [[a|b]]\n| x=1 | deep\n|}\n| last\n|}\nafter", "before\n\nouter\n\ninner b\ndeep\nlast\n\nafter"),
    ("text {| not at a line's start |}", "text {| not at a line's start |}"),
    ("a &amp; b&nbsp;c &lt;x&gt;", "a & b c <x>"),
    ("x|y", "x|y"), ("{{t\n| a = 1\n| b\n}}z", "z"), ("a\r\n\r\n\r\n\r\nb", "a\n\nb"),
])
def test_markup(text, want):
    assert plain_of(text) == want


def test_any_text_ends_and_plain_words_stay():
    rng = random.Random(1)
    marks = ["{{", "}}", "[[", "]]", "{|", "|}", "|", "|-", "!", "\n", "<ref>", "</ref>", "<b>", "</b>", "[http://a ", "]", "==", "''", "*", "<!--", "-->", "word "]
    for _ in range(3000):
        assert isinstance(plain_of("".join(rng.choices(marks, k=rng.randint(0, 40)))), str)
    deep = "{{a|" * 3000 + "x" + "}}" * 3000 + "left"
    assert plain_of(deep) == "left"
    assert plain_of("[[a|" * 500 + "x" + "]]" * 500) == "x"
    assert "word" in plain_of("[[" * 2000 + "word")
