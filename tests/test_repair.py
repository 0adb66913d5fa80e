"""Repair of JSON and diffs, file blocks, compression, as functions and as columns."""

import json

import pytest

from tessera.functions import repair as R


@pytest.mark.parametrize("text, want", [
    ('{"a": 1}', {"a": 1}),
    ('<think>{"no": 0}</think> So:\n```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}),
    ('The answer is {"a": "x } y"} as said', {"a": "x } y"}),
    ("{a: 1, b_c: [2,],}", {"a": 1, "b_c": [2]}),
    ('{"a": {"b": "cut of', {"a": {"b": "cut of"}}),
    ("nothing", None), ("", None), (None, None), ("[" * 100_000, None),
])
def test_json(text, want):
    got = R.json_of(text)
    assert (json.loads(got) if got else None) == want


def test_broken_arguments():
    got = json.loads(R.arguments_of('{"path": "a.py", "content": "x = "1"\\n"}', "write_file"))
    assert got == {"path": "a.py", "content": 'x = "1"\n'}
    assert R.arguments_of("nothing", "write_file") is None


def test_diffs():
    bare = "diff --git a/x.py b/x.py\nindex 12ab..34cd 100644\n@@ -1 +1 @@\n-a\n+b\n"
    want = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n"
    assert R.tidy_diff(bare) == want and R.tidy_diff(None) == ""
    assert R.diffs_of(f"Here:\n```diff\n{bare}```\nand {bare}") == [want]
    assert R.diffs_of(bare + bare) == [want, want] and R.diffs_of("none") == []
    assert R.new_files_of("--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+one\n+two\n--- a/o.py\n+++ b/o.py\n@@ -1 +1 @@\n-a\n+b\n") == {"n.py": "one\ntwo\n"}


def test_files():
    assert R.files_of("FILE: a.py\n```python\nx = 1\n```\n## FILE: b.txt\nplain\nFILE: a.py\n```\ny = 2\n```") == {"a.py": "x = 1\ny = 2\n", "b.txt": "plain\n"}
    assert R.files_of("none") == {}


def test_compression():
    got = R.compressed(["s" * 1000, "t" * 1000, "u" * 5000, "v" * 600], 1200)
    assert got[:2] == ["s" * 1000, "t" * 1000] and len(got[2]) < 5000 and R.CUT in got[2]
    assert sum(len(x) // 4 for x in got) <= 1200
    assert R.compressed(["a"], 0) == ["a"] and R.compressed([], 0) == []


def test_columns(spark):
    frame = spark.createDataFrame([("FILE: a\nx",), (None,)], "t string")
    rows = frame.select(R.files_column("t"), R.json_column("t"), R.diffs_column("t"), R.new_files_column("t")).collect()
    assert rows[0][0] == {"a": "x\n"} and rows[1][1] is None


TEXT = "a\n  b\nc\nd\ne\n"


@pytest.mark.parametrize("diff, want, lost", [
    ("--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n", "a\nB\nc\nd\ne\n", 0),
    ("@@ -9 +9 @@\n-c\n+C\n@@ -1 +1 @@\n-e\n+E\n", "a\n  b\nC\nd\nE\n", 0),
    ("@@\n a\n-x\n-y\n+n\n d\n", "a\nn\nd\ne\n", 0),  # by its ends
    ("@@\n-q\n-c\n-d\n+n\n", "a\nn\ne\n", 0),  # two of three lines agree
    ("@@\n-q\n-r\n-s\n+n\n", TEXT, 1),
    ("", TEXT, 0), (None, TEXT, 0),
])
def test_patches_find_their_place(diff, want, lost):
    assert R.patched(TEXT, diff) == (want, lost)


def test_patched_column(spark):
    df = spark.createDataFrame([("a\nb", "@@\n-b\n+c\n"), (None, "@@\n-b\n+c\n")], "s string, d string")
    assert [tuple(r[0]) for r in df.select(R.patched_column("s", "d")).collect()] == [("a\nc", 0), ("", 1)]
