"""Source divergence, periodic runs and packing against brute force, and their odd inputs."""

import functools
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import divergence, packing, periodic, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " \n\t", "one", "x" * 5000, "y " * 3000, "né 唐太宗 \x1c\x85 \xa0 é 🙂 <|endoftext|>", "Don't  stop 123\r\n\n  ok! it's 'tis  . "]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, (t, lang, source) in enumerate(rows)], SCHEMA)


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    common, out = [f"w{chr(97 + i)}" for i in range(20)] + ["É", "ÀB", "zz"], []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "", "s4"])
        words = rng.choices(common, k=rng.randint(0, 60)) + rng.choices([f"r{j}" for j in "abcdefgh"], k=3)
        out.append((" ".join(words).upper() if i % 5 == 0 else "-".join(words), lang, source))
    return out + [(t, "odd", f"s{i}") for i, t in enumerate(ODD)] + [("same words here", "one", "only")] * 12 + [(None, "none", "a"), ("", "none", "b")]


def brute_divergence(rows, least=10, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held, groups = {}, {}, set()
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts.setdefault(g, Counter()).update(terms)
        held.setdefault(g[0], Counter()).update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in held.get(lang, {}).items() if n >= least)
        own = {s: {t: counts[lang, s][t] for t in kept} for la, s in groups if la == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def weights(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        far = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: weights(c) for s, c in own.items()}, weights(whole)
        for s in own:
            pairs = sorted(((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            terms = sorted((-far(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms)}
    return out


def test_divergence_equals_brute_force(spark):
    rows = corpus()
    got = divergence.audit(table(spark, rows))
    assert {tuple(r) for r in got.collect()} == brute_divergence(rows)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_of_many_blocks_and_chunks(spark):
    """Blocks of two groups and chunks of three terms give what one block and chunk give."""
    rows = corpus(300, 5)
    wide = {tuple(r) for r in divergence.Audit(table(spark, rows)).pairs().collect()}
    tiled = divergence.Audit(table(spark, rows), block=2, chunk=3)
    assert tiled.vectors().select("chunk").distinct().count() > 4
    assert {tuple(r) for r in tiled.pairs().collect()} == wide


def test_counts_are_the_same_when_sent_often(spark, monkeypatch):
    rows = corpus(60, 6)
    whole = {tuple(r) for r in divergence.counted(table(spark, rows)).collect()}
    monkeypatch.setattr(divergence, "HELD", 5)
    assert {tuple(r) for r in divergence.counted(table(spark, rows)).collect()} == whole


def test_weights_don_t_overflow(spark):
    n, c, v = 8 * 10**15, 7 * 10**15 + 12345, 10**7
    exact = 1 + 10**9 * (c + 2) // (n + 2 * v)
    assert divergence.weights(np.array([[c]], np.int64), np.array([n], np.int64), v)[0, 0] == exact
    row = spark.createDataFrame([(c, n, v)], "c long, n long, v long").select(divergence.weight(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row.p == exact


def test_divergence_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).count() == 0
    clashing = table(spark, corpus(30)).withColumns({c: F.lit(7) for c in ("term", "count", "docs", "raw", "of_lang", "chunk", "place", "n", "v", "Text2", "value", "rank", "a.b")})
    assert {tuple(r) for r in divergence.audit(clashing, least=3).collect()} == brute_divergence(corpus(30), least=3)
    # No term is kept: every pair has the value 0.
    assert {tuple(r) for r in divergence.audit(table(spark, [("a", "x", "s"), ("b", "x", "t")])).collect()} == {("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)}


def brute_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=90), st.integers(1, 9), st.integers(0, 60))
def test_runs_equal_brute_force(words, period, times):
    words = words + (words[:period] or ["z"]) * times + words[::-1]
    assert periodic.runs(words) == brute_runs(words)


@pytest.mark.parametrize("seed", range(8))
def test_runs_with_long_periods(seed):
    """Periods beyond those that are compared in full, alone and nested, in texts of few and of many different words."""
    rng = random.Random(seed)
    for kinds in (2, 5, 1000):
        words = [rng.randrange(kinds) for _ in range(rng.randint(50, 900))]
        for _ in range(3):
            stretch = [rng.randrange(kinds) for _ in range(rng.randint(1, 180))]
            if rng.random() < 0.5:
                stretch = (stretch[:7] * 6 + stretch)[:180]
            at, size = rng.randrange(len(words)), int(len(stretch) * (3.5 + 3 * rng.random()))
            words[at:at] = [stretch[i % len(stretch)] for i in range(size)]
        assert periodic.runs(words) == brute_runs(words)


def test_runs_of_words_like_fibonacci_and_one_word():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    for words in (list(b), ["x"] * 700, ["x", "y"] * 400, (["x"] * 100 + ["y"]) * 9):
        assert periodic.runs(words) == brute_runs(words)


@pytest.mark.parametrize("heavy", [0, 3, 10**9])
def test_heavy_and_light_words_count_alike(heavy):
    rng = random.Random(1)
    codes, kinds = periodic.coded([int(rng.expovariate(0.2)) for _ in range(600)])
    got = periodic.lag_counts(codes, kinds, 150, heavy)
    assert got.tolist() == [0] + [int((codes[q:] == codes[:-q]).sum()) for q in range(1, 151)]


def test_long_texts_don_t_take_quadratic_time():
    words = ["a"] * 200_000
    assert periodic.runs(words) == [(0, 200_000, 1)]
    rng = random.Random(2)
    words = [rng.choice("ab") for _ in range(60_000)]
    planted = words[:5_000] * 5
    got = periodic.runs(words + planted)
    assert max(r[2] for r in got) == 5_000


def brute_replant(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "b", "c", "dé"], k=rng.randint(0, 150))) for _ in range(150)] + ODD
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a " * 9), (3, texts[3]), (-7, "q r " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for d, t in rows:
        words = brute_replant(d, t)
        found = brute_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
        want[d, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()] += 1
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_periodic_real_outputs_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y", {"k": 1}), (2, None, None)], "doc_id long, text string, `a.b` map<string,int>").withColumns({c: F.lit(7) for c in ("raw", "c0", "start", "runs")})
    one, two = sorted(periodic.detect(docs).collect(), key=lambda r: r.doc_id)
    assert one.collapsed == "x a b y" and [tuple(r) for r in one.runs] == [(1, 8, 2)] and one.exponent_milli == 4000 and one["a.b"] == {"k": 1} and one.raw == 7
    assert two.collapsed == "" and two.n_runs == 0 and two.start is None
    assert periodic.detect(spark.createDataFrame([], SCHEMA)).count() == 0


@functools.cache
def tokenizer():
    made = Tokenizer.from_file(VOCABULARY)
    made.encode_special_tokens = True
    return made


def plain(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def check_pieces(docs, pieces, size):
    """Every id in one piece, sequences gapless and full but for powers of two, checksums those of the ids; returns the sequences' lengths."""
    ids = {d: plain(t) for d, t in docs}
    of_doc, of_sequence = {}, {}
    for p in pieces:
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        of_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        of_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, x in ids.items():
        at = 0
        for start, length in sorted(of_doc[d]):
            assert start == at
            at += length
        assert at == len(x)
    lengths = {}
    for s, x in of_sequence.items():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        lengths[s] = at
        assert at <= size and (at == size or at & (at - 1) == 0)
    assert sorted(lengths) == list(range(len(lengths)))
    return lengths


def texts_of_sources(seed=7, n=120):
    rng, words = random.Random(seed), ["alpha", "beta,", "don't", "é—", "唐太宗", "12.5", "\n", "  x"]
    out = []
    for i in range(n):
        source = rng.choice(["big"] * 5 + ["mid"] * 2 + ["small", None, ""])
        out.append((i, " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 90, 400]))), source))
    return out + [(1000 + i, t, "odd") for i, t in enumerate(ODD)]


@pytest.mark.parametrize("size, window, weights", [(64, 4, None), (1024, 64, None), (100, 3, {"big": 1.0, "small": 3.0}), (64, 4, {"big": 2.0})])
def test_packing_keeps_every_id(spark, size, window, weights):
    rows = texts_of_sources()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, VOCABULARY, size=size, window=window, weights=weights).collect()
    if size & (size - 1) == 0:
        lengths = check_pieces([(d, t) for d, t, _ in rows], pieces, size)
        total = sum(lengths.values())
        assert sum(x < size for x in lengths.values()) <= math.log2(size) and sum(lengths.values()) == total
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, packing.pack(docs.repartition(7), VOCABULARY, size=size, window=window, weights=weights).collect()))


def test_windows_hold_their_targets(spark):
    """At each window's end a source has sent its share of the stream, give or take a packet and what the others lack."""
    rows = [r for r in texts_of_sources(8, 500) if r[2] in ("big", "mid", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, window = 64, 16
    pieces = packing.pack(docs, VOCABULARY, size=size, window=window)
    held = {(r.window, r.source): r.tokens for r in packing.shares(docs, pieces, "source", window).collect()}
    totals = Counter()
    for (_, s), n in held.items():
        totals[s] += n
    whole, sent = sum(totals.values()), Counter()
    last = max(w for w, _ in held)
    assert last > 20
    for w in range(last):
        for s in totals:
            sent[s] += held.get((w, s), 0)
            assert abs(sent[s] - (w + 1) * size * window * totals[s] / whole) <= 2 * size * len(totals)


def test_weighted_windows_until_a_queue_is_dry(spark):
    rows = [(i, "word " * 40, "a" if i % 2 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, VOCABULARY, size=64, window=10, weights={"a": 3.0, "b": 1.0})
    held = {(r.window, r.source): r.tokens for r in packing.shares(docs, pieces, "source", 10).collect()}
    first = [w for w in range(8)]
    assert all(abs(held[w, "a"] / 640 - 0.75) < 0.2 for w in first) and abs(sum(held[w, "a"] for w in first) / 640 / 8 - 0.75) < 0.03
    assert (max(w for w, _ in held), "a") not in held


def brute_order(lengths, totals, credit, width, size, windows):
    """The round-robin itself: each window adds to each queue's credit and sends packets while it lasts."""
    queues = {q: [(row, start, min(size, n - start)) for row, n in rows for start in range(0, n, size)] for q, rows in lengths.items()}
    whole, out, at, sent = sum(totals.values()), [], dict.fromkeys(queues, 0), dict.fromkeys(queues, 0)
    for w in range(windows):
        for q in sorted(queues, key=lambda q: credit[q][1]):
            granted = (w + 1) * width * totals[q] / whole
            while at[q] < len(queues[q]) and (sent[q] + math.floor(queues[q][at[q]][2] * credit[q][0]) < granted or w == windows - 1):
                out.append(queues[q][at[q]])
                sent[q] += queues[q][at[q]][2]
                at[q] += 1
    return out


def test_plan_is_the_round_robin(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLOT", 8)
    monkeypatch.setattr(packing, "SPAN", 2)
    rng = random.Random(9)
    rows = [(i, rng.choice("aab") if i % 9 else None, rng.choice([1, 5, 30, 200]), rng.getrandbits(63)) for i in range(150)]
    frame = spark.createDataFrame(rows, "row long, source string, n long, key long")
    got, total = packing.plan(frame, 16, 4)
    order = [(r.row, r.start, r.length) for r in got.orderBy("place").collect()]
    name = lambda s: "-" if s is None else "+" + s
    lengths = {}
    for row, source, n, key in sorted(rows, key=lambda r: (r[3], r[0])):
        lengths.setdefault(name(source), []).append((row, n))
    hashes = {r.q: (r.u, r.h) for r in spark.createDataFrame([(q,) for q in lengths], "q string").select("q", (F.pmod(F.xxhash64("q"), F.lit(1 << 20)) / float(1 << 20)).alias("u"), F.xxhash64("q").alias("h")).collect()}
    totals = {q: sum(n for _, n in x) for q, x in lengths.items()}
    assert total == sum(totals.values())
    assert order == brute_order(lengths, totals, hashes, 64, 16, -(-total // 64))
    places = [r.place for r in got.orderBy("place").collect()]
    assert places == [0, *np.cumsum([x[2] for x in order])[:-1].tolist()]


def test_cuts_are_the_tokenizer_s(spark):
    encoder, rng = packing.Encoder(open(VOCABULARY, encoding="utf-8").read()), random.Random(10)
    texts = [t or "" for t in ODD] + ["".join(rng.choices(["a", "Zé", " ", "  ", "\n", "'s", "'", ".", ",!", "12", " ", "\xa0", "\x1c", "\x85", "ʼ", "अ", "ा", "²", "_", "’", "ɐ", "éa", "don't", "I'll", "x\u0301"], k=60)) for _ in range(600)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == plain(text)[:-1], text


def test_packing_of_odd_tables(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0
    rows = [(None, "a b", "s"), (None, "a b", "s"), (1, "c", None), (1, "c", None), (1, "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("row", "n", "crc", "ids", "key", "queue", "slot", "window", "place", "a.b")})
    got = packing.pack(docs, VOCABULARY, with_ids=True)
    assert sorted((r.doc_id or 0, r.length) for r in got.collect()) == sorted((d or 0, len(plain(t))) for d, t, _ in rows)
    made = packing.sequences(got).collect()
    assert sorted(x for r in made for x in r.ids) == sorted(x for _, t, _ in rows for x in plain(t))
    with pytest.raises(ValueError):
        packing.pack(docs, VOCABULARY, weights={"s": 0.0})


def test_tokenizers_of_other_kinds_encode_whole_texts():
    told = json.load(open(VOCABULARY, encoding="utf-8"))
    told["pre_tokenizer"]["add_prefix_space"] = True
    encoder = packing.Encoder(json.dumps(told))
    assert not encoder.cuts
    assert np.frombuffer(encoder.encode("one two"), "<u2").tolist() == plain(" one two")[:-1]
