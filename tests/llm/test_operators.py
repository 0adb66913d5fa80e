"""The dealt operators against brute force and exact round trips, and their odd inputs."""

import hashlib
import json
import os
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, bpe, lines, mixing, quality, queries, sharding, simhash, substring, toolcalls, toxicity
from tessera.llm.lines import Cuckoo, LineIndex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " \n\t", "one", "x" * 5000, "y " * 3000, "né 唐太宗 \x1c\x85   é 🙂 <|endoftext|>", "Don't  stop 123\r\n\n  ok "]


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources[i] if sources else "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return (text or "").encode().split()


def corpus(seed=1, n=60, length=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(1, length))]
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = passage[rng.randint(0, 10) : rng.randint(25, 40)]
        out.append(" ".join(text))
        if i % 7 == 0:
            out.append(out[-1])
    return [*out, "a b " * 50, *ODD]


def brute_substring(texts, length=20):
    seen, out = set(), {}
    for d, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if k in seen:
                gone[i : i + length] = [True] * length
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 1 << 21)
    texts = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(docs(spark, texts), digests=True).collect()}
    assert got == brute_substring(texts)


def test_substring_with_a_null_id_in_the_task(spark):
    texts = corpus(3)
    frame = docs(spark, texts).unionByName(docs(spark, [texts[0]]).withColumn("doc_id", F.lit(None).cast("long"))).coalesce(1)
    for one in (frame, frame.orderBy(F.desc_nulls_first("doc_id")).coalesce(1)):
        rows = substring.deduplicate(one, digests=True).collect()
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows if r.doc_id is not None}
        assert got == brute_substring(texts)
        kept = hashlib.sha256(b" ".join(words(texts[0]))).hexdigest()
        assert [(r.n_removed, r.kept_sha256) for r in rows if r.doc_id is None] == [(0, kept)]


def test_substring_of_repeated_ids(spark):
    """Equal rows are one place; different texts of an id follow each other in the order of their hash."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    p, u, v, x = ([word() for _ in range(n)] for n in (30, 25, 60, 40))
    rows = [(0, p), (1, p + u), (1, v), (1, v), (1, x + p), (2, v[:40] + u), (2, x), (7, x)]
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in rows] + [(None, " ".join(p))] * 2, "doc_id long, text string")
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    seen, want = {}, []
    for d, t in sorted({(d, " ".join(t)) for d, t in rows}, key=lambda r: (r[0], signed(r[1]))):
        w = t.split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (d, t, i)) != (d, t, i):
                gone[i : i + 20] = [True] * 20
        n = sum((a, " ".join(b)) == (d, t) for a, b in rows)
        want += [(d, len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g))] * n
    want += [(None, 30, 0, " ".join(p))] * 2
    assert sorted(map(tuple, substring.deduplicate(frame).collect()), key=str) == sorted(want, key=str)


def test_substring_settles_in_small_blocks():
    """Rows that a task settles itself and those it sends decide alike, whatever the block."""
    h = np.array([5, 5, 7, 5, 9], np.uint64)
    got = list(substring._settle(h, np.zeros(5, np.uint32), np.array([2, 1, 1, 1, 3]), np.array([0, 4, 0, 9, 1]), False))
    sent = [r for b in got for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["at"]) for r in sent if r["len"] == 0) == [(1, 0), (1, 4), (3, 1)]
    assert sorted((r["doc_id"], r["at"]) for r in sent if r["len"]) == [(1, 9), (2, 0)]


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400))
    texts = [*ODD, prose, "same words again " * 100, prose * 9 + "".join(chr(rng.randrange(33, 0x3000)) for _ in range(6000)), "a b c\na b c\nd # $ |\n\n", "one two three one two three"]
    got = {r.doc_id: r for r in quality.assess(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        count = Counter(windows)
        covered = {j + k for j, x in enumerate(windows) if count[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        want = (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        raw, z = (t or "").encode(), zstandard.ZstdCompressor(level=3, write_content_size=False)
        ratio = lambda b: len(z.compress(b)) / len(b)
        band = lambda bands, n: min(x for x in bands if n <= x[0])[1:]
        inside = lambda b, bands: band(bands, len(b))[0] <= ratio(b) <= band(bands, len(b))[1]
        pieces = [raw[j : j + 4096] for j in range(0, len(raw), 4096)]
        if not raw:
            assert (r.ratio, r.chunk_low, r.chunk_high, r.bad_chunks, r.kept) == (None, None, None, None, False)
            continue
        bad = [not inside(x, quality.CHUNK) for x in pieces]
        assert (r.ratio, r.chunk_low, r.chunk_high) == (ratio(raw), min(map(ratio, pieces)), max(map(ratio, pieces)))
        assert r.bad_chunks == sum(bad) / len(bad) and r.kept == (not r.base_failed and inside(raw, quality.WHOLE) and sum(bad) <= 0.34 * len(bad))
    assert got[len(ODD)].kept and not got[len(ODD) + 1].kept


def test_bpe_equals_tiktoken_and_round_trips(spark):
    ranks = bpe.read_ranks(VOCABULARY)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    everything = "".join(map(chr, [*range(1, 0x3000), *range(0xA000, 0xA100)]))
    texts = [*corpus(4), everything, "ab" * 3000]
    for r in bpe.encode(docs(spark, texts), VOCABULARY, public_tokenizers.PATTERN, decoded="decoded").collect():
        assert r.ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    with pytest.raises(Exception, match="no token has the id -1"):
        bpe.decode(spark.createDataFrame([([5, -1],)], "ids array<int>"), VOCABULARY).collect()
    again = bpe.decode(bpe.encode(docs(spark, ODD), VOCABULARY, public_tokenizers.PATTERN), VOCABULARY)
    assert [bytes(r.decoded).decode() for r in again.orderBy("doc_id").collect()] == [t or "" for t in ODD]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_brute_force():
    for t in corpus(5):
        assert simhash.fingerprint((t or "").encode()) & (1 << 64) - 1 == brute_fingerprint(t)


@pytest.mark.parametrize("pairs_up_to", [0, 3, 16])
def test_links_lose_nothing(spark, pairs_up_to):
    """All links, and the components, equal brute force, for postings that are paired at once and ones split to the last."""
    rng = random.Random(6)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            prints.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}))
    for start in (0, 24, 60):  # many that differ close together only
        base = rng.getrandbits(64)
        prints |= {base ^ sum({1 << (start + rng.randrange(10)) % 64 for _ in range(3)}) for _ in range(60)}
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    linked = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2}
    assert sorted(map(tuple, simhash.links(frame, pairs_up_to).collect())) == sorted(linked)
    got = {r.node: r.root for r in simhash.components(simhash.links(frame, pairs_up_to)).collect()}
    classes = {}
    for p in prints:
        classes.setdefault(find(p), set()).add(signed(p))
    want = {p: min(c) for c in classes.values() if len(c) > 1 for p in c}
    assert got == want


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_of_copies_and_empty_texts(spark):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, ["a b c d", "A  b\nC d", None, "", "other words here now"])).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def brute_lines(texts):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    return {d: "\n".join(x for x in (t or "").split("\n") if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == d) for d, t in texts.items()}


def test_line_index_is_reversible(spark):
    rng = random.Random(8)
    pool = [f"Line number {i} with some more text" for i in range(12)] + ["short", "", "  É padded line of some length\t"]
    texts = {d: "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own line {d} {i} goes on here" for i in range(rng.randint(0, 9))) for d in range(40)} | {40: None, 41: "", 42: "\n\n"}
    frame = docs(spark, list(texts.values()))
    index = LineIndex(spark).insert(frame.filter("doc_id < 25"))
    result = lambda part: {r.doc_id: r.text or "" for r in index.clean(part).collect()}
    assert result(frame.filter("doc_id < 25")) == brute_lines({d: t for d, t in texts.items() if d < 25})
    index.insert(frame.filter("doc_id >= 25"))
    assert result(frame) == brute_lines(texts)
    index.delete(frame.filter("doc_id >= 20").select("doc_id"))
    assert result(frame.filter("doc_id < 20")) == brute_lines({d: t for d, t in texts.items() if d < 20})


def test_line_index_of_growing_arrivals(spark):
    """The second arrival overfills the one filter; the third brings a few more blocked keys."""
    lines, texts, index = [f"Repeated line number {i} of the page" for i in range(40)], {}, LineIndex(spark, shards=1)
    for known, n in ((1, 3), (37, 4), (39, 5)):
        added = {len(texts) + i: "\n".join(lines[:known]) for i in range(n)}
        texts |= added
        index.insert(spark.createDataFrame([(d, t) for d, t in added.items()], "doc_id long, text string"))
        (held,) = index._all("filters").collect()
        assert held["items"] == known and Cuckoo.of(held["items"], held.cells).contains(np.array([r.k2 for r in index.blocked().collect()])).all()
        frame = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
        assert {r.doc_id: r.text for r in index.clean(frame).collect()} == brute_lines(texts)


@pytest.mark.parametrize("shard_keys", [4, 1 << 14])
def test_line_index_opened_again_changed_often_and_resharded(spark, monkeypatch, shard_keys):
    """Each change is made on the index opened anew by its path; contents equal brute force throughout."""
    monkeypatch.setattr(lines, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(lines, "MERGE", 3)
    monkeypatch.setattr(lines, "PROBED", 7)
    rng = random.Random(21)
    pool = [f"Shared line number {i} of the whole" for i in range(30)]
    texts, path = {}, LineIndex(spark).path
    table = lambda part: spark.createDataFrame(list(part.items()), "doc_id long, text string")
    for step in range(7):
        index = LineIndex(spark, path, shards=2)
        assert index.version == step
        if step in (3, 5):
            gone = rng.sample(sorted(texts), 6)
            index.delete(spark.createDataFrame([(d,) for d in [*gone, 9999]], "doc_id long"))
            texts = {d: t for d, t in texts.items() if d not in gone}
        else:
            added = {100 * step + i: "\n".join(rng.choices(pool, k=rng.randint(0, 6))) for i in range(12)}
            if step == 6:
                added[gone[0]] = "\n".join(pool[:3])  # deleted before
            again = {d: texts[d] for d in list(texts)[:3]}  # held already: nothing counts twice
            index.insert(table(added | again))
            texts |= added
        assert {r.doc_id: r.text for r in LineIndex(spark, path).clean(table(texts)).collect()} == brute_lines(texts)
    assert index.shards == (2 if shard_keys > 4 else index.shards) and index.vacuum() > 0
    assert {r.doc_id: r.text for r in LineIndex(spark, path).clean(table(texts)).collect()} == brute_lines(texts)


def test_line_index_failed_and_second_writers(spark, monkeypatch):
    texts = {d: "one line that all of them share" for d in range(4)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = LineIndex(spark)
    monkeypatch.setattr(LineIndex, "_built", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.insert(frame)
    monkeypatch.undo()
    assert index.version == 0 and index.tables == []
    other = LineIndex(spark, index.path)
    index.insert(frame)
    with pytest.raises(sharding.Conflict):
        other.insert(frame)
    assert other.version == 1 and {r.doc_id: r.text for r in other.clean(frame).collect()} == brute_lines(texts)


def test_rows_that_share_an_id_lose_only_their_own(spark):
    line = "a line that stands in three documents"
    frame = spark.createDataFrame([(1, f"own first line of the text here\n{line}"), (1, f"{line}\nkeep this unique line, please"), (2, line), (3, line), (None, line), (None, line)], "doc_id long, text string")
    got = LineIndex(spark).deduplicate(frame).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "own first line of the text here"), (1, "keep this unique line, please"), (2, ""), (3, line), (None, line), (None, line)], key=str)


def test_cuckoo_filter():
    rng = np.random.default_rng(9)
    items = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    c = Cuckoo(6000)
    c.insert(items)
    assert c.contains(items).all() and c.contains(rng.integers(-(1 << 63), (1 << 63) - 1, 20000)).mean() < 0.01
    c.delete(items[:2500])
    assert c.contains(items[2500:]).all() and c.contains(items[:2500]).mean() < 0.01 and c.items == 2500


def test_mix_meets_targets(spark):
    rng = random.Random(10)
    texts = ["w " * rng.randint(0, 60) for _ in range(600)] + [None]
    sources = [rng.choice(["a", "a", "a", "a", "b", "ü", None]) for _ in texts]
    got = mixing.mix(docs(spark, texts, sources)).collect()
    assert len(got) == len(texts)
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        size[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    # By hand: weights 3, 1, 2 and 3 in code point order, null last; excess over twice the size is shared again.
    weight, left, free, want = dict(zip(["a", "b", "ü", None], (3, 1, 2, 3), strict=True)), 1.5 * sum(size.values()), ["a", "b", "ü", None], {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 2 * size[s]
            left -= want[s]
            free.remove(s)
    want |= {s: level * weight[s] for s in free}
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 30
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, texts, sources)).collect()))


def brute_rates(rows, target, most=2.0, ridge=0.01):
    """Rates that minimise the dual, by plain descent on all multipliers at once with halved steps."""
    sources = sorted({s for s, _ in rows}, key=str)
    at = np.array([sources.index(s) for s, _ in rows])
    w = np.array([n for _, n in rows], float)
    x = np.log1p(w)
    mean = (w * x).sum() / w.sum()
    z = (x - mean) / np.sqrt((w * x * x).sum() / w.sum() - mean**2)
    t = np.array([target[s] for s in sources])
    full = np.array([t[i] >= most * w[at == i].sum() * (1 - 1e-9) for i in range(len(t))])
    lam, mu = np.zeros(len(t)), 0.0
    for _ in range(4000):  # alternate: each lambda by bisection, then one damped step of mu
        for i in range(len(t)):
            lo, hi = -20.0, 20.0
            if full[i]:
                lam[i] = np.inf
                continue
            for _ in range(60):
                lam[i] = (lo + hi) / 2
                over = (w * np.minimum(most, np.exp(lam[i] + mu * z)))[at == i].sum() > t[i]
                lo, hi = (lo, lam[i]) if over else (lam[i], hi)
        rate = np.minimum(most, np.exp(lam[at] + mu * z))
        off = (w * rate * z).sum() / (w * rate).sum() + ridge * mu
        if abs(off) < 1e-9:
            break
        mu -= 0.5 * off
    return rate


def test_rates_equal_brute_force_and_hold_the_feature(spark):
    rng = random.Random(14)
    rows = [(s, n) for s, many, low in (("a", 150, 1), ("b", 60, 20), (None, 40, 5), ("tiny", 5, 3)) for n in (rng.randint(low, 4 * low + 20) for _ in range(many))]
    got = mixing.mix(docs(spark, ["w " * n for _, n in rows], [s for s, _ in rows])).orderBy("doc_id").collect()
    want = brute_rates(rows, {r.source: r.target for r in got})
    assert np.allclose([r.rate for r in got], want, rtol=2e-3)
    w, x = np.array([n for _, n in rows], float), np.log1p([n for _, n in rows])
    rate = np.array([r.rate for r in got])
    plain = np.array([r.target / r.source_size for r in got])
    shift = lambda r: abs((w * r * x).sum() / (w * r).sum() - (w * x).sum() / w.sum())
    assert shift(rate) < 0.5 * shift(plain) and len({round(r.rate, 6) for r in got}) > 10
    for s in {s for s, _ in rows}:
        of = [r for r in got if r.source == s]
        assert sum(r.rate * r.size for r in of) == pytest.approx(of[0].target, rel=1e-5)
        assert all(r.copies in (int(r.rate), int(r.rate) + 1, round(r.rate)) and r.copies <= 2 for r in of)


def test_permutation_index_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(12)
    m = rng.normal(size=(1500, 32)).round(4)
    m[100:160] = m[7]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] + [1.0] * 31), (2003, [None] + [1.0] * 31), (None, [1.0] * 32), (0, m[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "copies", "vector", "number", "unit", "score")})
    index = ann.PermutationIndex(frame)
    queries = frame.filter("vec_id % 50 = 0")
    found, want = index.search(queries), index.search(queries, exact=True).collect()
    assert ann.recall(found, index.search(queries, exact=True)) >= 0.9 and len(want) == 5 * 30 == found.count()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 100, 150):
        score = unit @ unit[q]
        best = sorted((-round(s, 12), i) for i, s in enumerate(score) if i != q)[:5]
        assert [r.vec_id for r in sorted(want, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in best]
    few = frame.filter("vec_id < 3")
    assert len(ann.PermutationIndex(few).search(few).collect()) == 6
    assert ann.PermutationIndex(few.limit(0)).search(few).collect() == []


@pytest.mark.parametrize("n, dim, part, block", [(9000, 64, 4096, 64), (3000, 300, 1000, 4096)])
def test_permutation_index_of_several_parts_and_blocks(spark, monkeypatch, n, dim, part, block):
    monkeypatch.setattr(ann, "PART", part)
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(15)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, dim)).astype(np.float32))], "vec_id long, embedding array<double>")
    index, queries = ann.PermutationIndex(frame, rerank=256 * part // 4096), frame.filter("vec_id % 50 = 0")
    assert index.index.count() == n // part + 1
    again = ann.PermutationIndex(frame.repartition(7), rerank=256 * part // 4096).search(queries)
    found = index.search(queries)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect())) and found.count() == 5 * n // 50
    got = ann.recall(found, index.search(queries, exact=True))
    print("recall at 5", got)
    assert got >= (0.9 if dim == 64 else 0.6)  # 300 independent dimensions are beyond what an index can find


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_permutation_index_recall_on_the_embeddings(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    vectors = spark.read.parquet(path)
    index, queries = ann.PermutationIndex(vectors), vectors.filter("vec_id % 50 = 0")
    got = ann.recall(index.search(queries), index.search(queries, exact=True))
    print("recall at 5", sf, got)
    assert got >= 0.9


def test_toxicity_generalises(spark):
    rng = random.Random(13)
    bad, fine = ["stupid", "idiot", "worthless", "pathetic"], [f"{a}{b}{c}" for a in "bdfgk" for b in "aeo" for c in ("nder", "lling", "mes", "rton")]

    def text(toxic):
        w = [rng.choice(fine) for _ in range(rng.randint(20, 60))]
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        return " ".join(w)

    y = [i % 3 == 0 for i in range(500)]
    model = toxicity.train([text(t) for t in y], [int(t) for t in y])
    test = [i % 2 == 0 for i in range(100)]
    frame = docs(spark, [text(t) for t in test])
    got = {r.doc_id: r.predicted for r in toxicity.score(frame, model).collect()}
    assert sum(got[i] == t for i, t in enumerate(test)) >= 95
    odd = toxicity.score(docs(spark, [None, "", " ", "bander stupidd kolling fames"]), model).orderBy("doc_id").collect()
    assert [r.predicted for r in odd[:3]] == [0, 0, 0] and odd[3].score > 0.5
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(y)] + [(0, 0), (None, 1)], "doc_id long, toxic long")
    known = docs(spark, [text(t) for t in y])
    one, again = (toxicity.fit(d, labels) for d in (known, known.unionByName(known).repartition(5)))
    assert np.allclose(one.weight, again.weight) and one.zero == again.zero
    assert toxicity.fit(known, labels, fit_texts=0) is None and toxicity.fit(known, labels, fit_chars=10) is None
    assert toxicity.train(["a"], [1]) is None and toxicity.score(frame, None).agg(F.max("score")).first()[0] == 0


def test_tool_calls(spark):
    schemas = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}}}
    calls = [(1, 0, "x", "add", '{"b": 2, "a": 1}'), (1, 2, "y", "add", '{"a": {"$ref": "x"}}'), (1, 4, "z", "add", '{"a": {"$ref": "y"}, "c": 1}'), (1, 6, "p", "add", '{"a": {"$ref": "q"}}'), (1, 7, "q", "add", '{"a": {"$ref": "p"}}'), (2, 0, None, "add", "{"), (2, 1, "u", "nope", None)]
    results = [(1, 1, "x", 'é "3"\n'), (1, 9, "x", "later"), (2, 3, "none", "lost"), (2, 4, None, "lost too")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    got = {x.call_id: x for x in toolcalls.link(c, r, schemas).collect()}
    assert [got[k].depth for k in ("x", "y", "z", "p", "q", None)] == [0, 1, 2, None, None, None]
    assert [got[k].valid for k in ("x", "y", "z", None, "u")] == [True, True, False, False, False]
    assert got["x"].n_results == 2 and got["x"].result_turn == 1 and got["y"].n_results == 0
    assert got["x"].canonical == json.dumps({"id": "x", "name": "add", "arguments": {"a": 1, "b": 2}, "result": 'é "3"\n'}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert toolcalls.orphans(c, r).count() == 2
    assert toolcalls.link(c.limit(0), r.limit(0), schemas).count() == 0


def test_depths_equal_brute_force(spark):
    """Chains, joins of several, cycles and unknown needs; the longest path back, where there is an end."""
    rng = random.Random(17)
    needs = {}
    for conv in range(4):
        for i in range(60):
            back = [(conv, str(j)) for j in rng.sample(range(max(0, i - 6), i), min(i, rng.choice([0, 1, 1, 1, 1, 2, 3])))]
            needs[conv, str(i)] = back
        needs[conv, "20"] = [(conv, "25")]  # may close a cycle
        needs[conv, "40"] = [(conv, "nowhere")]
        for i in range(100, 233):
            needs[conv, str(i)] = [(conv, str(i - 1))] if i > 100 else []

    def depth(node, path=()):
        if node in path or node not in needs:
            return None
        below = [depth(n, (*path, node)) for n in needs[node]]
        return None if None in below else 1 + max(below, default=-1)

    frame = spark.createDataFrame([(c, i, [n for _, n in needs[c, i]]) for c, i in needs] + [(None, "x", []), (1, None, [])], "conv_id long, call_id string, needs array<string>")
    got = {(r.conv_id, r.call_id): r.depth for r in toolcalls.depths(frame.unionByName(frame)).collect()}
    assert got == {n: d for n in needs if (d := depth(n)) is not None} and max(got.values()) == 132 and len(got) < len(needs)


def test_schemas_are_strict(spark):
    assert toolcalls.problem(True, {"enum": [1]}) and toolcalls.problem(1, {"enum": [1, "a"]}) is None
    with pytest.raises(ValueError):
        toolcalls.check_calls(spark.createDataFrame([], "conv_id long, turn long, call_id string, name string, arguments string"), {"t": {"properties": {"a": {"type": "colour"}}}})


def test_shard_store(spark):
    frame = docs(spark, [f"text {1000 + i} " * 20 for i in range(400)] + [None])
    store = sharding.ShardStore(spark, small=500, target=20_000, fanout=3)
    one = store.append(frame.filter("doc_id < 300"), F.floor(F.col("doc_id") / 10))
    two = store.append(frame.filter("doc_id >= 300 or doc_id is null"), F.floor(F.col("doc_id") / 10))
    three = store.compact(frame.schema)
    assert (one, two, three) == (1, 2, 3) and store.version() == 3
    for v, n in ((1, 300), (2, 401), (3, 401)):
        assert store.read(frame.schema, v).select("doc_id").distinct().count() == n
    assert store.manifest(3).count() < store.manifest(2).count()
    with pytest.raises(sharding.Conflict):
        store.log.commit(3, store.manifest(3))
    assert store.vacuum() == 0 and store.vacuum(older_than_s=0) >= 1 and store.read(frame.schema).count() == 401
    assert store.append(frame.limit(0), F.col("doc_id")) == 4 and store.read(frame.schema).count() == 401


def test_shard_store_after_a_crash_and_with_two_writers(spark, monkeypatch):
    frame = docs(spark, [f"text {i}" for i in range(40)])
    one = sharding.ShardStore(spark)
    one.append(frame, F.floor(F.col("doc_id") / 10))
    with monkeypatch.context() as m:
        m.setattr(one.log, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            one.append(frame, F.lit(0))
    assert one.version() == 1 and one.read(frame.schema).count() == 40
    two = sharding.ShardStore(spark, one.path)
    with monkeypatch.context() as m:  # both start from version 1
        m.setattr(two, "version", lambda: 1)
        assert one.append(frame, F.lit(1)) == 2
        with pytest.raises(sharding.Conflict):
            two.append(frame.limit(7), F.lit(1))
    got = two.read(frame.schema)
    assert got.count() == 80 and got.agg(F.sum(F.when(F.col("gen") == 2, 1))).first()[0] == 40 and {r.n_rows for r in got.filter("gen = 2").collect()} == {40}
    assert two.append(frame, F.lit(2)) == 3
    for name in ("gen", "shard", "tier"):
        with pytest.raises(ValueError):
            one.append(frame.withColumn(name, F.lit(1)), F.lit(1))


@pytest.mark.parametrize("run", [
    lambda d: substring.deduplicate(d), lambda d: quality.assess(d), lambda d: bpe.encode(d, VOCABULARY, public_tokenizers.PATTERN), lambda d: toxicity.score(d, None),
    lambda d: LineIndex(d.sparkSession).insert(d).clean(d), lambda d: mixing.mix(d), lambda d: simhash.near_duplicates(d),
])
def test_empty_tables_and_clashing_names(spark, run):
    assert run(docs(spark, []).limit(0)).count() == 0
    extra = docs(spark, ODD).withColumns({c: F.lit(1) for c in ("ids", "score", "kept", "size", "runs", "drop", "part", "fp", "at", "ratio", "base", "z", "x", "rate", "lambda", "bucket", "hash")})
    plain, got = run(docs(spark, ODD)), run(extra)
    columns = [c for c in plain.columns if c != "n_chars"]
    rows = lambda d: sorted((tuple(str(r[c]) for c in columns) for r in d.collect()))
    assert rows(got) == rows(plain) and len(rows(got)) == len(ODD)


def test_null_and_repeated_ids(spark):
    line = "a line that is long enough to count"
    frame = docs(spark, [line] * 5).withColumn("doc_id", F.when(F.col("doc_id") < 2, 1).when(F.col("doc_id") < 4, F.col("doc_id")))
    got = lambda d, *c: sorted([tuple(r[x] for x in c) for r in d.collect()], key=str)
    assert got(substring.deduplicate(frame), "doc_id", "kept") == [(1, line), (1, line), (2, line), (3, line), (None, line)]
    assert got(LineIndex(spark).deduplicate(frame), "doc_id", "text") == [(1, ""), (1, ""), (2, ""), (3, line), (None, line)]
    assert got(simhash.near_duplicates(frame), "doc_id", "component_id") == [(1, 1), (1, 1), (2, 1), (3, 1), (None, 1)]
    mixed = mixing.mix(frame)
    assert got(mixed, "doc_id", "size") == [(1, 8), (1, 8), (2, 8), (3, 8), (None, 8)] and abs(mixed.agg(F.sum("taken")).first()[0] - 60) <= 8
    assert got(bpe.encode(frame, VOCABULARY, public_tokenizers.PATTERN, decoded="back"), "doc_id", "back") == [(1, line.encode())] * 2 + [(2, line.encode()), (3, line.encode()), (None, line.encode())]


def test_pipeline_keeps_one_row_of_each_component(spark):
    own, other, third = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(7, own), (7, own), (3, own), (None, own), (None, other), (None, other), (5, third), (5, "quite another text under the same id"), (None, None), (9, "")]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, own), (None, other), (5, third), (5, rows[7][1]), (9, "")], key=str)


def test_pipeline_mix_of_repeated_and_null_ids(spark):
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "g h i"), (None, "g h i"), (2, "k l m")] * 5], SCHEMA)
    want = Counter()
    for r in mixing.mix(frame).collect():
        want[r.doc_id] += r.copies
    got = corpus_pipeline.mix_sources(spark, frame, "").collect()
    assert Counter(r.doc_id for r in got) == want and len(got) == sum(want.values())
    assert {r.text for r in got} == {"a b c", "d e f", "g h i", "k l m"}


def test_chained_calls_have_an_order(spark, tmp_path):
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "user"]
    rows = [(c, t, r, f'text "{t}"\n') for c in range(3) for t, r in enumerate(roles[c:])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op6_tool_call_linking(spark, str(tmp_path))
    assert sorted((r.conv_id, r.turn, r.depth) for r in got.collect()) == [(0, 1, 0), (0, 3, 1), (0, 5, 2), (0, 7, 3), (1, 0, 0), (1, 2, 1), (1, 4, 2), (1, 6, 3), (2, 1, 0), (2, 3, 1), (2, 5, 2)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.SQL["op6_tool_call_linking"])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    """All stages, each against its own input, with null, repeated and clashing ids, equal rows and odd texts."""
    rng = random.Random(31)
    fine, bad = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeo" for c in ("nder", "lling", "mes", "rton")], ["stupid", "idiot", "worthless"]
    line = "A line that stands in very many documents"
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(fine) for _ in range(rng.randint(5, 60)))
        text += " " + " ".join(rng.choices(bad, k=6)) if i % 4 == 0 else ""
        rows.append((i, f"{text}\n{line if i % 2 else 'An own line of document number ' + str(i)}", "en", rng.choice(["a", "a", "b", None])))
    rows += [rows[1], (1, "other words under the first id again", "en", "b"), (None, rows[3][1], "en", "a"), (None, "nobody knows whose words these are", "xx", "b")]
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(ODD)] + [(2000, "a line by itself\n" + rows[5][1], None, None)]
    frame = spark.createDataFrame([(*r, len(r[1] or ""), "extra", "more") for r in rows], SCHEMA + ", score string, copies string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []

    def kept(df, tag):
        seen.append(stored_(df, tag))
        return seen[-1]

    stored_ = corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, tag: kept(df, tag))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = lambda d: Counter(tuple(r) for r in d.collect())
    toxic, lined, near, mixed = map(whole, seen[:4])
    assert all(d.columns == frame.columns for d in seen[:4])
    # Toxicity: decided by the text alone, most of the planted ones go, the others stay.
    start = whole(frame)
    went = {r[1] for r in start} - {r[1] for r in toxic}
    assert toxic == Counter({r: n for r, n in start.items() if r[1] not in went})
    planted = {r[1] for r in start if r[1] and any(b in r[1].split() for b in bad)}
    assert len(went & planted) >= 0.9 * len(planted) and len(went - planted) <= 3
    # Lines: a document is an id; rows without one stay as they are.
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for r in toxic:
        for x in (r[1] or "").split("\n") if r[0] is not None else ():
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(r[0])
    want = Counter()
    for r, n in toxic.items():
        text = r[1] if r[0] is None or r[1] is None else "\n".join(x for x in r[1].split("\n") if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == r[0])
        want[r[0], text, r[2], r[3], None if text is None else len(text), *r[5:]] += n
    assert lined == want and lined != toxic
    # Near duplicates: one row of each component, that of the smallest id.
    prints = {r: brute_fingerprint(r[1]) for r in lined}
    groups = []
    for r in lined:
        near_ones = [g for g in groups if any((prints[r] ^ prints[x]).bit_count() <= 2 for x in g)]
        groups = [g for g in groups if g not in near_ones] + [sum(near_ones, [r])]
    assert sum(near.values()) == len(near) == len(groups)
    for g in groups:
        (stays,) = [r for r in g if r in near]
        assert stays[0] == min((x[0] for x in g if x[0] is not None), default=None)
    # Mix: whole rows, as often as their copies; the sources' words come near the targets.
    copies = mixing.mix(seen[2])
    assert set(mixed) <= set(near) and sum(mixed.values()) == copies.agg(F.sum("copies")).first()[0]
    target = {r.source: r.target for r in copies.select("source", "target").distinct().collect()}
    for s, t in target.items():
        assert abs(sum(len(words(r[1])) * n for r, n in mixed.items() if r[3] == s) - t) <= 60
    # Tokens of every row.
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    ids = lambda t: reference.encode_ordinary(t or "")
    want = Counter()
    for r, n in mixed.items():
        want[r[0], len(ids(r[1])), hashlib.sha256(np.array(ids(r[1]), "<u4").tobytes()).hexdigest()] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out) == want


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
