"""Divergence between the word distributions of groups (sources) of each class (language).

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased.  A class keeps the V terms that
occur in at least ``LEAST`` of its documents.  A group gives each kept term, which it holds ``count`` times, the weight
p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), N being its occurrences of kept terms; so does the whole class.
The divergence of weights p and q is floor((p - q)^2 / (p + q)); that of two groups is the sum over all kept terms.

Counting.  A task counts the terms of its documents by group and sends a row for each term and ``HELD`` of them, so the rows
of a frequent term are bounded by such blocks.  Groups' counts are summed first, then a term's groups.

Tiling.  The groups of a class are dealt into blocks of ``BLOCK``.  A class's vocabulary is dealt by hash into chunks of
about ``CHUNK`` terms, numbered within their chunk, and a group's counts of a chunk are packed into one pair of arrays.  Each vector is
replicated to the tiles (pairs of blocks) that its block takes part in; a tile is one task's, which reads its
vectors chunk by chunk, lays them out as a matrix and adds the chunk to the submatrix of its pairs.  Only one chunk's matrix of
two blocks is held at a time, whatever the vocabulary.  Terms that no group of the tile has
differ by the same number for each, so they are counted only.

All arithmetic is in whole numbers: 64 bits, with division in steps of a thousand so that no product overflows
(counts up to 9 * 10^15).

Null text has no terms, null classes and groups are the empty name.  Repeated rows, null and repeated ids are documents of
their own.  Texts of any length are read whole.  A group without kept terms has N = 0, a class without any V = 0 and
divergence 0.  Ties go by the other group's or the term's UTF-8 bytes.  Only the three named columns are read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

LEAST, SCALE, ADDED = 10, 10**9, 2
#: Groups of a block, terms of a chunk on average, and (group, term) entries that a counting task holds at most, about.
BLOCK, CHUNK, HELD = 8, 1 << 11, 1 << 18
TOP = 10

#: Bytes of terms: A-Z lower-cased, a-z, and all from 0x80 on; every other one is a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame, cls: str = "lang", group: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, count, docs), written: occurrences of the term in the group and documents that hold it.

    Each group also has a row of the empty term, which counts nothing.
    """
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    frame = docs.select(name(cls).alias("lang"), name(group).alias("source"), F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b"")).alias("raw"))

    def sent(held: dict) -> pa.RecordBatch:
        rows = [(lang, source, term, n, d) for (lang, source), (terms, within) in held.items() for term, n, d in [(b"", 0, 0), *((t, n, within[t]) for t, n in terms.items())]]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "raw", "count", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms, within = held[lang, source]
                size -= len(terms)
                words = raw.translate(_TERMS).split()
                terms.update(words)
                within.update(set(words))
                size += len(terms)
                if size >= HELD:
                    yield sent(held)
                    held.clear()
                    size = 0
        if held:
            yield sent(held)

    made = frame.mapInArrow(run, "lang string, source string, raw binary, count long, docs long")
    per = made.groupBy("lang", "source", "raw").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return stored(per.select("lang", "source", F.col("raw").cast("string").alias("term"), "count", "docs"), "counts")


def weight(count: Column, n: Column, v: Column, scale: int = SCALE, added: int = ADDED) -> Column:
    """1 + floor(scale * (count + added) / (n + added * v)) of whole numbers; ``scale`` is a power of 1000."""
    rest, by, out = count + F.lit(added).cast("long"), n + F.lit(added).cast("long") * v, F.lit(0).cast("long")
    div = lambda a: F.call_function("div", a, by)
    step = scale
    while step > 1:
        step //= 1000
        out, rest = out + div(rest * 1000) * step, (rest * 1000) % by
    return out + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def weights(counts: np.ndarray, n: np.ndarray, v: int, scale: int = SCALE, added: int = ADDED) -> np.ndarray:
    """``weight`` of a matrix, a row a group."""
    rest, by, out = counts + added, (n + added * v)[:, None], np.zeros_like(counts)
    while scale > 1:
        scale //= 1000
        whole, rest = np.divmod(rest * 1000, by)
        out += whole * scale
    return out + 1


class Audit:
    """Kept terms, groups and vectors of a table of documents; ``pairs`` and ``terms`` read them."""

    def __init__(self, docs: DataFrame, cls: str = "lang", group: str = "source", text: str = "text", least: int = LEAST, block: int = BLOCK, chunk: int = CHUNK):
        self.block = block
        rows = counted(docs, cls, group, text)
        of_term = Window.partitionBy("lang", "term")  # a row a group
        kept = rows.filter("term <> ''").withColumn("of_lang", F.sum("count").over(of_term)).withColumn("in_docs", F.sum("docs").over(of_term)).filter(F.col("in_docs") >= least)
        #: (lang, source, term, count, of_lang): of_lang is the class's count.
        self.kept = stored(kept.select("lang", "source", "term", "count", "of_lang"), "kept")
        words = self.kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        size = self.kept.groupBy("lang", "term").agg(F.first("of_lang").alias("c")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("of_lang_n"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        groups = rows.filter("term = ''").select("lang", "source").join(words, ["lang", "source"], "left").join(size, "lang", "left")
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        #: (lang, source, n, v, of_lang_n, place, blocks), a row a group.
        groups = groups.select("lang", "source", zero("n"), zero("v"), zero("of_lang_n"), place.alias("place"), F.count("*").over(Window.partitionBy("lang")).alias("of"))
        self.groups = stored(groups.withColumn("blocks", F.expr(f"(of + {block - 1}) div {block}")).drop("of"), "groups")
        self.chunk = chunk

    def vectors(self) -> DataFrame:
        """(lang, source, chunk, at, counts): a group's terms of a chunk, by their numbers there, and their counts."""
        terms = self.kept.select("lang", "term").distinct()
        # A row a class; written, so that its size is known and a large class needn't be dealt by its one key.
        sizes = stored(terms.groupBy("lang").agg(F.expr(f"greatest(1, count(*) div {self.chunk})").alias("chunks")), "chunks")
        dealt = self.kept.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
        numbered = dealt.withColumn("at", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
        packed = F.array_sort(F.collect_list(F.struct("at", "count")))
        return numbered.groupBy("lang", "source", "chunk").agg(packed.alias("p")).select("lang", "source", "chunk", F.col("p.at").alias("at"), F.col("p.count").alias("counts"))

    def pairs(self) -> DataFrame:
        """(lang, source, other, value) of all ordered pairs of groups of a class, in either order."""
        block = self.block
        heads = self.groups.select("lang", "source", F.lit(-1).cast("long").alias("chunk"), F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("counts"))
        rows = heads.unionByName(self.vectors()).join(self.groups.select("lang", "source", "n", "v", "place", "blocks"), ["lang", "source"])
        own = F.expr(f"place div {block}")
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.least(own, b).alias("low"), F.greatest(own, b).alias("high")))
        tiles = rows.withColumn("tile", F.explode(others)).select("lang", "tile.low", "tile.high", "chunk", "place", "source", "n", "v", "at", "counts")
        dealt = tiles.repartition("lang", "low", "high").sortWithinPartitions("lang", "low", "high", "chunk", "place")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile, chunk, held, work = None, None, [], None
            for batch in batches:
                for row in batch.to_pylist():
                    if (row["lang"], row["low"], row["high"]) != tile:
                        if work:
                            work.add(held)
                            yield work.rows()
                        tile, chunk, held = (row["lang"], row["low"], row["high"]), row["chunk"], []
                        work = _Tile(*tile, block)
                    if row["chunk"] != chunk:
                        work.add(held)
                        chunk, held = row["chunk"], []
                    held.append(row) if row["chunk"] >= 0 else work.open(row)
            if work:
                work.add(held)
                yield work.rows()

        return dealt.mapInArrow(run, "lang string, source string, other string, value long")

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, term, p, q, value, rank): the terms that a group has oftenest beyond its class's share."""
        rows = self.kept.filter("count > 0").join(self.groups.select("lang", "source", "n", "v", "of_lang_n"), ["lang", "source"])
        rows = rows.withColumn("p", weight(F.col("count"), F.col("n"), F.col("v"))).withColumn("q", weight(F.col("of_lang"), F.col("of_lang_n"), F.col("v"))).filter("p > q")
        rows = rows.select("lang", "source", "term", "p", "q", apart(F.col("p"), F.col("q")).alias("value"))
        # Ranks beyond the last are pruned before the shuffle.
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).filter(F.col("rank") <= top)


class _Tile:
    """The submatrix of two blocks of groups of a class."""

    def __init__(self, lang: str, low: int, high: int, block: int):
        self.lang, self.same, self.groups, self.seen, self.block, self.high = lang, low == high, [], 0, block, high

    def open(self, row: dict) -> None:
        """The groups come first, in order."""
        self.groups.append((row["place"], row["source"], row["n"]))
        self.v = row["v"]
        self.n = np.array([g[2] for g in self.groups], np.int64)
        self.number = {g[0]: i for i, g in enumerate(self.groups)}
        self.sums = np.zeros((len(self.groups),) * 2, np.int64)

    def _pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each group of the lower block, and those that it is to be compared with."""
        upper = [i for i, g in enumerate(self.groups) if g[0] // self.block == self.high]
        for i, g in enumerate(self.groups):
            if self.same or g[0] // self.block != self.high:
                yield i, np.array([j for j in upper if j > i], np.int64)

    def _far(self, p: np.ndarray, times: int = 1) -> None:
        for i, others in self._pairs():
            if len(others):
                d = p[others] - p[i]
                self.sums[i, others] += times * (d * d // (p[others] + p[i])).sum(axis=1)

    def add(self, held: list[dict]) -> None:
        """The vectors of a chunk."""
        if not held:
            return
        of = np.concatenate([np.full(len(r["at"]), self.number[r["place"]], np.int64) for r in held])
        there, column = np.unique(np.concatenate([np.asarray(r["at"], np.int64) for r in held]), return_inverse=True)
        counts = np.zeros((len(self.groups), len(there)), np.int64)
        counts[of, column] = np.concatenate([np.asarray(r["counts"], np.int64) for r in held])
        self.seen += len(there)
        self._far(weights(counts, self.n, self.v))

    def rows(self) -> pa.RecordBatch:
        if self.v > self.seen:  # terms that no group here has
            self._far(weights(np.zeros((len(self.groups), 1), np.int64), self.n, self.v), self.v - self.seen)
        out = [(self.groups[a][1], self.groups[b][1], int(self.sums[i, j])) for i, others in self._pairs() for j in others.tolist() for a, b in ((i, j), (j, i))]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(out), pa.string()), *(pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True))], names=["lang", "source", "other", "value"])


def audit(docs: DataFrame, cls: str = "lang", group: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other groups of the class, part ``term`` the group's own terms."""
    told = Audit(docs, cls, group, text, least)
    pairs = told.pairs().withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")))  # a row a group
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.col("rank").cast("int").alias("rank"))
    return pairs.unionByName(told.terms(top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.col("rank").cast("int").alias("rank")))
