"""Approximate nearest neighbours through a permutation index.

``PIVOTS`` vectors, drawn in the order of a hash of their ids, are the pivots; they
fit the driver and the tasks.  Each vector is represented by the order of its
``PREFIX`` nearest pivots.  The index is written in parts of about ``PART`` vectors; a
part holds for each pivot an inverted file of the vectors that have it in their prefix, and at
which place.  A query reads the files of its own prefix only and adds up the footrule
distance to each vector (displacements of the pivots in both prefixes, a missing pivot
standing behind the last).  The nearest vectors of the part by footrule, ties to
the smaller id, are scored by exact cosine in double precision, and each part gives its best.
How many are scored is fitted when the index is built: ``FIT_QUERIES`` vectors of each of the first ``FIT_PARTS`` parts are asked
against their own part, and as many are scored as bring in ``FOUND`` of their true neighbours there, ``RERANK`` at least; ``rerank`` tells how many.

Every row is indexed.  The given queries go to all parts in blocks, so a task holds
one block and one part.  Equal vectors are one entry, which carries the smallest ids of
its copies, as many as a query may need; thousands of copies cost one candidate.
What the footrule ranks behind the reranked ones is given up; that is what the index
approximates.  A part's best are no nearer than those of all, so the share found there is not above that of all parts, and
doesn't hang on the number of rows; the tests measure it against brute force (``exact``).

Null, zero and non-finite vectors and vectors of another length than most pivots take
no part; nor do rows with a null id.  Repeated rows count once; rows of one id with different
vectors are each an entry, and a query's own id is never found.  Vectors may be of any length
that a part of them fits a task.  Other columns are not looked at, so their names don't
matter.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

PIVOTS, PREFIX, RERANK, PART = 512, 64, 256, 4096
#: Queries of a block; queries and parts by which the share is fitted, and the neighbours that it is to bring in.
BLOCK, FIT_QUERIES, FIT_PARTS, FOUND = 4096, 64, 2, 0.95

#: A packed part or block: ids of its rows (copies' ids of each), vectors over their norms, and the
#: files (of a part: by pivot, their ends, rows and places) or the prefixes (of a block).
_PACKED = "number int, copies array<array<long>>, unit binary, start binary, row binary, place binary"


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector as double) of the rows that take part, repeated rows once."""
    frame = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return frame.filter(F.col("id").isNotNull() & fine)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows over their norms; first over their largest component, so that squares neither vanish nor overflow."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def prefixes(m: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row, nearest first, ties to the smaller."""
    out = []
    for at in range(0, len(m), 1024):
        near = -(_unit(m[at : at + 1024]) @ pivots.T)
        out.append(np.argsort(near, axis=1, kind="stable")[:, :length].astype(np.int32))
    return np.concatenate(out) if out else np.zeros((0, length), np.int32)


class Files:
    """The inverted files of a part: per pivot, the vectors that have it in their prefix."""

    def __init__(self, n: int, length: int, start: np.ndarray, row: np.ndarray, place: np.ndarray):
        self.n, self.length, self.start, self.row, self.place = n, length, start, row, place

    @classmethod
    def of(cls, prefix: np.ndarray, pivots: int) -> Files:
        flat = prefix.ravel()
        order = np.argsort(flat, kind="stable")
        row, place = np.divmod(order, prefix.shape[1])
        return cls(*prefix.shape, np.searchsorted(flat[order], np.arange(pivots + 1)), row.astype(np.int32), place.astype(np.int32))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distance of each vector's prefix from the query's.

        Both prefixes have L places and a missing pivot stands at place L.  Without any
        shared pivot the displacements add up to L * (L + 1); a pivot at places j and r
        takes off (L - j) + (L - r) - abs(j - r) = 2 * (L - max(j, r)).
        """
        begin, end = self.start[query], self.start[query + 1]
        count = end - begin
        at = np.arange(count.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        worst = np.maximum(np.repeat(np.arange(self.length), count), self.place[at])
        return self.length * (self.length + 1) - np.bincount(self.row[at], 2.0 * (self.length - worst), self.n)


class PermutationIndex:
    """``index``, the stored parts, and what a search needs besides."""

    def __init__(self, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: int | None = None):
        spark = vectors.sparkSession
        self.spark, self.k = spark, k
        classes = stored(_classes(usable(vectors, vec_id, vector), k + 1), "vectors")
        n = classes.count()
        chosen = classes.orderBy(F.xxhash64("id"), "id").limit(pivots).select("id", "vector").collect() if n else []
        self.dim = max((len(r.vector) for r in chosen), key=[len(r.vector) for r in chosen].count, default=0)
        self.pivot = _unit(np.array([r.vector for r in chosen if len(r.vector) == self.dim])) if chosen else np.zeros((0, 1))
        self.pivots = len(self.pivot)
        self.prefix = min(prefix, self.pivots)
        self.parts = n // PART + 1
        self.index = stored(self._packed(classes, self.parts, True), "index") if n else None
        #: Vectors of a part that are scored for a query.
        self.rerank = rerank if rerank is not None else max(RERANK, self._fitted()) if n else RERANK

    def _fitted(self) -> int:
        """The footrule rank within their part that ``FOUND`` of the nearest neighbours of a few vectors don't exceed."""
        pivot, length, dim, k = self.pivot, self.prefix, self.dim, self.k

        def ranks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in parts:
                for p in frame.itertuples():
                    unit = np.frombuffer(p.unit).reshape(-1, dim)
                    files = Files(len(unit), length, np.frombuffer(p.start, np.int64), np.frombuffer(p.row, np.int32), np.frombuffer(p.place, np.int32))
                    asked = np.unique(np.linspace(0, len(unit) - 1, FIT_QUERIES).astype(int))
                    out = []
                    for own, prefix in zip(asked.tolist(), prefixes(unit[asked], pivot, length), strict=True):
                        score = unit @ unit[own]
                        score[own] = -np.inf
                        best = np.argsort(-score, kind="stable")[: min(k, len(unit) - 1)]
                        far = files.footrule(prefix) * len(unit) + np.arange(len(unit))
                        out += (np.searchsorted(np.sort(far), far[best]) + 1).tolist()
                    yield pd.DataFrame({"rank": np.array(out, np.int64)})

        few = self.index.filter(F.col("number") < FIT_PARTS).mapInPandas(ranks, "rank long")
        told = sorted(r["rank"] for r in few.collect())  # FIT_PARTS * FIT_QUERIES * k at most
        return told[min(len(told) - 1, int(FOUND * len(told)))] if told else 0

    def _packed(self, rows: DataFrame, number: int, files: bool) -> DataFrame:
        """(id, copies, vector) dealt by hash into ``number`` parts or blocks, each packed into a row."""
        pivot, length, pivots = self.pivot, self.prefix, self.pivots

        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("id", kind="stable")
            unit = _unit(np.stack(part.vector.to_list()))
            prefix = prefixes(unit, pivot, length)
            held = Files.of(prefix, pivots) if files else Files(len(unit), length, np.zeros(0, np.int64), prefix, np.zeros(0, np.int32))
            return pd.DataFrame({"number": [key[0]], "copies": [part.copies.to_list()], "unit": [unit.tobytes()], "start": [held.start.tobytes()], "row": [held.row.tobytes()], "place": [held.place.tobytes()]})

        dealt = rows.filter(F.size("vector") == self.dim).select("id", "copies", "vector", F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias("number"))
        return dealt.groupBy("number").applyInPandas(pack, _PACKED)

    def search(self, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k nearest found of each query, itself left out by id;
        with ``exact``, all vectors are scored: what the index approximates."""
        if not self.pivots:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        k, dim, length, rerank = self.k, self.dim, self.prefix, max(self.rerank, self.k + 1)

        def scan(key: tuple, part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            out = []
            for p, b in [(p, b) for p in part.itertuples() for b in block.itertuples()]:  # one of each
                unit, own = (np.frombuffer(x.unit).reshape(-1, dim) for x in (p, b))
                files = Files(len(unit), length, np.frombuffer(p.start, np.int64), np.frombuffer(p.row, np.int32), np.frombuffer(p.place, np.int32))
                asked = np.frombuffer(b.row, np.int32).reshape(-1, length)
                everyone = np.arange(len(unit))
                for i, (q,) in enumerate(b.copies):
                    here = everyone
                    if not exact and rerank < len(unit):
                        # Rows are in order of ids, so equal distances go to the smaller.
                        here = np.sort(np.argpartition(files.footrule(asked[i]) * len(unit) + everyone, rerank - 1)[:rerank])
                    out += _best(q, here, (unit[here] * own[i]).sum(1), p.copies, k)
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        asked = usable(queries, vec_id, vector).select("id", "vector").distinct().withColumn("copies", F.array("id"))
        blocks = asked.count() // BLOCK + 1
        sent = stored(self._packed(asked, blocks, False), "queries").withColumnRenamed("number", "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        held = self.index.withColumnRenamed("number", "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = held.groupBy("part", "block").cogroup(sent.groupBy("part", "block")).applyInPandas(scan, "query_id long, vec_id long, score double")
        return _top(found, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    pairs = exact.select("query_id", "vec_id")
    n = pairs.count()
    return pairs.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0


def _classes(rows: DataFrame, n: int) -> DataFrame:
    """(vector, id, copies): each distinct vector with its n smallest ids.

    Ids are thinned out in two steps, so no task gathers all copies of a vector.
    """
    smallest = F.expr(f"slice(array_sort(collect_set(id)), 1, {n})")
    first = rows.groupBy("vector", F.expr("pmod(xxhash64(id), 256)").alias("salt")).agg(smallest.alias("ids"))
    return first.groupBy("vector").agg(F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(ids)))), 1, {n})").alias("copies")).select("vector", F.col("copies")[0].alias("id"), "copies")


def _best(query: int, rows: np.ndarray, score: np.ndarray, copies: list, k: int) -> list[tuple]:
    """The k best of a part for a query: best score first, ties to the smaller id."""
    if len(rows) > 4 * k:  # all rows that could be among the first k classes but the query's own
        cut = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
        keep = score >= cut
        rows, score = rows[keep], score[keep]
    pairs = [(-s, i) for r, s in zip(rows.tolist(), score.tolist(), strict=True) for i in copies[r] if i != query]
    return [(query, i, -s) for s, i in sorted(pairs)[:k]]


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; each part has sent k at most."""
    best = found.groupBy("query_id").agg(F.expr(f"slice(array_sort(collect_list(struct(-score as minus, vec_id))), 1, {k})").alias("best"))
    rows = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))
