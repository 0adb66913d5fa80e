"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint has 64 bits.  It is cut into eight segments on a ring.  If two
fingerprints differ in at most ``RADIUS`` = 2 bits, some segment starts a chain in
which every prefix of l segments differs in at most l * 2 / 8 bits: none over the
first three segments, at most one over the first seven, at most two over all.  So
fingerprints are posted under each chain of three whole segments (24 bits), and a
pair that shares such a posting must pass the budgets of the longer chains before
its full Hamming distance is taken.

A posting with more than ``PAIRS_UP_TO`` members is split by the segments that follow its
chain: the next four (32 bits) have a budget of one, so of the two halves of that window at
least one is whole too, and each member is posted again under both halves.  What is left
open halves each time, 16, 8, 4, 2 and 1 bits, until postings are small; the last ones
leave 9 bits free, which no more than 512 different fingerprints can share.  So every link
is found through the ring, at any number of fingerprints.

Copies are one fingerprint from the start.  Classes are found among distinct
fingerprints by alternating large and small stars over stored tables.

Null and empty texts have fingerprint zero and link like any other; texts of any length are
read whole, one at a time.  Repeated rows and ties change nothing.  Columns other than id and
text are not looked at, so their names don't matter.  Rows with a null doc_id keep their fingerprint and take
part in links, but never name a component (null if all of it is null).  An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keyed, one_of_equal, stored

RADIUS, SEGMENTS, CHAIN = 2, 8, 3
PAIRS_UP_TO = 16
#: For each byte value, its eight bits, lowest first.
BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
SEED = 42


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit number.

    Words are runs without ASCII white space, A-Z lower-cased; each ``width``-word
    shingle, repeats included, votes on each bit with its XXH64; a bit is set if
    over half the votes set it.
    """
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[width - 1 :].tolist() if len(words) >= width else [len(joined)]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8").view(np.uint8)
    if n < 64:
        counts = BITS[hashes].reshape(n, 64).sum(0)
    else:
        cells = (hashes.reshape(n, 8).astype(np.int64) + np.arange(8) * 256).ravel()
        counts = (np.bincount(cells, minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: tuple = ()) -> DataFrame:
    """(doc_id, fp) of every row, and the long columns ``also`` of it."""
    frame = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"), *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *also])

    return frame.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


def _differing(x: Column, start: int, length: int) -> Column:
    """Bits that a chain of ``length`` segments from ``start`` has set in ``x``."""
    width = 64 // SEGMENTS
    mask = 0
    for i in range(start, start + length):
        mask |= ((1 << width) - 1) << (i % SEGMENTS * width)
    return F.bit_count(x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))


def within_budgets(x: Column, start: Column) -> Column:
    """Whether the differing bits ``x`` keep within the budget of every chain from ``start``."""
    lengths = [n for n in range(1, SEGMENTS + 1) if n == SEGMENTS or (n + 1) * RADIUS // SEGMENTS > n * RADIUS // SEGMENTS]
    fine = F.lit(False)
    for s in range(SEGMENTS):
        chain = F.lit(True)
        for n in lengths:  # the last length of each budget implies the shorter ones
            chain = chain & (_differing(x, s, n) <= n * RADIUS // SEGMENTS)
        fine = fine | ((start == s) & chain)
    return fine


def _masks() -> list[int]:
    """The bits that must agree, by number start * 64 + node: node 1 is the chain of whole segments
    alone; 2n and 2n + 1 halve what node n leaves open of the window behind the chain (node 1: all of it)."""
    width = 64 // SEGMENTS
    window = max(n for n in range(CHAIN, SEGMENTS) if n * RADIUS // SEGMENTS <= 1) * width - CHAIN * width
    out = []
    for number in range(SEGMENTS * 64):
        start, node = divmod(number, 64)
        level = max(0, node.bit_length() - 1)
        open_ = window >> level
        free = range((node - (1 << level)) * open_, (node - (1 << level) + 1) * open_)
        fixed = [*range(CHAIN * width), *(CHAIN * width + i for i in range(window) if level and i not in free)]
        mask = sum(1 << (start * width + i) % 64 for i in fixed)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _posted(rows: DataFrame) -> DataFrame:
    """(fp, number, bits) of (fp, numbers)."""
    out = rows.select("fp", F.explode("numbers").alias("number"))
    return out.withColumn("bits", F.col("fp").bitwiseAND(F.element_at(F.lit(_masks()), F.col("number") + 1)))


def links(prints: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """The links (u, v), u < v, among ``prints.fp``, which are distinct fingerprints."""
    found = []
    posted = _posted(prints.select("fp", F.array(*[F.lit(s * 64 + 1) for s in range(SEGMENTS)]).alias("numbers")))
    for level in range(6):
        post = ["number", "bits"]
        shared = posted.groupBy(*post).agg(F.count("*").alias("n")).filter("n > 1")
        members = stored(posted.join(shared, post), "postings")
        last = level == 5
        few = members if last else members.filter(F.col("n") <= pairs_up_to)
        pairs = few.groupBy(*post).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        found.append(
            pairs.select("number", "fps", F.posexplode("fps").alias("at", "u"))
            .select("number", "u", F.explode(F.expr("slice(fps, at + 2, size(fps))")).alias("v"))
            .withColumn("x", F.col("u").bitwiseXOR(F.col("v")))
            .filter(within_budgets(F.col("x"), F.floor(F.col("number") / 64)))
            .filter(F.bit_count("x") <= RADIUS)
            .select("u", "v")
        )
        many = members.filter(F.col("n") > pairs_up_to)
        if last or many.isEmpty():
            break
        node, start = F.pmod(F.col("number"), F.lit(64)), F.floor(F.col("number") / 64) * 64
        halves = F.array(*[(start + 2 * node + i).cast("int") for i in (0, 1)])
        posted = _posted(many.select("fp", halves.alias("numbers")).distinct())
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) reaches.

    Alternates large stars (each neighbour above a node moves to the node's smallest
    neighbour) and small stars (all neighbours below move there) until nothing moves.
    Each round is written to the shared folder, so lineage stays short.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "edges")
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u <> v").distinct()
        e = stored(small, "edges")
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _rooted(prints: DataFrame, name: Column, pairs_up_to: int) -> DataFrame:
    """(fp, root, low): the component of each fingerprint, and the least ``name`` of its rows."""
    classes = stored(prints.groupBy("fp").agg(F.min(name).alias("low")), "classes")
    roots = components(links(classes.select("fp"), pairs_up_to))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """One row of each component, as it is: that of the smallest doc_id, a null one last;
    among different rows of that id, that of the least hash."""
    rows, row = keyed(docs)
    prints = stored(fingerprints(rows, doc_id, text, tuple(row)), "fingerprints")
    name = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", *row)
    kept = _rooted(prints, name, pairs_up_to).groupBy("root").agg(F.min("low").alias("low")).select(*[F.col(f"low.{c}").alias(c) for c in row])
    return one_of_equal(rows.join(kept, row, "left_semi"), row).drop(*row)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id."""
    prints = stored(fingerprints(docs, doc_id, text), "fingerprints")
    joined = _rooted(prints, F.col("doc_id"), pairs_up_to)
    named = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    told = stored(joined.join(named, "root").select("fp", "component_id"), "components")
    return prints.join(told, "fp").select("doc_id", "fp", "component_id")
