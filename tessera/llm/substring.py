"""Exact substring deduplication by seed and extend.

A window is ``LENGTH`` = 20 consecutive words of one document.  A word goes if some
window that covers it also starts earlier: in a smaller doc_id, or in the same
document at an earlier word.

Seeds.  Each window picks the leftmost smallest hash among its 5-word grams
(winnowing), so equal windows pick equal seeds at the same offset, and a text of n
words has about n / 8.5 seeds.  Seeds are joined by hash; one that stands alone in
the corpus proves that none of its windows repeats, and is done.

Extension.  Around each repeated seed lie at most 12 words before and 12 behind
that a window of 20 words can take in.  Every window that picked the seed is an
extension of it to the left and right; its 96-bit hash (of its words' XXH3) is posted and the earliest
start of each hash found.  The windows that start later join to maximal repeats:
runs of consecutive starts, each a repeat of 20 words or more.

No pairs are formed, so a passage in n documents costs n rows.  Before each shuffle
a task sends on only the earliest of equal seeds or windows per ``HELD`` rows; the
others are settled where they are.  So the rows of one hash in a task are bounded by
the number of such blocks, however hot a passage is.

Null text has no words.  Texts of any length are read whole.  Empty tables are fine, and
columns other than id and text are not looked at.  Rows with a null doc_id keep all
their words.  Equal rows of a doc_id stand at the same place: neither is earlier.  Different
texts of a doc_id count as one document in which they follow each other, in the order of a
hash (2^31 words at most); no window runs from one into the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .shared import stored, words_count

LENGTH, GRAM = 20, 5
#: Bytes of text hashed at once (a longer text is taken whole), and rows held before they are sent on.
BLOCK_BYTES, HELD = 1 << 21, 1 << 20

#: Odd factors that tell the two halves of a run of words apart, one for each hash.
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word of concatenated texts, the halves of its XXH3, a column each; document numbers of the words."""
    raw, words, sizes = data.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = raw[a:b].split()
        words += own
        sizes.append(len(own))
    halves = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return halves, np.repeat(np.arange(len(sizes)), sizes)


def gram_hashes(words: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hashes of each run of ``length`` words.

    Runs are built by doubling, and mixed at each step: sums of products alone would collide on words that are dealt like
    the Thue-Morse sequence.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd, total, at = _ODD[which], None, 0
    block, size = words, 1
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            part = block[at : at + n]
            total = part if total is None else _mix(total * odd + part)
            at += size
        if length >> (bit + 1):
            block = _mix(block[:-size] * odd + block[size:])
            size *= 2
    return total


def picks(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams, the position of the leftmost smallest."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at, size = grams, np.arange(len(grams)), 1
    while size < width:
        step = min(size, width - size)
        left, right = low[:-step], low[step:]
        later = right < left
        low, at = np.where(later, right, left), np.where(later, at[step:], at[:-step])
        size += step
    return at[:n]


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of consecutive rows of a binary column."""
    values = batch.column(column)
    if values.null_count:
        values = values.fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _places(batch: pa.RecordBatch, at: int, to: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and number within its document of each word; columns 0 and 2 are doc_id and base."""
    # A null id would make all of them floats; such rows have no seeds, so any number will do.
    ids, base = (batch.column(i).slice(at, to - at).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 2))
    first = np.searchsorted(doc, np.arange(to - at))
    return ids[doc], np.arange(len(doc)) - first[doc] + base[doc]


def _send(h1, h2, doc, at, length) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(h1).view(np.int64)), pa.array(np.ascontiguousarray(h2).view(np.int32)), pa.array(np.ascontiguousarray(doc).view(np.int64))]
    columns += [pa.array(np.asarray(x, np.int32)) for x in (at, length)]
    return pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc_id", "at", "len"])


#: len is 0 for a hash that is to be decided elsewhere, else the length of a run that is settled.
_SCHEMA = "h1 long, h2 int, doc_id long, at int, len int"


def _settle(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, at: np.ndarray, all_of_repeated: bool) -> Iterator[pa.RecordBatch]:
    """Send on the earliest of equal hashes; of the others, report the places, which are settled.

    ``all_of_repeated``: report also the earliest of those that repeat here.  Rows are
    sent in the order of their places, which the shuffle compresses better than hashes.
    """
    if not len(h1):
        return
    order = np.lexsort((at, doc, h2, h1))
    s1, s2 = h1[order], h2[order]
    new = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
    ahead = np.sort(order[new])
    yield _send(h1[ahead], h2[ahead], doc[ahead], at[ahead], np.zeros(len(ahead)))
    doc, at = doc[order], at[order]
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[group]) | (at != at[group])
    told = later
    if all_of_repeated:
        repeated = np.zeros(len(order), bool)
        repeated[group[later]] = True
        told = repeated[group]
    doc, at = doc[told], at[told]
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    if len(doc):  # runs of consecutive places are one row; the row's key is its place, so rows spread
        gap = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])
        if all_of_repeated:
            gap[:] = True
        first = np.flatnonzero(gap)
        last = np.concatenate([first[1:], [len(doc)]]) - 1
        yield _send(doc[first].astype(np.int64), at[first].astype(np.int32), doc[first], at[first], at[last] - at[first] + 1)


def _gather(parts: list, rows: tuple[np.ndarray, ...], all_of_repeated: bool, end: bool = False) -> Iterator[pa.RecordBatch]:
    if rows:
        parts.append(rows)
    if parts and (end or sum(len(p[0]) for p in parts) >= HELD):
        yield from _settle(*(np.concatenate([p[i] for p in parts]) for i in range(4)), all_of_repeated)
        parts.clear()


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text as binary, base): base is the number of words of the same id's other texts that stand before."""
    raw = F.col(f"`{text}`").cast("string")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), raw.cast("binary").alias("text"))
    again = texts.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if again.isEmpty():
        return texts.withColumn("base", F.lit(0))
    hashed = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), raw.cast("binary").alias("text"), F.xxhash64(raw.cast("binary")).alias("hash"), words_count(text).cast("int").alias("words"))
    order = Window.partitionBy("doc_id").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    bases = hashed.join(again, "doc_id", "left_semi").select("doc_id", "hash", "words").distinct().withColumn("base", F.sum("words").over(order).cast("int"))
    bases = stored(bases.select("doc_id", "hash", "base"), "bases")
    return hashed.join(bases, ["doc_id", "hash"], "left").select("doc_id", "text", F.coalesce("base", F.lit(0)).alias("base"))


def repeated_seeds(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, seeds): word numbers at which a seed starts that occurs elsewhere too.

    ``docs`` has (doc_id, text as binary, base), no null doc_id.
    """
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        with np.errstate(over="ignore"):
            for batch in batches:
                for at, to, data, offsets in _blocks(batch, 1):
                    hashes, doc = word_hashes(data, offsets)
                    if len(doc) < length:
                        continue
                    grams = gram_hashes(hashes[:, 0], gram, 0)
                    seeds = np.unique(picks(grams, width)[doc[: len(doc) - length + 1] == doc[length - 1 :]])
                    ids, place = _places(batch, at, to, doc)
                    yield from _gather(parts, (grams[seeds], np.zeros(len(seeds), np.uint32), ids[seeds], place[seeds]), True)
            yield from _gather(parts, (), True, end=True)

    sent = docs.mapInArrow(run, _SCHEMA).withColumn("settled", F.col("len") > 0)
    alike = Window.partitionBy("h1", "h2", "settled")
    # The earliest one of each task's blocks comes here; a seed that repeats within a block has been told already.
    return sent.withColumn("n", F.count("*").over(alike)).filter("settled or n > 1").groupBy("doc_id").agg(F.collect_set("at").alias("seeds"))


def later_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, at, len): runs of window starts whose windows also start earlier.

    ``docs`` has (doc_id, text as binary, base, seeds); rows without a doc_id have no seeds.
    """
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        with np.errstate(over="ignore"):
            for batch in batches:
                for at, to, data, offsets in _blocks(batch, 1):
                    hashes, doc = word_hashes(data, offsets)
                    if len(doc) < length:
                        continue
                    first = hashes[:, 0]
                    ids, place = _places(batch, at, to, doc)
                    chosen = np.zeros(len(doc), bool)
                    begin = np.searchsorted(doc, np.arange(to - at))
                    column, base = batch.column(3).slice(at, to - at), batch.column(2).slice(at, to - at).to_numpy()
                    row = np.repeat(np.arange(to - at), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                    seed = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - base[row]
                    own = (seed >= 0) & (seed < np.diff(np.append(begin, len(doc)))[row])  # not those of another text of the id
                    chosen[(seed + begin[row])[own]] = True
                    picked = picks(gram_hashes(first, gram, 0), width)
                    windows = np.flatnonzero((doc[: len(doc) - length + 1] == doc[length - 1 :]) & chosen[picked])
                    if not len(windows):
                        continue
                    h1, h2 = gram_hashes(first, length, 0)[windows], (gram_hashes(hashes[:, 1], length, 1)[windows] >> np.uint64(32)).astype(np.uint32)
                    yield from _gather(parts, (h1, h2, ids[windows], place[windows]), False)
            yield from _gather(parts, (), False, end=True)

    sent = docs.mapInArrow(run, _SCHEMA).withColumn("settled", F.col("len") > 0)
    order = Window.partitionBy("h1", "h2", "settled").orderBy("doc_id", "at")
    return sent.withColumn("nth", F.rank().over(order)).filter("settled or nth > 1").withColumn("len", F.greatest("len", F.lit(1))).select("doc_id", "at", "len")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, text, base, deal), dealt by ``deal``, and (deal, runs) of the documents with later windows.

    ``deal`` is the doc_id, or, so that rows without one don't meet in one task, a hash of the text.
    The texts are dealt once; both joins below use that exchange again, for which
    both must be left joins: an inner one would filter its side before the exchange.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = _texts(docs, doc_id, text)
    texts = every.withColumn("deal", F.coalesce("doc_id", F.xxhash64("text"))).repartition(parts, "deal")
    seeds = repeated_seeds(every.filter("doc_id is not null"), length, gram).withColumnRenamed("doc_id", "deal")
    seeded = texts.join(seeds, "deal", "left").select("doc_id", "text", "base", F.when(F.col("doc_id").isNotNull(), F.col("seeds")).alias("seeds"))
    runs = later_windows(seeded, length, gram)
    return texts, runs.groupBy(F.col("doc_id").alias("deal")).agg(F.collect_list(F.struct("at", "len")).alias("runs"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, digests: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by single spaces;
    with ``digests``, kept_sha256 in place of kept."""
    texts, runs = repeats(docs, doc_id, text, length, gram)
    frame = texts.join(runs, "deal", "left").select("doc_id", "text", "base", F.col("runs.at").alias("at"), F.col("runs.len").alias("len"))
    last = "kept_sha256" if digests else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(start, 512)
                n_words, n_removed, kept = [], [], []
                for named, raw, base, at, run_len in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    words = (raw or b"").split()
                    n_words.append(len(words))
                    if at and named is not None:
                        at, long_ = np.array(at) - base, np.array(run_len)
                        own = (at >= 0) & (at < len(words))
                        step = np.zeros(len(words) + 1, np.int64)
                        np.add.at(step, at[own], 1)
                        np.add.at(step, (at + long_ + length - 1)[own], -1)
                        stay = np.cumsum(step)[:-1] == 0
                        words = [words[i] for i in np.flatnonzero(stay)]
                    n_removed.append(n_words[-1] - len(words))
                    joined = b" ".join(words)
                    kept.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", last])

    return frame.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")
