"""Mixture-controlled packing of token sequences by deficit round-robin.

Documents become token ids and one end id.  Each source (or each named one of ``weights``, all others
together) is a queue, its documents in the order of a hash.  Queues are served in windows of ``WINDOW``
sequences: a window grants each queue its target share of the window's tokens, the queue sends packets
(a document's ``size`` tokens from its start on, the last packet what is left) as long as its credit lasts, and
what a packet takes beyond the credit, or leaves of it, is the deficit that the queue carries into the next
window.  So at each window's end a queue has sent its target, give or take one packet.  A queue
that runs dry hands its share to the others.  Without ``weights`` the targets are the sources' own
shares of all tokens, the only ones that windows can meet to the last; with ``weights`` the targets hold
until a queue runs dry.

No task walks through the queues.  Credit is a function of the words served, so a packet's
window follows from the tokens that stand before it in its queue: prefix sums by slots of a hash,
carried from slot to slot and so across partitions.  The stream is all windows in order, in each one the queues in turn; prefix
sums by slots of windows give each packet's place, and sequences are its stretches of ``size`` tokens.
All but the stream's last, shorter stretch are full; that one is split into powers of two.

Encoding: the tokenizer's file is read on the driver and travels with the task.  If its pre-tokens
end where byte-level ones do, each text is cut before a space that a non-space follows and around white
space, and behind words, where no pre-token crosses, and a worker encodes each distinct cut once.

Null text counts as empty: one token, the end id.  A null source is a queue of its own.  Repeated rows, null and
repeated doc_ids are documents of their own.  Texts of any length are encoded whole; a document's ids must fit in a task.
Special tokens' strings in a text are ordinary text.  An empty table gives no pieces.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SIZE, WINDOW, END = 1024, 64, 0
#: Rows of a slot on average, windows of a slot at least, and slots of windows at most, about.
SLOT, SPAN, SPANS = 2048, 8, 1 << 16
#: Cuts of texts after which a worker turns to remembering new ones.
REMEMBERED = 300_000

#: The code points of Unicode's White_Space.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of whatever version of Unicode.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: A word, if what follows is none of Unicode's further letters; else all up to the next white space; white space.
_CUTS = re.compile(f" ?[{_LETTERS}]+(?=[\x00-@\\[-`{{-\x7f]|\\Z)| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_WORD = re.compile(f" ?[{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """The letter for which byte-level vocabularies write each byte: itself if it is printed, else one from 256 on, in turn."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes texts into little-endian ids by a tokenizer's JSON; ``width`` bytes an id."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.width = width_of(tokenizer)
        told = json.loads(tokenizer)
        first = told.get("pre_tokenizer") or {}
        self.cuts = told.get("normalizer") is None and told.get("post_processor") is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
        self.known = _Known(self)
        self.letters = _byte_letters()

    def word(self, word: str) -> bytes:
        """The ids of one pre-token."""
        told = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return self.packed([t.id for t in told])

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.cuts:
            return self.whole(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.turn()
        return b"".join(map(known.__getitem__, _CUTS.findall(text)))


class _Known(dict):
    """Ids of each cut.  When it is full its cuts become the older ones, of which those met again come back."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, cut: str) -> bytes:
        ids = self.older.get(cut)
        if ids is None:
            ids = self.encoder.word(cut) if _WORD.fullmatch(cut) else self.encoder.whole(cut)
        self[cut] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def _encoder(tokenizer: str) -> Encoder:
    """This worker's encoder; it outlives the task."""
    if tokenizer not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def width_of(tokenizer: str) -> int:
    """Bytes that an id of the tokenizer takes."""
    told = json.loads(tokenizer)
    vocabulary = told["model"]["vocab"]
    ids = list(vocabulary.values()) if isinstance(vocabulary, dict) else [len(vocabulary)]
    return 2 if max(ids + [t["id"] for t in told.get("added_tokens") or []], default=0) < 1 << 16 else 4


def tokenised(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", end: int = END) -> DataFrame:
    """(row, doc_id, source, n, crc, ids), written: ids as little-endian integers, ``end`` the last; row numbers the rows."""
    with open(vocabulary, encoding="utf-8") as f:
        tokenizer = f.read()
    frame = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        last = np.array([end], f"<u{encoder.width}").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.encode(t or "") + last for t in part.column(2).to_pylist()]
                n, crc = [len(x) // encoder.width for x in ids], [zlib.crc32(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "n", "crc", "ids"])

    made = frame.mapInArrow(run, "doc_id long, source string, n long, crc long, ids binary")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "tokens")


def _served(weights: dict[str | None, float], totals: dict[str | None, int]) -> list[tuple[float, float, float]]:
    """(from, words, rate) of the stretches of turns between which queues run dry: at turn v a queue
    has sent weight * v words, and all of them words + rate * (v - from)."""
    out, rate, words, at = [], sum(weights[q] for q, n in totals.items() if n), 0.0, 0.0
    for v, w in sorted((n / weights[q], weights[q]) for q, n in totals.items() if n):
        out.append((at, words, rate))
        words, at, rate = words + rate * (v - at), v, rate - w
    return out or [(0.0, 0.0, 1.0)]


def plan(lengths: DataFrame, size: int = SIZE, window: int = WINDOW, weights: dict[str, float] | None = None, rest: float = 1.0) -> tuple[DataFrame, int]:
    """(row, start, length, place) of each packet in the stream, and the stream's tokens.

    ``lengths`` has (row, source, n, key): documents stand in their queue in the order of key, row.
    ``weights``: of the sources named, which are as few as a parameter holds; ``rest`` is that of all others together.
    """
    named = list(weights or {})
    if weights is not None and min([rest, *weights.values()]) <= 0:
        raise ValueError("weights must be above 0")
    queue = F.col("source") if weights is None else F.when(F.col("source").isin(named), F.col("source"))
    # Null has a queue apart from the empty name.
    rows = lengths.withColumn("queue", F.when(queue.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), queue))).drop("source")
    told = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    if not told.rows:
        none = rows.limit(0)
        return none.select("row", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), F.col("n").alias("place")), 0
    total, bits = told.n, min(30, (told.rows // SLOT).bit_length())
    rows = rows.withColumn("slot", F.shiftrightunsigned(F.col("key"), 64 - bits) if bits else F.lit(0).cast("long"))

    # A row for each slot of a queue: the tokens before it and those of the whole queue.
    slots = stored(rows.groupBy("queue", "slot").agg(F.sum("n").alias("n")), "slots")
    each = Window.partitionBy("queue")
    before = F.sum("n").over(each.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.select("queue", "slot", F.coalesce(before, F.lit(0)).alias("base"), F.sum("n").over(each).alias("of_queue"))
    inside = F.sum("n").over(Window.partitionBy("queue", "slot").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(slots, ["queue", "slot"])
    rows = rows.withColumn("before", F.col("base") + F.col("inside"))

    packets = rows.select("row", "queue", "of_queue", "before", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {size}"))).alias("i"))
    packets = packets.withColumn("start", F.col("i") * size).withColumn("length", F.least(F.lit(size), F.col("n") - F.col("start")))
    # Queues start with a credit of their own, so that small ones don't all send at first.
    credit = F.floor(F.col("length") * (F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) / float(1 << 20)))
    first = F.col("before") + F.col("start")
    if weights is None:
        turn = (first + credit) / F.col("of_queue") * float(total)
    else:
        sums = {r.queue: r.n for r in slots.groupBy("queue").agg(F.max("of_queue").alias("n")).collect()}  # a row for each weight
        share = {"+" + k: float(w) for k, w in weights.items()} | {"-": float(rest)}
        v = (first + credit) / F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("queue"))
        turn = None
        for at, words, rate in _served(share, sums):
            here = F.lit(words) + F.lit(rate) * (v - F.lit(at))
            turn = here if turn is None else F.when(v >= at, here).otherwise(turn)
    width = size * window
    windows = -(-total // width)
    packets = packets.select("row", "start", "length", "queue", first.alias("first"), F.least(F.floor(turn / float(width)), F.lit(windows - 1)).alias("window"))
    span = max(SPAN, windows // SPANS)
    packets = packets.withColumn("slot", F.expr(f"window div {span}"))
    spans = packets.groupBy("slot").agg(F.sum("length").alias("n"))
    spans = spans.select("slot", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    turns = Window.partitionBy("slot").orderBy("window", F.xxhash64("queue"), "queue", "first").rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("inside", F.coalesce(F.sum("length").over(turns), F.lit(0))).join(spans, "slot")
    return placed.select("row", "start", "length", (F.col("base") + F.col("inside")).alias("place")), total


def tail(total: int, size: int) -> list[int]:
    """Starts of the sequences into which what is left of the stream is split, powers of two, the largest first."""
    at, out = total - total % size, []
    while at < total:
        out.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return out


def cut(packets: list[tuple[int, int, int]], size: int, last: list[int], full: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence_id, offset) of a document's pieces, from (start, length, place) of its packets."""
    out: list[list[int]] = []
    for start, length, place in sorted(packets):
        while length:
            if place < full:
                number, begin = place // size, place - place % size
                stop = begin + size
            else:
                k = max(i for i, x in enumerate(last) if x <= place)
                number, begin = full // size + k, last[k]
                stop = last[k + 1] if k + 1 < len(last) else place + length
            take = min(length, stop - place)
            if out and out[-1][2] == number and out[-1][3] + out[-1][1] == place - begin:  # the packet before ends here
                out[-1][1] += take
            else:
                out.append([start, take, number, place - begin])
            start, place, length = start + take, place + take, length - take
    return [tuple(x) for x in out]


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, window: int = WINDOW, weights: dict[str, float] | None = None, rest: float = 1.0, end: int = END, seed: int = 13, doc_id: str = "doc_id", text: str = "text", source: str = "source", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row a piece; ``with_ids`` adds ids (array of int)."""
    tokens = tokenised(docs, vocabulary, doc_id, text, source, end)
    key = F.xxhash64(F.lit(seed), "doc_id", "n", "crc")
    packets, total = plan(tokens.select("row", "source", "n", key.alias("key")), size, window, weights, rest)
    of_row = packets.groupBy("row").agg(F.collect_list(F.struct("start", "length", "place")).alias("packets"))
    both = tokens.select("row", "doc_id", "n", "ids").join(of_row, "row").select("doc_id", "n", "ids", "packets.start", "packets.length", "packets.place")
    last, full = tail(total, size), total - total % size
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
    if with_ids:
        kinds["ids"] = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for named, n, raw, *packed in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                    for start, length, number, offset in cut(list(zip(*packed, strict=True)), size, last, full):
                        own = ids[start : start + length]
                        out.append((named, start, length, zlib.crc32(own), n, number, offset, *([own.astype(np.int32)] if with_ids else ())))
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return both.mapInArrow(run, ", ".join(f"{k} {'array<int>' if k == 'ids' else 'long'}" for k in kinds))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from pieces ``with_ids``; a sequence's pieces hold at most its size."""
    of = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return of.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def shares(docs: DataFrame, pieces: DataFrame, of: Column | str, window: int = WINDOW) -> DataFrame:
    """(window, source, tokens): what each window holds of a source, from pieces joined with (doc_id, source) of ``docs``."""
    sources = docs.select("doc_id", F.col(of).alias("source") if isinstance(of, str) else of.alias("source"))
    return pieces.join(sources, "doc_id").groupBy(F.expr(f"sequence_id div {window}").alias("window"), "source").agg(F.sum("length").alias("tokens"))
