"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the bag of itself and its character n-grams, with marks at both ends, each
hashed to a row of one embedding table.  A passage of ``PASSAGE`` words is the
average of the rows of all its words, and a linear softmax over two classes scores
it.  A misspelling never seen shares n-grams with the word it comes from, so it
scores like it.  Table and softmax are trained jointly in numpy, by Adagrad.

Labels belong to whole texts, but a few words make a text toxic.  So training starts
with all passages under their text's label, then goes on with what the model finds:
the highest scored passage of each toxic text against the highest and some random
passages of the others.  A text's score is that of its highest passage; the zero
point is set between the classes on the texts trained with.

Fitting reads at most ``FIT_TEXTS`` labelled texts of each class (``fit_texts``), and ``FIT_CHARS``
characters in all (``fit_chars``), the first in the order of a hash of their ids, whole, to the
driver; scoring reads every whole text.  Labels, language, source and id are no inputs of a score.

Null and empty texts have the score of a text without any passage, below one half.
Without labels of both classes there is no model, and every score is 0.  Repeated
label rows of a text count once (toxic if any says so), and of different texts of a labelled id
one is learned from.  Columns with the names of
the added ones are replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ddl, placed, quoted, stored

FIT_TEXTS, FIT_CHARS, PASSAGE, DIM, BUCKETS = 1500, 50_000_000, 3, 8, 1 << 17
GRAMS = (3, 4, 5)
#: Epochs of the first phase of training, and rounds of the second.
WARM, ROUNDS = 8, 40
#: Words whose weights a worker remembers, and characters scored at once.
REMEMBERED, CHUNK = 200_000, 1 << 20
#: Words whose n-grams are hashed at once.
SLICE = 1 << 15
STRIPPED = ".,;:!?\"'()[]{}<>|*#-_"


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def features(word: str) -> list[int]:
    """Table rows of a word: itself and its n-grams."""
    word = f"<{word.strip(STRIPPED)}>"
    out = [crc32(word.encode()) % BUCKETS]
    for n in GRAMS:
        out += [crc32(word[i : i + n].encode()) % BUCKETS for i in range(len(word) - n + 1)]
    return out


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of many words one after the other, and how many each word has.

    All n-grams of a slice of words are hashed at once: that of n characters at a place goes on from that of n - 1.
    """
    rows, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), SLICE):
        marked = [f"<{w.strip(STRIPPED)}>" for w in words[at : at + SLICE]]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        # Of each character its bytes in UTF-8, by the number of bytes that are left after each.
        tail = np.searchsorted([0x80, 0x800, 0x10000], points, "right")
        lead = np.array([0, 0xC0, 0xE0, 0xF0], np.uint32)[tail] | points >> (6 * tail).astype(np.uint32)
        longer = [np.flatnonzero(tail >= left) for left in (1, 2, 3)]
        start, end = np.cumsum(size) - size, np.repeat(np.cumsum(size), size)
        place = np.arange(len(points))
        gone = place - np.repeat(start, size)  # characters of the word before this one
        grams = [np.maximum(size - n + 1, 0) for n in GRAMS]
        n_rows = 1 + sum(grams)
        first = np.cumsum(n_rows) - n_rows
        out = np.empty(int(n_rows.sum()), np.int32)
        out[first] = np.fromiter((crc32(w.encode()) % BUCKETS for w in marked), np.int32, len(marked))
        state, base = np.full(len(points), 0xFFFFFFFF, np.uint32), first + 1
        for n in range(1, max(GRAMS) + 1):
            live = len(points) - n + 1  # places that n characters follow, be they of one word or not
            if live <= 0:
                break
            state = state[:live]
            state = _CRC[(state ^ lead[n - 1 :]) & 0xFF] ^ state >> np.uint32(8)
            for left in (3, 2, 1):
                on = longer[left - 1] - (n - 1)
                on = on[on >= 0]
                if len(on):
                    # A character with ``tail`` bytes behind its lead: those with as many left go on by one byte.
                    byte = points[on + n - 1] >> np.uint32(6 * (left - 1)) & 0x3F | 0x80
                    state[on] = _CRC[(state[on] ^ byte) & 0xFF] ^ state[on] >> np.uint32(8)
            if n in GRAMS:
                whole = np.flatnonzero(place[:live] + n <= end[:live])
                out[np.repeat(base, size)[whole] + gone[whole]] = (state[whole] ^ np.uint32(0xFFFFFFFF)) % BUCKETS
                base = base + grams[GRAMS.index(n)]
        rows.append(out)
        counts.append(n_rows)
    return np.concatenate(rows), np.concatenate(counts)


@dataclass
class Model:
    """``weight``: each table row's part of the logit; ``bias``: the softmax's; ``zero``: the logit at which a text's score is one half."""

    weight: np.ndarray
    bias: float
    zero: float

    def score(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit - self.zero, -30, 30))))


class Scorer:
    """Scores texts; each word's part of the logit is worked out once and remembered by number."""

    def __init__(self, model: Model):
        self.model = model
        self.known = _Known(model.weight)

    def logit(self, text: str | None) -> float:
        return float(self.logits([text])[0])

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of a passage of each text."""
        known = self.known
        if len(known) > REMEMBERED:
            known.forget()
        split = [split_words(t) for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        out = np.full(len(split), self.model.bias)
        full = np.flatnonzero(count)
        if len(full):
            word = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
            known.learn()
            passages = -(-count[full] // PASSAGE)
            begin = np.cumsum(count[full]) - count[full]
            first = np.cumsum(passages) - passages
            at = np.repeat(begin - first * PASSAGE, passages) + np.arange(passages.sum()) * PASSAGE
            total, n = (np.add.reduceat(np.frombuffer(x)[word], at) for x in (known.total, known.rows))
            out[full] += np.maximum.reduceat(total / n, first)
        return out


class _Known(dict):
    """Number of each word; ``total`` and ``rows`` hold the sum of its table rows' weights and how many they are, once it is learned."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.total, self.rows, self.fresh = weights, array("d"), array("d"), []

    def forget(self) -> None:
        self.clear()
        self.total, self.rows, self.fresh = array("d"), array("d"), []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        got = self[word] = len(self)
        return got

    def learn(self) -> None:
        """Totals of the words met since, in slices."""
        for at in range(0, len(self.fresh), SLICE):
            rows, n = bags(self.fresh[at : at + SLICE])
            self.total.frombytes(np.add.reduceat(self.weights[rows], np.cumsum(n) - n).astype(np.float64).tobytes())
            self.rows.frombytes(n.astype(np.float64).tobytes())
        self.fresh = []


class _Trainer:
    """Averaged embeddings and softmax with Adagrad; passages are ranges of words."""

    def __init__(self, texts: list[str | None], seed: int = 7):
        rng = np.random.default_rng(seed)
        number: dict[str, int] = {}
        words, self.start = array("i"), [0]
        for t in texts:
            words.extend([number.setdefault(w, len(number)) for w in split_words(t)])
            self.start.append(len(words))
        self.words = np.frombuffer(words, np.int32)
        self.rows, self.length = bags(list(number))
        del number
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.softmax = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = [np.full_like(x, 1e-3) for x in (self.table, self.softmax, self.bias)]
        self.rng = rng

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and past-the-last word and text of each passage."""
        start = np.array(self.start)
        first = [np.arange(a, b, PASSAGE) for a, b in zip(start[:-1], start[1:], strict=True)]
        text = np.repeat(np.arange(len(first)), [len(f) for f in first])
        first = np.concatenate(first) if first else np.zeros(0, np.int64)
        return first, np.minimum(first + PASSAGE, start[text + 1]) if len(first) else first, text

    @staticmethod
    def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(length)[:-1]])
        return np.arange(length.sum()) - np.repeat(at - start, length)

    def step(self, first: np.ndarray, last: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float) -> None:
        n_words = last - first
        # Words that occur often in the batch are worked on once.
        words, place = np.unique(self.words[self._ranges(first, n_words)], return_inverse=True)
        rows = self.rows[self._ranges(self.offset[words], self.length[words])]
        begin = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        n = np.add.reduceat(self.length[words][place], begin)
        of_word = np.add.reduceat(self.table[rows], np.concatenate([[0], np.cumsum(self.length[words])[:-1]]))
        mean = np.add.reduceat(of_word[place], begin) / n[:, None]
        logits = mean @ self.softmax + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        error = (p * weight[:, None] / len(label)).astype(np.float32)
        back = np.repeat((error @ self.softmax.T / n[:, None]).astype(np.float32), n_words, axis=0)
        back = np.add.reduceat(back[np.argsort(place, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(place))[:-1]]))
        back = np.repeat(back, self.length[words], axis=0)
        order = np.argsort(rows, kind="stable")
        sorted_rows = rows[order]
        cut = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        grad, touched = np.add.reduceat(back[order], cut), sorted_rows[cut]
        self.seen[0][touched] += grad**2
        self.table[touched] -= rate * grad / np.sqrt(self.seen[0][touched])
        for value, seen, g in ((self.softmax, self.seen[1], mean.T @ error), (self.bias, self.seen[2], error.sum(0))):
            seen += g**2
            value -= rate * g / np.sqrt(seen)

    def model(self) -> Model:
        return Model((self.table @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0]), 0.0)

    def logits(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        m = self.model()
        bag = np.add.reduceat(m.weight[self.rows], self.offset[:-1]) if len(self.rows) else np.zeros(0)
        total = np.concatenate([[0], np.cumsum(bag[self.words])])
        n = np.concatenate([[0], np.cumsum(self.length[self.words])])
        return (total[last] - total[first]) / (n[last] - n[first]) + m.bias

    def epoch(self, chosen: np.ndarray, label: np.ndarray, first: np.ndarray, last: np.ndarray, rate: float, batch: int = 512) -> None:
        chosen = self.rng.permutation(chosen)
        share = max(1e-6, label[chosen].mean())
        weight = np.where(label == 1, 0.5 / share, 0.5 / max(1e-6, 1 - share))
        for at in range(0, len(chosen), batch):
            c = chosen[at : at + batch]
            self.step(first[c], last[c], label[c], weight[c], rate)


def train(texts: list[str | None], labels: list[int], rounds: int = ROUNDS, warm: int = WARM) -> Model | None:
    """The model of labelled texts; None without both classes."""
    y = np.array(labels, np.int64)
    t = _Trainer(texts)
    first, last, text = t.passages()
    if len(set(y[text].tolist())) < 2:
        return None
    label = y[text]
    rng = np.random.default_rng(11)
    for _ in range(warm):
        pos, neg = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        neg = rng.choice(neg, min(len(neg), 2 * len(pos)), replace=False)
        t.epoch(np.concatenate([pos, neg]), label, first, last, 0.1)
    ends = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    begins = np.concatenate([[0], ends[:-1] + 1])

    def highest(n: int) -> list[np.ndarray]:
        """The highest passage of each text, the second highest and so on; a text with fewer gives its lowest again."""
        order = np.lexsort((t.logits(first, last), text))
        return [order[np.maximum(ends - i, begins)] for i in range(n)]

    for _ in range(rounds):
        top, second = highest(2)
        best = np.unique(np.concatenate([top, second]))
        top = np.unique(top)
        random = rng.choice(np.flatnonzero(label == 0), min((label == 0).sum(), len(top)), replace=False)
        t.epoch(np.concatenate([top[label[top] == 1], best[label[best] == 0], random]), label, first, last, 0.1)
    model = t.model()
    (top,) = highest(1)
    model.zero = _between(t.logits(first, last)[top], y[text[top]])
    return model


def _between(score: np.ndarray, label: np.ndarray) -> float:
    """The cut with the fewest errors, both classes weighing alike; in the middle of its gap."""
    order = np.argsort(score)
    s, y = score[order], label[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    false = np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]]) / max(1, (y == 0).sum())
    cost = missed + 2 * false
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    i = int(best[len(best) // 2])
    return float(s[0] - 1 if i == 0 else s[-1] + 1 if i == len(s) else (s[i - 1] + s[i]) / 2)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", fit_texts: int = FIT_TEXTS, fit_chars: int = FIT_CHARS) -> Model | None:
    """Train on ``labels`` (doc_id, toxic) of ``docs``; leave out of ``labels`` what must not be seen."""
    held = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(toxic).cast("int").alias("__toxic"))
    texts = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    parts = []
    for value in (0, 1):
        # At most fit_texts ids, which the join may send everywhere.
        ids = held.filter(F.col("__toxic") == value).orderBy(F.xxhash64("__id"), "__id").limit(fit_texts)
        parts.append(texts.join(F.broadcast(ids), "__id"))
    # Different texts of an id: the one of the least hash.
    own = parts[0].unionByName(parts[1]).groupBy("__id", "__toxic").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    rows = stored(own.withColumn("__n", F.coalesce(F.length("__text"), F.lit(0))), "labelled")
    # A running sum over at most 2 * fit_texts small rows; of each class an equal share of the characters.
    before = F.sum("__n").over(Window.partitionBy("__toxic").orderBy(F.xxhash64("__id"), "__id"))
    fits = rows.select("__id", "__toxic", "__n").withColumn("__before", before).filter(F.col("__before") <= fit_chars // 2).select("__id")
    rows = rows.join(F.broadcast(fits), "__id").orderBy(F.xxhash64("__id"), "__id").collect()
    return train([r["__text"] for r in rows], [r["__toxic"] for r in rows])


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about ``CHUNK`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        n = len(t or "")
        if run and size + n > CHUNK:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def score(docs: DataFrame, model: Model | None, text: str = "text", to: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    kept = [c for c in docs.columns if c not in (to, predicted)]
    frame = docs.select(*placed(docs, kept), F.col(quoted(text)).alias("text"))
    schema = ", ".join([*ddl(docs, kept), f"`{to}` double", f"`{predicted}` int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                texts = part.column(len(kept)).to_pylist()
                scores = [model.score(x) if t and t.strip() else min(0.49, model.score(model.bias)) for t, x in zip(texts, chain.from_iterable(map(scorer.logits, _chunks(texts))), strict=True)] if model else [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*kept, to, predicted])

    return frame.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are for testing: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
