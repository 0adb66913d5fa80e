"""Quality rules: word counts, repetition, and bands of zstandard ratios.

A text is compressed as a whole and in fixed chunks.  Each ratio (compressed
over raw bytes) must lie in the band of its length: text below the band repeats
itself, text above it is noise.  Bands are fixed parameters, so a verdict depends
on the text alone.  The defaults are set from labelled prose: a little below and
well above what sound texts of that length show.

Null text counts as empty: no words, ``base_failed``.  Texts of any length are
read whole.  Rows are independent, so repeated rows, ties and empty tables need no
care; columns with the names of the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ddl, placed, quoted

#: Upper length in bytes, lowest and highest ratio of a whole text of at most that length.
WHOLE = ((200, 0.50, 1.10), (400, 0.50, 0.95), (800, 0.50, 0.88), (1600, 0.47, 0.80), (4096, 0.44, 0.72), (16384, 0.405, 0.66), (65536, 0.37, 0.62), (1 << 62, 0.30, 0.60))
#: The same for a chunk.
CHUNK = ((256, 0.00, float("inf")), (1024, 0.46, 0.98), (1 << 62, 0.40, 0.78))
#: Bytes of a chunk.
CHUNK_BYTES = 4096

ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunk_low double, chunk_high double, bad_chunks double, kept boolean"


@dataclass(frozen=True)
class Bands:
    """The limits of the verdict; ``bad_share`` is the share of chunks that may miss their band."""

    whole: tuple = WHOLE
    chunk: tuple = CHUNK
    chunk_bytes: int = CHUNK_BYTES
    bad_share: float = 0.34
    level: int = 3


def _band(bands: tuple, n: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if n <= most)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), symbols, dup, repeated_words(words)


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n + 2)
    size = len(number)
    if size < 2_000_000:
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        order = np.argsort(keys, kind="stable")
    else:  # the product of three numbers would not fit
        order = np.lexsort((ids[2:], ids[1:-1], ids[:-2]))
        steps = (np.diff(ids[:-2][order]) != 0) | (np.diff(ids[1:-1][order]) != 0) | (np.diff(ids[2:][order]) != 0)
        keys = np.empty(n, np.int64)
        keys[order] = np.concatenate([[0], np.cumsum(steps)])
    same = np.diff(keys[order]) == 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : n + shift] |= hit
    return int(covered.sum())


def assess(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """``docs`` with the columns of ``ADDED``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated 3-word
    windows.  ``kept``: not base_failed, the whole text in its band, and at most
    ``bad_share`` of its chunks out of theirs.
    """
    names = [x.split()[0] for x in ADDED.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    frame = docs.select(*placed(docs, kept), F.col(quoted(text)).alias("text"))
    schema = ", ".join([*ddl(docs, kept), ADDED])
    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in ADDED.split(", ")]

    def judge(value: str | None, compress) -> tuple:
        value = value or ""
        n_words, word_chars, symbols, dup, repeat = base_counts(value)
        failed = n_words < 50 or 100 * repeat > 50 * n_words
        raw = value.encode()
        if not raw:
            return n_words, word_chars, symbols, dup, repeat, failed, None, None, None, None, False
        ratio = len(compress(raw)) / len(raw)
        low, high = _band(bands.whole, len(raw))
        fine = low <= ratio <= high
        ratios, bad = [], 0
        for at in range(0, len(raw), bands.chunk_bytes):
            piece = raw[at : at + bands.chunk_bytes]
            ratios.append(r := len(compress(piece)) / len(piece))
            a, b = _band(bands.chunk, len(piece))
            bad += not a <= r <= b
        share = bad / len(ratios)
        return n_words, word_chars, symbols, dup, repeat, failed, ratio, min(ratios), max(ratios), share, not failed and fine and share <= bands.bad_share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                rows = [judge(x, compress) for x in batch.column(len(kept)).slice(at, 512).to_pylist()]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, 512) for i in range(len(kept))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=kept + names)

    return frame.mapInArrow(run, schema)
