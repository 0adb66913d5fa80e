"""Periodic runs of words: found by lag counting, collapsed to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), at
least max(``LEAST``, ``TIMES`` * q) long, that neither neighbouring word extends.

Lag counts.  The number of places at which a text agrees with itself moved by q is the sum over its words of
how often each one meets itself q later.  Frequent (heavy) words give theirs as autocorrelation of their
places, by a Fourier transform whose results are whole numbers far below its error; rare (light) words
by the differences of their pairs of places.  A run of period q is an island of length - q
agreeing places, so only lags with that many agreements are scanned.

Island scans.  A short lag is compared in full.  A long one is probed: an island that long covers a
probe at every multiple of its least length; a probe that agrees, and does so for the next few
places on a side, is extended to its island.  Probes within a known run whose period divides the lag lead
to that run again, and are left out.  An island with the ends of a run of smaller period is that run.

Each document is worked on by itself, so there is no shuffle.  Null text has no words.  Texts of any length
are read whole; a document's words and their transform (about 100 bytes a word) must fit in a worker.  Repeated
rows, null ids and extra columns pass through, columns of the added names are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 6, 4
#: Lags up to this one are compared in full; places next to a probe that must agree on one side.
SHORT, BESIDE = 32, 8


def coded(words: list) -> tuple[np.ndarray, int]:
    """Words as numbers, equal for equal words, and how many there are."""
    numbers: dict = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), len(numbers)


def lag_counts(codes: np.ndarray, kinds: int, most: int, heavy: float | None = None) -> np.ndarray:
    """Number of agreeing places of each lag from 0 (not counted) to ``most``; a word with more than ``heavy`` places is heavy."""
    n, counts = len(codes), np.zeros(most + 1, np.int64)
    often = np.bincount(codes, minlength=kinds)
    heavy = max(8.0, (n * np.log2(n + 1)) ** 0.5 / 4) if heavy is None else heavy
    # A heavy word has more than ``heavy`` places, so there are fewer than n / heavy of them.
    frequent = np.flatnonzero(often > heavy)
    if len(frequent):
        width = 1 << int(n + most).bit_length()
        power, at_once = None, max(1, (1 << 18) // width)
        for k in range(0, len(frequent), at_once):
            there = (codes[None, :] == frequent[k : k + at_once, None]).astype(np.float64)
            spectrum = np.fft.rfft(there, width, axis=1)
            part = (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
            power = part if power is None else power + part
        counts += np.rint(np.fft.irfft(power, width)[: most + 1]).astype(np.int64)
    rare = (often <= heavy) & (often > 1)
    places = np.flatnonzero(rare[codes])
    if len(places):
        places = places[np.argsort(codes[places], kind="stable")]
        of, first, step = codes[places], np.arange(len(places)), 1
        while len(first := first[first + step < len(places)]):
            apart = places[first + step] - places[first]
            near = (of[first + step] == of[first]) & (apart <= most)
            first = first[near]
            counts += np.bincount(apart[near], minlength=most + 1)
            step += 1
    counts[0] = 0
    return counts


def _reach(codes: np.ndarray, at: int, lag: int, step: int) -> int:
    """Agreeing places from ``at`` on, to the right (step 1) or to the left of it (step -1)."""
    n, done, width = len(codes), 0, 64
    while True:
        if step > 0:
            to = min(at + done + width, n - lag)
            same = codes[at + done : to] == codes[at + done + lag : to + lag]
        else:
            to = max(0, at - done - width)
            same = (codes[to : at - done] == codes[to + lag : at - done + lag])[::-1]
        if not len(same):
            return done
        if not same.all():
            return done + int(np.argmin(same))
        done, width = done + len(same), width * 2


def islands(codes: np.ndarray, lag: int, least: int, known: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(first place, end of the stretch of words) of each island of at least ``least`` agreeing places.

    ``known``: (start, end) of runs whose period divides the lag; their own islands may be missing.
    """
    n = len(codes) - lag
    if lag <= SHORT:
        same = np.zeros(n + 2, np.int8)
        same[1:-1] = codes[lag:] == codes[:-lag]
        edges = np.flatnonzero(np.diff(same))
        first, end = edges[::2], edges[1::2]
        long_ = end - first >= least
        return list(zip(first[long_].tolist(), (end[long_] + lag).tolist(), strict=True))
    at = np.arange(0, n, least)
    at = at[codes[at] == codes[at + lag]]
    for start, end in known:
        at = at[(at < start) | (at + lag >= end)]
    right, left = np.ones(len(at), bool), np.ones(len(at), bool)
    for k in range(1, BESIDE + 1):
        for side, there in ((right, at + k), (left, at - k)):
            within = (there >= 0) & (there < n)
            there = np.where(within, there, 0)
            side &= within & (codes[there] == codes[there + lag])
    out, done = [], -1
    for x in at[right | left].tolist():
        if x < done:
            continue
        first, done = x - _reach(codes, x, lag, -1), x + _reach(codes, x, lag, 1)
        if done - first >= least:
            out.append((first, done + lag))
    return out


def runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period.  ``times`` is 4 or more, ``least`` 2 or more."""
    n = len(words)
    if n < max(least, times):
        return []
    codes, kinds = coded(words)
    if kinds == n:
        return []
    most = n // times
    lags = np.arange(most + 1)
    enough = np.maximum(least - lags, (times - 1) * lags)
    counts = lag_counts(codes, kinds, most)
    scanned = np.flatnonzero(counts[1:] >= enough[1:]) + 1
    out, seen, dividing = [], set(), defaultdict(list)
    wanted = set(scanned.tolist())
    for lag in scanned.tolist():
        for first, end in islands(codes, lag, int(enough[lag]), dividing.pop(lag, ())):
            if (first, end) not in seen:
                seen.add((first, end))
                out.append((first, end - first, lag))
                for multiple in range(2 * lag, (end - first) // times + 1, lag):
                    if multiple in wanted:
                        dividing[multiple].append((first, end))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not found:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0)]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; of equal ones that with the smallest start, then period."""
    best = None
    for r in found:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def detect(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES, digests: bool = False) -> DataFrame:
    """``docs`` with n_runs, the strongest run's start, length, period and exponent_milli, and runs (array) and
    collapsed (text); with ``digests`` runs_sha256 and collapsed_sha256 in place of the last two and of the text."""
    added = {k: pa.int64() for k in ("n_runs", "start", "length", "period", "exponent_milli")}
    run_kind = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
    added |= {"runs_sha256": pa.string(), "collapsed_sha256": pa.string()} if digests else {"runs": pa.list_(run_kind), "collapsed": pa.string()}
    kept = [c for c in docs.columns if c not in added and not (digests and c == text)]
    # Columns go by their places, so that any names will do; the text's bytes come last.
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b"")).alias("raw"))
    quoted = [c.replace("`", "``") for c in kept]
    schema = ", ".join([f"`{q}` {docs.schema[c].dataType.simpleString()}" for q, c in zip(quoted, kept, strict=True)] + [f"{k} {'array<struct<start:long,length:long,period:long>>' if k == 'runs' else 'long' if v == pa.int64() else 'string'}" for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for raw in part.column(len(kept)).to_pylist():
                    words = raw.split()
                    found = runs(words, least, times)
                    left, best = b" ".join(collapsed(words, found)), strongest(found)
                    row = (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4))
                    if digests:
                        told = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
                        out.append((*row, hashlib.sha256(told).hexdigest(), hashlib.sha256(left).hexdigest()))
                    else:
                        out.append((*row, [{"start": s, "length": n, "period": p} for s, n, p in found], left.decode()))
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), added.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*kept, *added])

    return frame.mapInArrow(run, schema)
