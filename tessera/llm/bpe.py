"""Byte-level BPE encoding and decoding through a sentencepiece model.

The vocabulary (token bytes and their ranks) is serialised straight into a
sentencepiece BPE model: every byte is mapped to one code point, a piece's score
is its negative rank, and normalisation is the identity.  Merging the best scored
pair first is then merging the lowest rank first, so the ids are the ranks.
Each match of the pre-token pattern is encoded on its own; a pre-token that is
itself a token takes that id without merging, as rank-based encoders do.

Null text counts as empty and gives no ids.  Rows are independent: repeated rows,
ties and columns of any name need no care, an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ddl, placed, quoted

#: Bytes are mapped to the code points from here on, none of which is white space.
FIRST = 0x0100
#: Pre-tokens that a worker remembers.
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def mapped(token: bytes) -> str:
    return "".join(chr(FIRST + b) for b in token)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, payload: bytes | int | float) -> bytes:
    if isinstance(payload, bytes):
        return _varint(number << 3 | 2) + _varint(len(payload)) + payload
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    return _varint(number << 3) + _varint(payload)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model proto of the vocabulary; piece i is the token of rank i.

    The obligatory unknown piece stands last.  It is never produced, since all 256
    single bytes must be tokens.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing[:5]}")
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, mapped(t).encode()) + _field(2, float(-i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, float(-len(tokens))) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no begin, end or padding piece
    out.append(_field(2, trainer))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encodes text and decodes ids; made once in each worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.split = regex.compile(pattern).findall
        self.piece = sentencepiece.SentencePieceProcessor(model_proto=model or model_bytes(ranks))
        self.known = _Known(self)

    def pretoken(self, text: str) -> list[int]:
        raw = text.encode()
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.piece.encode(mapped(raw))

    def encode(self, text: str) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        return list(chain.from_iterable(map(known.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Known(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, text: str) -> list[int]:
        ids = self[text] = self.codec.pretoken(text)
        return ids


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, digests: bool = False) -> DataFrame:
    """``docs`` with the ids of its texts.

    Adds ``ids`` (array of int) and, if asked for, ``decoded`` (binary): the ids
    turned back into bytes.  With ``digests`` it adds ``n_tokens``, ``ids_sha256``
    (of the ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``
    instead, so that no long arrays leave the workers.  The vocabulary is read on
    the driver and travels with the task; columns of the added names are replaced.
    """
    ranks = read_ranks(vocabulary)
    model = model_bytes(ranks)
    added = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else [f"`{ids}` array<int>"] + ([f"`{decoded}` binary"] if decoded else [])
    names = [x.rsplit(" ", 1)[0].strip("`") for x in added]
    kept = [c for c in docs.columns if c not in names]
    frame = docs.select(*placed(docs, kept), F.col(quoted(text)).alias("text"))
    schema = ", ".join(ddl(docs, kept) + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern, model)
        for batch in batches:
            n, rest = batch.num_rows, [batch.column(i) for i in range(len(kept))]
            for at in range(0, max(n, 1), 256):  # so that only few long arrays are held at once
                out: list[list] = [[] for _ in names]
                for value in batch.column(len(kept)).slice(at, 256).to_pylist():
                    got = codec.encode(value or "")
                    if digests:
                        raw = np.array(got, dtype="<u4").tobytes()
                        row = (len(got), hashlib.sha256(raw).hexdigest(), hashlib.sha256(codec.decode(got)).hexdigest())
                    else:
                        row = (got, codec.decode(got)) if decoded else (got,)
                    for column, cell in zip(out, row, strict=True):
                        column.append(cell)
                kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.binary()][: len(names)]
                yield pa.RecordBatch.from_arrays([c.slice(at, 256) for c in rest] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=kept + names)

    return frame.mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of its ids; null ids give null, an id without a token fails."""
    ranks = read_ranks(vocabulary)
    kept = [c for c in docs.columns if c != to]
    schema = ", ".join([*ddl(docs, kept), f"`{to}` binary"])
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sorted(ranks, key=ranks.__getitem__)
        for batch in batches:
            ids = batch.column(at)
            if (least := pc.min(ids.flatten()).as_py()) is not None and least < 0:
                raise IndexError(f"no token has the id {least}")
            values = [None if x is None else b"".join(tokens[i] for i in x) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=[*kept, to])

    return docs.select(*placed(docs, kept)).mapInArrow(run, schema)
