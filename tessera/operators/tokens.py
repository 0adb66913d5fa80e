"""Token rows of texts: ids, cut at a length, and labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that are encoded at once.
BATCH = 256


def token_rows(df: DataFrame, text: str, tokenizer: str | None, most: int, to: str = "ids", labels: str = "labels") -> DataFrame:
    """``df`` without the text, with its ids (at most ``most``) and labels, which are the ids.

    ``tokenizer``: the path of a tokenizer's JSON, read on the driver; None: ids are the text's bytes.  Null texts have no ids.
    """
    kept = [c for c in df.columns if c not in (text, to, labels)]
    raw = F.coalesce(F.col(text), F.lit(""))
    if tokenizer is None:
        digits = F.hex(F.substring(raw.cast("binary"), 1, most))
        n = F.least(F.octet_length(raw), F.lit(most))
        ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
        return df.select(*kept, ids.alias(to)).withColumn(labels, F.col(to))
    with open(tokenizer, encoding="utf-8") as f:
        told = f.read()
    frame = df.select(*kept, raw.alias("raw"))
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{to}` array<int>", f"`{labels}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(told)
        made.encode_special_tokens = True
        made.enable_truncation(most)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids = pa.array([e.ids for e in made.encode_batch(part.column(len(kept)).to_pylist(), add_special_tokens=False)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, ids], names=[*kept, to, labels])

    return frame.mapInArrow(run, schema)
