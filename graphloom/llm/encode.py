"""Token ids of texts by a public byte-level vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.bpe import ByteBpe, load

#: Characters of text that are encoded at a time.
STEP = 2_000_000


def steps(texts: list[str | None]) -> Iterator[slice]:
    """Slices of about STEP characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= STEP:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _lists(bpe: ByteBpe, texts: list[str | None], ids: bool) -> pa.Array:
    parts, lens = [], []
    for s in steps(texts):
        flat, n = bpe.encode_texts(texts[s])
        parts.append(flat if ids else None)
        lens.append(n)
    n = np.concatenate(lens) if lens else np.zeros(0, np.int64)
    if not ids:
        return pa.array(n, pa.int64())
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _with(df: DataFrame, text: str, out: str, ids: bool, name: str, folder: str | None) -> DataFrame:
    kind = T.ArrayType(T.IntegerType()) if ids else T.LongType()
    rest = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name, folder)
        for b in batches:
            arrays = [b.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*arrays, _lists(bpe, b.column(len(rest)).to_pylist(), ids)], names=[*rest, out])

    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, kind)])
    return df.select(*rest, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", out: str = "ids", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Replace the text column by its token ids (array<int>), without special tokens.

    Strings that look like special tokens are ordinary text. An empty and a null text both give an
    empty list; blank texts are encoded like any other. Every row gives one row, repeated ones too; an
    empty table gives an empty table. A column already named `out` is replaced, other columns are
    kept. `folder` holds the vocabulary files on every executor. No shuffle.
    """
    return _with(df, text, out, True, name, folder)


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """As encode, with the number of tokens (bigint) instead of the ids; 0 for an empty or null text."""
    return _with(df, text, out, False, name, folder)
