"""Vectors of texts by hashing their character trigrams: stable over processes and engines, without a model.

The text in normal form stands between two spaces; the first 32 bits of the MD5 of each trigram give its place and sign.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text
from graphloom.operators import retrieval

DIM = 128


@lru_cache(maxsize=200_000)
def _place(gram: str) -> tuple[int, int]:
    h = int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return h % DIM, 1 if h // DIM % 2 == 0 else -1


def vectors(keys: list[str]) -> np.ndarray:
    """rows x DIM of texts in normal form; an empty text is all zero."""
    out = np.zeros((len(keys), DIM), np.float32)
    for i, k in enumerate(keys):
        if k:
            padded = f" {k} "
            for j in range(len(padded) - 2):
                place, sign = _place(padded[j : j + 3])
                out[i, place] += sign
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _encode(keys: pd.Series) -> pd.Series:
    return pd.Series([*vectors(["" if k is None else k for k in keys])])


def encode(c: Column) -> Column:
    """The vector of a text, not normalised; null and blank texts are all zero."""
    return _encode(F.coalesce(text.entity_key(c), F.lit("")))


def search(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, nth, row_id, score) with exactly k places for each query: its nearest rows, then empty places with the score 0.0.

    Queries and rows are as in retrieval.top_k; a query without a cosine, as of a zero vector, has empty places only.
    """
    found = retrieval.top_k(queries, rows, key, vector, k)
    places = queries.select(F.col(key).alias("query_id")).filter("query_id is not null").distinct().withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return places.join(found, ["query_id", "nth"], "left").select("query_id", "nth", "row_id", F.coalesce("cos", F.lit(0.0)).alias("score"))
