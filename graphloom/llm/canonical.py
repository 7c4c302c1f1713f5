"""Mapping freely typed values to the entries of a reference list.

The spellings of the entries stand in a BK-tree under the unrestricted Damerau-Levenshtein distance,
a true metric, on their bare letters. A batch of distinct values goes down the tree together: one
distance of a node to all values that reach it at a time, and by the triangle inequality only those
within the threshold of an edge go on.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import Scratch, blank, free_name, unique_join

#: Spellings of a reference list that is broadcast whole; a longer one is searched in shards of this size.
BROADCAST_ENTRIES = 20_000
#: Values that a worker remembers before it starts anew, and values compared with a node at a time.
CACHE, TOGETHER = 200_000, 1024
#: Distinct values, about, that are searched in one shard by one task.
SHARD_VALUES = 50_000
#: Entries below a node of the tree up to which distances are worked out one by one.
FEW = 24
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("абвгдезиіјкмнорстухѕԁһԛԝүαβεικμνορτυχγω", "abbrdeeiijkmhopctyxsdhqwyabeikuvoptuxyw")
_BRACKETS = re.compile(r"[(\[{<][^()\[\]{}<>]*[)\]}>]")
_LABEL = re.compile(r"^\W*\w{1,4}\s*[:>]\s*(?=\w)")


def bare(value: str) -> str:
    """Letters only: compatibility forms, case, accents and look-alikes undone, all else dropped."""
    value = unicodedata.normalize("NFKC", value).casefold()
    value = "".join(c for c in unicodedata.normalize("NFD", value) if c.isalpha())
    return unicodedata.normalize("NFC", value).translate(LOOKALIKES)


def readings(value: str) -> list[str]:
    """The value's bare letters; also without remarks in brackets, and without a short label before a colon."""
    value = unicodedata.normalize("NFKC", value)
    short = _BRACKETS.sub(" ", value)
    out = [bare(v) for v in (value, short, _LABEL.sub("", value), _LABEL.sub("", short))]
    return [*dict.fromkeys(v for v in out if v)]


def threshold(length: int) -> int:
    """Edits allowed for a reading of so many letters: one of three letters, up to three."""
    return 0 if length < 4 else min(3, max(1, length // 3))


def distances(entry: str, codes: np.ndarray, lens: np.ndarray, alphabet: dict[str, int]) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of the entry to rows of character codes (0 after their end)."""
    n, width = codes.shape
    a = [alphabet.get(c, -1) for c in entry]
    far = len(a) + width + 1
    last = np.zeros(max(alphabet.values(), default=0) + 1, np.int64)  # the last row of the entry with a character
    h = np.full((len(a) + 2, width + 2, n), far, np.int16)
    h[1, 1:] = np.arange(width + 1, dtype=np.int16)[:, None]
    h[1:, 1] = np.arange(len(a) + 1, dtype=np.int16)[:, None]
    row = np.arange(n)
    for i, c in enumerate(a, 1):
        column = np.zeros(n, np.int64)
        for j in range(1, width + 1):
            same = codes[:, j - 1] == c
            i1, j1 = last[codes[:, j - 1]], column
            best = np.minimum(h[i, j] + ~same, np.minimum(h[i + 1, j], h[i, j + 1]) + 1)
            h[i + 1, j + 1] = np.minimum(best, h[i1, j1, row] + (i - i1) + (j - j1) - 1)
            column = np.where(same, j, column)
        if c >= 0:
            last[c] = i
    return h[len(a) + 1, lens + 1, row].astype(np.int64)


def distance(a: str, b: str) -> int:
    """As distances, of two strings."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    h = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, c in enumerate(a, 1):
        up, row, column = h[i], [far, i], 0
        for j, x in enumerate(b, 1):
            i1, j1 = last.get(x, 0), column
            if x == c:
                column = j
            best = min(up[j] + (x != c), up[j + 1] + 1, row[j] + 1)
            row.append(min(best, h[i1][j1] + (i - i1) + (j - j1) - 1))
        h.append(row)
        last[c] = i
    return h[-1][-1]


class BkTree:
    def __init__(self, spellings: list[tuple[str, int]]):
        """(bare spelling, entry id); of equal spellings the smallest id stays."""
        best: dict[str, int] = {}
        for text, i in spellings:
            if text:
                best[text] = min(i, best.get(text, i))
        self.texts = sorted(best, key=lambda t: (len(t), t))
        self.texts = self.texts[len(self.texts) // 2 :] + self.texts[: len(self.texts) // 2]  # a root of middle length
        self.ids = [best[t] for t in self.texts]
        self.children: list[dict[int, int]] = [{} for _ in self.texts]
        # All below a node are compared with it at a time; of those at one distance the first is the child.
        todo = [(0, np.arange(1, len(self.texts)))] if self.texts else []
        while todo:
            at, below = todo.pop()
            if len(below) <= FEW:
                d = np.array([distance(self.texts[at], self.texts[k]) for k in below.tolist()], np.int64)
            else:
                d = np.concatenate([distances(self.texts[at], *_codes([self.texts[k] for k in part.tolist()], [])) for part in np.array_split(below, -(-len(below) // TOGETHER))])
            for edge in np.unique(d).tolist():
                same = below[d == edge]
                self.children[at][edge] = int(same[0])
                if len(same) > 1:
                    todo.append((int(same[0]), same[1:]))

    def nearest(self, values: list[str], limits: np.ndarray) -> np.ndarray:
        """For each value the smallest distance * 2**32 + entry id within its limit, or -1."""
        out = np.full(len(values), np.iinfo(np.int64).max)
        if self.texts and values:
            codes, lens, alphabet = _codes(values, self.texts)
            todo = [(0, np.arange(len(values)))]
            while todo:
                at, rows = todo.pop()
                d = distances(self.texts[at], codes[rows, : lens[rows].max()], lens[rows], alphabet)
                hit = d <= limits[rows]
                out[rows[hit]] = np.minimum(out[rows[hit]], d[hit] * 2**32 + self.ids[at])
                for edge, child in self.children[at].items():
                    near = np.abs(d - edge) <= limits[rows]
                    if near.any():
                        todo.append((child, rows[near]))
        return np.where(out == np.iinfo(np.int64).max, -1, out)


def _codes(values: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    alphabet = {c: i for i, c in enumerate(sorted({c for v in (*values, *others) for c in v}), 1)}
    lens = np.array([len(v) for v in values], np.int64)
    codes = np.zeros((len(values), int(lens.max(initial=0))), np.int64)
    for i, v in enumerate(values):
        codes[i, : len(v)] = [alphabet[c] for c in v]
    return codes, lens, alphabet


class Matcher:
    """Nearest entries of raw values; each distinct reading is worked out once."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, tree: BkTree):
        self.tree = tree
        self.longest = max((len(t) for t in self.tree.texts), default=0) + threshold(10**6)
        self._reset()

    def _reset(self) -> None:
        self.values: dict[str, list[str]] = {}
        self.found: dict[str, int] = dict(zip(self.tree.texts, self.tree.ids))  # distance 0: nothing is nearer

    def __call__(self, values: list[str]) -> np.ndarray:
        if len(self.values) > CACHE:
            self._reset()
        for v in values:
            if v not in self.values:
                # No entry is within the threshold of a reading that is longer than all by more than it.
                self.values[v] = [r for r in readings(v) if len(r) <= self.longest]
        new = sorted({r for v in values for r in self.values[v] if r not in self.found}, key=len)
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            for r, f in zip(part, self.tree.nearest(part, np.array([threshold(len(r)) for r in part], np.int64)).tolist()):
                self.found[r] = self.NONE if f < 0 else f
        best = {v: min((self.found[r] for r in self.values[v]), default=self.NONE) for v in set(values)}
        return np.array([-1 if best[v] == self.NONE else best[v] for v in values], np.int64)


def tree_of(spellings: list[tuple[str, int]]) -> BkTree:
    """The tree of raw spellings with their entry ids."""
    return BkTree([(bare(t), i) for t, i in spellings])


def canonicalise(df: DataFrame, value: str, entries: DataFrame, entry_id: str, spelling: str, out: str = "entry_id", limit: int = BROADCAST_ENTRIES) -> DataFrame:
    """Add `out` (int): the entry whose spelling is nearest to the value, ties by smaller id, or -1 if none is within the threshold.

    entries has one row for each spelling; null or letterless spellings are ignored. Values are
    compared by their bare letters (see readings), with threshold() edits allowed. A null, blank or
    letterless value gives -1. All rows and columns are kept, repeated ones too (a column already
    named `out` is replaced); empty tables are fine. A list of at most `limit` spellings is made a tree once, which goes to every worker;
    a longer one is cut into shards by hash, each made a tree once, the distinct values visit every shard in groups of about
    SHARD_VALUES, and the winners of the shards are merged by distance, then id.
    """
    listed = entries.select(F.col(entry_id).cast("long").alias("i"), F.col(spelling).cast("string").alias("t")).filter(~blank("t")).distinct()
    n = listed.count()
    df = df.drop(out)
    if n <= limit:
        tree = tree_of([(r.t, r.i) for r in listed.collect()])

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            match = Matcher(tree)
            for b in batches:
                got = match(["" if v is None else v for v in b])
                yield pd.Series(np.where(got < 0, -1, got & 0xFFFFFFFF).astype(np.int32))

        return df.withColumn(out, F.pandas_udf(run, T.IntegerType(), F.PandasUDFType.SCALAR_ITER)(F.col(value).cast("string")))
    scratch = Scratch(df.sparkSession)
    shards = -(-n // limit)
    values = scratch.write(df.select(F.col(value).cast("string").alias("v")).filter(~blank("v")).distinct())
    salts = max(1, -(-values.count() // SHARD_VALUES))

    def plant(e: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": e["shard"][:1], "tree": [pickle.dumps(tree_of([*zip(e["t"], e["i"])]))]})

    trees = listed.withColumn("shard", F.pmod(F.xxhash64("t"), F.lit(shards))).groupBy("shard").applyInPandas(plant, "shard long, tree binary")
    trees = scratch.write(trees).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    values = values.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).withColumn("shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))

    def shard(v: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        got = Matcher(pickle.loads(t["tree"].iloc[0]))(list(v["v"])) if len(t) else np.full(len(v), -1)
        return pd.DataFrame({"v": v["v"], "got": got})[got >= 0]

    won = values.groupBy("shard", "salt").cogroup(trees.groupBy("shard", "salt")).applyInPandas(shard, "v string, got long")
    at, entry = free_name(df, "value_text"), free_name(df, "entry_found")
    won = won.groupBy("v").agg(F.min("got").alias("got")).select(F.col("v").alias(at), F.expr("cast(got & 4294967295L as int)").alias(entry))
    joined = unique_join(df.withColumn(at, F.col(value).cast("string")), won, at, "left").drop(at)
    return joined.withColumn(out, F.coalesce(entry, F.lit(-1))).drop(entry)
