"""Filling containers of a fixed capacity with items, by first-fit decreasing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import Scratch

#: Items of one group; a group is one task, so this bounds its memory and time.
GROUP_ITEMS = 20_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item (none larger than the capacity), largest first, ties in the given order.

    A tournament tree holds the largest free space below each node, so that the first bin with room is
    found from the root in log2(bins) steps. An item of size 0 goes into the first bin.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if free[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - free[at]
        free[at] -= size
        at //= 2
        while at and (best := max(free[2 * at], free[2 * at + 1])) != free[at]:
            free[at] = best
            at //= 2
    return bins, offsets


def pack(df: DataFrame, key: str, size: str, capacity: int, seed: int = 42, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Put items into containers; gives (key, part, n_parts, part_size, container_group, container, place, start).

    Items are dealt into about rows / group_items groups at random by a hash of key and row content with
    the seed, and each group is packed on its own: first-fit decreasing, ties by key, then part. Only
    key and size are shuffled. No item is split unless it exceeds the capacity; such an item gives full
    parts of the capacity, each alone in a container, and a rest that is packed like an item.

    An item of size 0 or null counts as size 0 and takes a place in the first container of its group. A
    null key is an item like any other; repeated rows are separate items. `place` is the item's
    rank within its container by start, then key; (container_group, container) names a container. An
    empty table gives an empty result. Other columns are left out, so clashing names don't matter.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = df.schema[key].dataType
    items = df.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("s"))
    items = Scratch(df.sparkSession).write(items)  # two numbers a row: what it takes to size them is done once
    groups = max(1, -(-items.count() // group_items))
    items = items.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "k", "s"), F.lit(groups)).cast("int"))
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, T.LongType()) for n in ("part", "n_parts", "part_size")), T.StructField("container_group", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("container", "place", "start"))])

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "k"], ascending=[False, True], kind="stable")
        s = pdf["s"].to_numpy(np.int64)
        n = np.maximum(1, -(-s // capacity))
        row = np.repeat(np.arange(len(s)), n)
        part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        part_size = np.minimum(capacity, s[row] - part * capacity)
        container, start = first_fit_decreasing(part_size, capacity)
        out = pd.DataFrame({key: pdf["k"].to_numpy()[row], "part": part, "n_parts": n[row], "part_size": part_size, "container_group": np.int32(group[0]), "container": container, "place": 0, "start": start})
        order = np.lexsort((part, row, -part_size, start, container))
        c = container[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        place = np.zeros(len(c), np.int64)
        place[order] = np.arange(len(c)) - np.repeat(first, np.diff(np.concatenate([first, [len(c)]])))
        out["place"] = place
        return out

    return items.groupBy("g").applyInPandas(run, schema)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """How well the containers are filled: (containers, tokens, unused_share)."""
    used = packed.groupBy("container_group", "container").agg(F.sum("part_size").alias("used"))
    return used.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.lit(1.0) - F.sum("used") / (F.count("*") * F.lit(capacity))).alias("unused_share"))
