"""Nearest vectors by cosine, with collision-counting hashing.

Equal vectors are collapsed first. The distinct directions are sharded into cells around pivots, a bounded
sample of the vectors themselves, so that dense regions have more pivots; each vector goes to the pivots that are
almost as near as its nearest one. Within a cell every vector is a query: the projections on each of LINES
orthogonal lines stand in a sorted array, windows centred on the query are widened level by level (virtual
rehashing), and a vector that falls into at least HITS windows of the level is verified by its exact
cosine. A query ends at the level at which it has its k verified neighbours within the level's distance. At the last
level the window is 1.5 times the distance that belongs to the least cosine, so that a vector at
exactly this distance collides on about 0.87 of the lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import Scratch, free_name, hashed_share, unique_join

SEED = 7
#: Sorted arrays of a cell, collisions that make a candidate, and window widths as shares of the last.
LINES, HITS, LEVELS, SPREAD = 24, 15, (0.4, 1.0), 1.5
#: Pivots are PIVOTS * sqrt(n), MOST_PIVOTS at most: the bounded sample on which the index is fitted. Of those that are as near to each other as THIN one is left.
PIVOTS, MOST_PIVOTS, THIN = 5, 40_000, 0.9
#: A vector lies in the cells of the pivots whose cosine is within MARGIN of its best one, MOST_CELLS at most.
MARGIN, MOST_CELLS = 0.08, 8
#: A cell of more vectors is cut into blocks of this size, each pair of which is a task of its own.
BLOCK = 8192
#: Pairs counted at a time, and pairs verified at a time.
COUNT, VERIFY = 100_000, 20_000
#: Share of candidates in a block above which a product of matrices is the cheaper way to their cosines.
DENSE = 0.03


def pivots_for(n: int) -> int:
    return max(1, min(MOST_PIVOTS, n, round(PIVOTS * math.sqrt(n))))


def thin(unit: np.ndarray) -> np.ndarray:
    """The vectors without those that are within THIN of an earlier one, so that a narrow cone is one cell."""
    gone = np.zeros(len(unit), bool)
    for at in range(0, len(unit), 2000):
        near = unit[at : at + 2000] @ unit.T >= THIN
        for i in np.flatnonzero(near.sum(1) > 1).tolist():
            if not gone[at + i]:
                gone[at + i + 1 :] |= near[i, at + i + 1 :]
    return unit[~gone]


@lru_cache(maxsize=None)
def lines(dim: int) -> np.ndarray:
    """Random directions, orthogonal as far as the dimension allows, on which the difference of unit vectors has their distance as its scale."""
    rng = np.random.default_rng(SEED)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-LINES // dim))]
    return (np.concatenate(turns, axis=1)[:, :LINES] * math.sqrt(dim)).astype(np.float32)


def assign(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """rows x MOST_CELLS pivots of each vector, the nearest first, -1 where there are fewer."""
    most = min(MOST_CELLS, len(pivots))
    out = np.full((len(unit), MOST_CELLS), -1, np.int32)
    for at in range(0, len(unit), 2000):
        cos = unit[at : at + 2000] @ pivots.T
        near = np.argpartition(-cos, most - 1, axis=1)[:, :most] if most < len(pivots) else np.tile(np.arange(most), (len(cos), 1))
        held = np.take_along_axis(cos, near, 1)
        order = np.argsort(-held, axis=1, kind="stable")
        near, held = np.take_along_axis(near, order, 1), np.take_along_axis(held, order, 1)
        out[at : at + 2000, :most] = np.where(held >= held[:, :1] - MARGIN, near, -1)
    return out


class Cell:
    """The vectors of one cell, or of two blocks of it, with the sorted arrays of their projections."""

    def __init__(self, raw: np.ndarray, cells: np.ndarray, rep: np.ndarray, cell: int, k: int, least: float):
        self.unit = raw / np.linalg.norm(raw, axis=1)[:, None]
        self.cells, self.rep, self.cell, self.k, self.least = cells, rep, cell, k, least
        self.reach = math.sqrt(max(0.0, 2 - 2 * least))
        self.proj = np.ascontiguousarray((self.unit.astype(np.float32) @ lines(raw.shape[1])).T)

    def first_met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether this cell is the first of those that the two vectors share."""
        x, y = self.cells[a], self.cells[b]
        shared = (x[:, :, None] == y[:, None, :]).any(2) & (x >= 0)
        return np.where(shared, x, np.iinfo(np.int32).max).min(1) == self.cell

    def verify(self, queries: np.ndarray, objects: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, object, cosine) of the candidates that reach the least cosine, rows and columns being places in queries and objects.

        Where many of the block are candidates their cosines are taken from one product of the block.
        """
        q, c = np.nonzero(hit)
        if len(q) > DENSE * hit.size:
            cos = (self.unit[queries] @ self.unit[objects].T)[q, c]
        else:
            cos = np.zeros(len(q))
            for at in range(0, len(q), VERIFY):
                s = slice(at, at + VERIFY)
                cos[s] = np.einsum("ij,ij->i", self.unit[queries[q[s]]], self.unit[objects[c[s]]])
        cos = np.round(cos, 6)
        near = (cos >= self.least) & (queries[q] != objects[c])
        return q[near], c[near], cos[near]

    def search(self, queries: np.ndarray, objects: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, neighbour, cosine), at most k for each query: windows on the sorted arrays of the objects, level by level."""
        n, found = len(objects), []
        objects = objects[np.argsort(self.rep[objects], kind="stable")]
        order = np.argsort(self.proj[:, objects], axis=1, kind="stable")
        arrays = np.take_along_axis(self.proj[:, objects], order, 1)
        rank = np.empty((LINES, n), np.uint16)
        np.put_along_axis(rank, order, np.arange(n, dtype=np.uint16)[None, :], 1)
        width = np.array([SPREAD * self.reach * level for level in LEVELS], np.float32)
        # The windows of all queries, by level and line: places from low to high - 1 of the sorted array.
        low, span = np.empty((2, len(LEVELS), LINES, len(queries)), np.uint16)
        for line in range(LINES):
            centre = self.proj[line, queries]
            low[:, line] = np.searchsorted(arrays[line], centre - width[:, None], "left")
            span[:, line] = np.searchsorted(arrays[line], centre + width[:, None], "right")
        span -= low
        step = max(8, COUNT // max(1, n))
        place, inside, total = np.empty((step, n), np.uint16), np.empty((step, n), bool), np.empty((step, n), np.uint8)
        for start in range(0, len(queries), step):
            todo = np.arange(start, min(len(queries), start + step))
            for at, level in enumerate(LEVELS):
                m = len(todo)
                count, own, wide = total[:m], low[at][:, todo, None], span[at][:, todo, None]
                count[:] = 0
                for line in range(LINES):
                    np.subtract(rank[line], own[line], out=place[:m])  # smaller places wrap around
                    np.less(place[:m], wide[line], out=inside[:m])
                    np.add(count, inside[:m].view(np.uint8), out=count)
                q, c, cos = self.verify(queries[todo], objects, np.greater_equal(count, HITS, out=inside[:m]))
                over = np.ones(m, bool)
                if level != LEVELS[-1]:
                    near = 2 - 2 * cos <= (self.reach * level) ** 2
                    over = np.bincount(q[near], minlength=m) >= self.k
                    q, c, cos = (x[over[q]] for x in (q, c, cos))
                found.append(self.best(queries[todo], objects, q, c, cos))
                todo = todo[~over]
                if not len(todo):
                    break
        return found

    def best(self, queries: np.ndarray, objects: np.ndarray, q: np.ndarray, c: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best verified neighbours of each query, those of them that meet in this cell first; ties by place, which is that by key."""
        size = np.bincount(q, minlength=len(queries))
        if len(q) and size.max() > 4 * self.k:  # a long row: only what reaches its k-th best goes on
            first = np.cumsum(size) - size
            keep = np.ones(len(q), bool)
            for r in np.flatnonzero(size > 4 * self.k).tolist():
                row = cos[first[r] : first[r] + size[r]]
                keep[first[r] : first[r] + size[r]] = row >= np.partition(row, size[r] - self.k)[size[r] - self.k]
            q, c, cos = q[keep], c[keep], cos[keep]
        order = np.lexsort((c, -cos, q))
        q, c, cos = q[order], c[order], cos[order]
        top = np.arange(len(q)) - np.searchsorted(q, q, "left") < self.k
        a, b, cos = queries[q[top]], objects[c[top]], cos[top]
        new = self.first_met(a, b)
        return a[new], b[new], cos[new]


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.asarray(column.flatten()).reshape(-1, dim)
    return raw, (raw / np.linalg.norm(raw.astype(np.float64), axis=1)[:, None]).astype(np.float32)


def _sizes(dim: int, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), np.int64)
        for b in batches:
            cells = assign(_unit(b.column(0), dim)[1], pivots)
            total += np.bincount(cells[cells >= 0], minlength=len(pivots))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])

    return run


def _place(dim: int, pivots: np.ndarray, blocks: np.ndarray):
    """Each vector once for each of its cells, or for each pair of blocks of a cell that has its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 4000):
                part = b.slice(at, 4000)
                raw, unit = _unit(part.column(1), dim)
                cells, rep = assign(unit, pivots), part.column(0).to_numpy()
                row, col = np.nonzero(cells >= 0)
                cell = cells[row, col]
                n = blocks[cell]
                own = (rep[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, cell, own = (np.repeat(x, n) for x in (row, cell, own))
                vectors, keys = [r.tobytes() for r in raw], [r.tobytes() for r in cells]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(np.minimum(own, other), pa.int32()), pa.array(np.maximum(own, other), pa.int32()), pa.array(own, pa.int32()), pa.array(rep[row], pa.int64()), pa.array(vectors, pa.binary()).take(take), pa.array(keys, pa.binary()).take(take)], names=["cell", "i", "j", "own", "rep", "v", "cells"])

    return run


def _search(dim: int, k: int, least: float):
    def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        raw = np.frombuffer(b"".join(t["v"].to_pylist()), np.float32).reshape(len(t), dim).astype(np.float64)
        cells = np.frombuffer(b"".join(t["cells"].to_pylist()), np.int32).reshape(len(t), MOST_CELLS)
        cell, i, j, own, rep = (t[c].to_numpy() for c in ("cell", "i", "j", "own", "rep"))
        edge = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if high - low < 2:
                continue
            c = Cell(raw[low:high], cells[low:high], rep[low:high], int(cell[low]), k, least)
            left, right = (np.flatnonzero(own[low:high] == x) for x in (i[low], j[low]))
            found = c.search(left, right)
            if i[low] != j[low]:
                found += c.search(right, left)
            q, o, cos = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(c.rep[q]), pa.array(c.rep[o]), pa.array(cos)], names=["rep", "other", "cos"])

    def ident(b: pa.RecordBatch, at: int) -> tuple:
        return tuple(b.column(c)[at].as_py() for c in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by cell and blocks; a cell may go on in the next batch
            if not len(b):
                continue
            last = ident(b, len(b) - 1)
            other = np.flatnonzero(np.any([b.column(c).to_numpy() != last[c] for c in range(3)], axis=0))
            at = int(other[-1]) + 1 if len(other) else 0
            if at or (held and ident(held[-1], len(held[-1]) - 1) != ident(b, 0)):
                yield from flush([*held, b.slice(0, at)] if at else held)
                held = []
            held.append(b.slice(at))
        if held:
            yield from flush(held)

    return run


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, least: float = 0.9, dim: int = 64) -> DataFrame:
    """(key, other, cos): the at most k vectors of the highest cosine of at least `least` for each vector.

    Cosines are rounded to 6 decimals, ties go to the smaller key. Vectors that are null, all zero, of another
    length than dim, or hold a null, NaN or infinite number are left out, as are null keys. Equal vectors are
    searched once, and each copy gets its neighbours, its other copies among them (a key given twice counts
    once); of a group of copies only the k + 1 smallest keys can be neighbours, so that a vector held by a third of
    all rows costs no more than any other. Fewer than two vectors give an empty result. Other columns are ignored.

    The index is fitted on about pivots_for(n) vectors, MOST_PIVOTS at most, chosen by hash; every vector is indexed. What
    reaches the driver is these and the sizes of their cells.
    """
    spark = df.sparkSession
    s = Scratch(spark)
    v = F.col(vector).cast("array<float>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dim))
    rows = rows.filter("not array_contains(v, float('nan')) and array_max(v) < float('inf') and array_min(v) > float('-inf') and (array_max(v) <> 0 or array_min(v) <> 0)")  # array_contains is null where it holds a null
    rows = rows.withColumn("same", F.concat_ws(":", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    ranked = s.write(rows.groupBy("id").agg(F.min("same").alias("same")))
    heads = ranked.selectExpr("*", "row_number() over (partition by same order by id) as nth").filter(f"nth <= {k + 1}")
    reps = s.write(heads.groupBy("same").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")))
    n = reps.count()
    vectors = rows.select(F.col("id").alias("rep"), "same", "v").join(reps.select("rep", "same"), ["rep", "same"]).select("rep", "v")
    vectors = s.write(vectors)
    if vectors.count() > n:  # a key given twice with one vector
        vectors = s.write(vectors.groupBy("rep").agg(F.first("v").alias("v")))
    sample = np.array([r.v for r in vectors.filter(hashed_share(F.col("rep"), pivots_for(n), n, SEED)).orderBy("rep").select("v").collect()], np.float64).reshape(-1, dim)
    if n and not len(sample):  # few vectors, none of which the hash chose
        sample = np.array([r.v for r in vectors.limit(1).select("v").collect()], np.float64).reshape(-1, dim)
    pivots = thin((sample / np.linalg.norm(sample, axis=1)[:, None]).astype(np.float32))
    blocks = np.ones(max(1, len(pivots)), np.int64)
    for r in vectors.select("v").mapInArrow(_sizes(dim, pivots), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter(f"n > {BLOCK}").collect():
        blocks[r.cell] = -(-r.n // BLOCK)
    cells = vectors.select("rep", "v").mapInArrow(_place(dim, pivots, blocks), "cell int, i int, j int, own int, rep long, v binary, cells binary")
    cells = cells.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    pairs = cells.mapInArrow(_search(dim, k, least), "rep long, other long, cos double")
    # At most k of each cell for a vector: a bounded list.
    top = pairs.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("d"), "other"))), 1, k).alias("near"))
    near = top.select("rep", F.explode("near").alias("n")).select("rep", F.col("n.d").alias("d"), F.col("n.other").alias("other"))
    near = near.join(reps.select(F.col("rep").alias("other"), F.slice("ids", 1, k).alias("ids")), "other").select("rep", F.explode("ids").alias("id"), "d").groupBy("rep").agg(F.collect_list(F.struct("d", "id")).alias("near"))
    full = reps.select("same", "rep", "ids").join(near, "rep", "left")
    full = full.withColumn("near", F.expr(f"slice(array_sort(concat(coalesce(near, array()), transform(ids, i -> struct(-1.0D as d, i as id)))), 1, {k + 1})"))
    full = s.write(full.filter("size(near) > 1 or size(ids) > 1").select("same", "ids", "near"))
    head = full.select(F.explode("ids").alias("id"), "near")
    rest = unique_join(ranked.select("id", "same"), full.filter(f"size(ids) > {k}").select("same", "ids", "near"), "same").filter(f"id > ids[{k}]").select("id", "near")
    out = head.unionByName(rest).select("id", F.explode(F.expr(f"slice(filter(near, n -> n.id <> id), 1, {k})")).alias("n"))
    other = free_name(df.select(key), "other")
    return out.select(F.col("id").alias(key), F.col("n.id").alias(other), (-F.col("n.d")).alias(free_name(df.select(key), "cos")))


def pairs(near: DataFrame, key: str) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b, of which at least one is among the nearest of the other."""
    a, b = F.col(key), F.col(near.columns[1])
    return near.select(F.least(a, b).alias("vec_a"), F.greatest(a, b).alias("vec_b")).distinct()


def recall(near: DataFrame, df: DataFrame, key: str, vector: str, k: int = 10, least: float = 0.9, dim: int = 64, every: int = 100) -> DataFrame:
    """(queries, true_pairs, missed, recall): the queries are the vectors whose key is divisible by `every`, searched exactly against all.

    The queries are held in blocks against all rows: each batch of rows is multiplied with the query
    matrix, and only its k best of a query go on. The query matrix (one in `every` vectors) is what a task holds.
    """
    ok = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter(F.size("v") == dim)
    ok = ok.filter("id is not null and forall(v, x -> x is not null and not isnan(x)) and exists(v, x -> x <> 0)").dropDuplicates(["id"])
    blocks = ok.filter(F.col("id") % every == 0).withColumn("block", F.floor(F.col("id") / (every * 2000)).cast("long")).groupBy("block").agg(F.collect_list("id").alias("qid"), F.flatten(F.collect_list("v")).alias("qv"))
    data = ok.withColumn("part", F.floor(F.col("id") / 2000).cast("long")).groupBy("part").agg(F.collect_list("id").alias("id"), F.flatten(F.collect_list("v")).alias("v"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qid, qv, ids, v in zip(*(b.column(i) for i in range(4))):
                q, x = (np.asarray(m.values, np.float64).reshape(-1, dim) for m in (qv, v))
                qi, xi = np.asarray(qid.values), np.asarray(ids.values)
                cos = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 6)
                cos[qi[:, None] == xi[None, :]] = -2
                r, c = np.nonzero(cos >= least)
                order = np.lexsort((xi[c], -cos[r, c], r))
                r, c = r[order], c[order]
                top = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
                r, c = r[top], c[top]
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(xi[c]), pa.array(cos[r, c])], names=["id", "other", "cos"])

    exact = blocks.crossJoin(data).select("qid", "qv", "id", "v").mapInArrow(best, "id long, other long, cos double")
    exact = exact.selectExpr("id", "other", "row_number() over (partition by id order by cos desc, other) as nth").filter(f"nth <= {k}").select("id", "other")
    got = near.select(F.col(key).alias("id"), F.col(near.columns[1]).alias("other"), F.lit(1).alias("hit"))
    res = exact.join(got, ["id", "other"], "left").agg(F.countDistinct("id").alias("queries"), F.count("*").alias("true_pairs"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("missed"))
    return res.withColumn("recall", F.lit(1.0) - F.try_divide("missed", "true_pairs"))
