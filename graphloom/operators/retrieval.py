"""Vector and text retrieval, rank fusion and report statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: A vector that has a cosine.
USABLE = "key is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x <> 0)"
#: Queries of a block, and rows that are multiplied with it at a time.
QUERIES, ROWS = 2000, 4000


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, row_id, cos, nth): the k rows of the highest cosine for each query, other than itself, ties by key.

    A stated set of queries against all rows, in blocks: the queries lie in matrices of about QUERIES, each of which visits every part of the
    rows, and only the k best of a query in a part go on. One matrix and one part are what a task holds. Vectors that are null, empty,
    zero or not finite have no cosine, nor have two of unlike lengths. Cosines are rounded half up to 6 decimals.
    """
    usable = lambda df: df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(USABLE)
    q, x = usable(queries), usable(rows)
    n, m = max(1, -(-q.count() // QUERIES)), max(1, -(-x.count() // ROWS))
    part = lambda df, c, of: df.withColumn(c, F.pmod(F.xxhash64("key"), F.lit(of)).cast("int")).withColumn("dim", F.size("v"))
    blocks = part(q, "block", n).groupBy("block", "dim").agg(F.sort_array(F.collect_list(F.struct("key", "v"))).alias("q"))
    data = part(x, "part", m).groupBy("part", "dim").agg(F.sort_array(F.collect_list(F.struct("key", "v"))).alias("x"))
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    kind = rows.schema[key].dataType
    arrow = pa.schema([("query_id", to_arrow_type(kind)), ("row_id", to_arrow_type(kind)), ("cos", pa.float64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for left, right in zip(b.column(0), b.column(1)):
                keys, unit = [], []
                for side in (left.values, right.values):
                    keys.append(side.field("key").to_numpy(zero_copy_only=False))
                    raw = side.field("v").flatten().to_numpy().reshape(len(side), -1)
                    unit.append(raw / np.linalg.norm(raw, axis=1)[:, None])
                cos = np.floor(unit[0] @ unit[1].T * 1e6 + 0.5) / 1e6
                r, c = np.nonzero((cos >= least) & (keys[0][:, None] != keys[1][None, :]))
                order = np.lexsort((c, -cos[r, c], r))
                r, c = r[order], c[order]
                top = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
                r, c = r[top], c[top]
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][r], arrow.types[0]), pa.array(keys[1][c], arrow.types[1]), pa.array(cos[r, c])], schema=arrow)

    met = blocks.join(data, ["block", "dim"]).select("q", "x")
    scored = met.mapInArrow(best, T.StructType([T.StructField("query_id", kind), T.StructField("row_id", kind), T.StructField("cos", T.DoubleType())]))
    return scored.selectExpr("*", "row_number() over (partition by query_id order by cos desc, row_id) as nth").filter(f"nth <= {k}")


def best_pairs(rows: DataFrame, key: str, vector: str, least: float, k: int, decided: DataFrame | None = None, block: int = 2048) -> DataFrame:
    """(a, b, score): the k pairs a < b of the highest cosine of at least `least`, over all pairs of rows; ties by a, then b.

    Rows fall into blocks of about `block` by the hash of their key, and each pair of blocks is matched in one task, which gives
    its k best; the k best of these are those of all pairs. decided has pairs (a, b) in either order that are left out
    before that. Null, empty, zero and non-finite vectors and unlike lengths have no cosine. The work grows with the square of the rows.
    """
    usable = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(USABLE)
    n = max(1, -(-usable.count() // block))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    kind = usable.schema["key"].dataType
    own = usable.withColumn("own", at(F.col("key"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = own.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "v")
    gone = usable.sparkSession.createDataFrame([], T.StructType([T.StructField("a", kind), T.StructField("b", kind)])) if decided is None else decided.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    gone = gone.select(F.least(at(F.col("a")), at(F.col("b"))).alias("i"), F.greatest(at(F.col("a")), at(F.col("b"))).alias("j"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def match(group: tuple, x: pd.DataFrame, no: pd.DataFrame) -> pd.DataFrame:
        i, j = group
        parts = []
        for _, same in x.groupby(x["v"].map(len)):
            left, right = (same[same["own"] == q] for q in (i, j))
            if len(left) and len(right):
                unit = [(m := np.stack(s["v"].to_list())) / np.linalg.norm(m, axis=1)[:, None] for s in (left, right)]
                cos = np.floor(unit[0] @ unit[1].T * 1e6 + 0.5) / 1e6
                hit = cos >= least
                at_left, at_right = np.nonzero(np.triu(hit, 1) if i == j else hit)
                a, b = left["key"].to_numpy()[at_left], right["key"].to_numpy()[at_right]
                parts.append(pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "score": np.floor(cos[at_left, at_right] * 1e4 + 0.5) / 1e4}))
        found = pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": [], "score": []})
        if len(no) and len(found):
            found = found.merge(no[["a", "b"]], how="left", indicator=True).query("_merge == 'left_only'").drop(columns="_merge")
        if len(found) > k:
            found = found[found["score"] >= np.partition(found["score"].to_numpy(), -k)[-k]]
        return found.sort_values(["score", "a", "b"], ascending=[False, True, True]).head(k)

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("score", T.DoubleType())])
    best = own.groupBy("i", "j").cogroup(gone.groupBy("i", "j")).applyInPandas(match, schema)
    return best.orderBy(F.desc("score"), "a", "b").limit(k)


def kept(top: DataFrame, threshold: float) -> DataFrame:
    """(query_id, max_score, decision): kept if the best cosine reaches the threshold, else dropped."""
    best = top.groupBy("query_id").agg(F.max("cos").alias("max_score"))
    return best.withColumn("decision", F.when(F.col("max_score") >= threshold, "KEPT").otherwise("DROPPED"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def _is(word: str):
    return lambda x: x == F.lit(word)


def bm25(rows: DataFrame, key: str, text: str, query: list[str], k: int = 4, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score, nth): the k rows of the highest Okapi score for the query's words, ties by key.

    Statistics are counted over all rows in one aggregation; rows without a query word are not ranked.
    """
    t = rows.select(F.col(key), tokens(F.col(text)).alias("w"))
    tf = [F.size(F.filter("w", _is(q))).alias(f"tf{i}") for i, q in enumerate(query)]
    t = t.select(key, F.size("w").alias("len"), *tf)
    stats = t.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))))
    j = t.filter(" or ".join(f"tf{i} > 0" for i in range(len(query)))).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.log(F.lit(1.0) + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score += idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    top = j.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return top.selectExpr(key, "score", f"row_number() over (order by score desc, {key}) as nth")


def fuse(a: DataFrame, b: DataFrame, key: str, weight: float = 0.5, offset: int = 60) -> DataFrame:
    """(key, score): the two ranks of a row as weight / (offset + rank), summed; a row that one side lacks gets nothing from it."""
    ra, rb = (x.select(key, F.col("nth").alias(f"n{i}")) for i, x in enumerate((a, b)))
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(offset) + F.col(c)), F.lit(0.0))
    return ra.join(rb, key, "full").select(key, F.round(part("n0", weight) + part("n1", 1 - weight), 9).alias("score"))


def stat_block(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, std, median, sem) of the non-null values; population standard deviation, standard error of the sample."""
    v = F.col(value).cast("double")
    return rows.groupBy(group).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(F.median(v), 6).alias("median"), F.round(F.stddev_samp(v) / F.sqrt(F.count(v)), 6).alias("sem"))


def two_level_mean(rows: DataFrame, group: str, value: str, failed: str) -> DataFrame:
    """(groups, mean): the mean of the groups' means; groups with any failed row are left out."""
    g = rows.groupBy(group).agg(F.avg(F.col(value).cast("double")).alias("m"), F.max(failed).alias("f")).filter("not f")
    return g.agg(F.count("*").alias("n_groups"), F.round(F.avg("m"), 6).alias("mean"))


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch): batches of `size` consecutive rows by key.

    Ranges of the key are counted first, so that no single task orders all rows.
    """
    spark = rows.sparkSession
    parts = rows.select(key).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key).withColumn("p", F.spark_partition_id())
    local = parts.selectExpr(key, "p", f"row_number() over (partition by p order by {key}) as rn")
    start = local.groupBy("p").agg(F.max("rn").alias("n")).selectExpr("p", "coalesce(sum(n) over (order by p rows between unbounded preceding and 1 preceding), 0) as before")
    return local.join(F.broadcast(start), "p").select(key, F.floor((F.col("before") + F.col("rn") - 1) / size).cast("long").alias("batch"))
