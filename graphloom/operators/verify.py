"""The five checks of a graph and its verdict; each check is one aggregation with map-side combining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text

# The least score of each check.
THRESHOLDS = {"S1": 0.9, "S2": 1.0, "S3": 1.0, "S4": 1.0, "S5": 1.0}


def _row(df: DataFrame, check: str, bad, total, passed=None) -> DataFrame:
    score = F.when(total == 0, F.lit(1.0)).otherwise((total - bad) / total)
    out = df.select(F.lit(check).alias("check"), bad.cast("long").alias("bad"), total.cast("long").alias("total"), F.round(score, 6).alias("score"), (passed if passed is not None else score >= THRESHOLDS[check]).alias("passed"))
    return out


def s1(inputs: DataFrame, covered: DataFrame) -> DataFrame:
    """Share of distinct input sentences, in normal form, that the graph covers."""
    want = inputs.select(text.normal(F.col("sentence")).alias("k")).filter("k <> ''").distinct()
    have = covered.select(text.normal(F.col("sentence")).alias("k")).filter("k <> ''").distinct().withColumn("hit", F.lit(1))
    c = want.join(have, "k", "left").agg(F.count("*").alias("total"), F.count("hit").alias("hit"))
    return _row(c, "S1", F.col("total") - F.col("hit"), F.col("total"))


def s2(e: DataFrame) -> DataFrame:
    """Edges without placeholder endpoints, and nodes with a name: blank and null names are one node each that has none."""
    names = e.select(F.explode(F.array("source", "target")).alias("name")).filter(F.coalesce(text.strip(F.col("name")), F.lit("")) == "")
    nodes = names.select(F.coalesce("name", F.lit("null")).alias("name")).distinct().agg(F.count("*").alias("nodes"))
    c = e.agg(F.count("*").alias("edges"), F.count_if(text.is_placeholder(F.col("source")) | text.is_placeholder(F.col("target"))).alias("bad")).join(F.broadcast(nodes))
    return _row(c, "S2", F.col("bad") + F.col("nodes"), F.col("edges") + F.col("nodes"))


def pairs(e: DataFrame) -> DataFrame:
    """(s, t, predicates, bad) of the pairs in normal form; bad with both an allowing and a denying predicate."""
    by = e.groupBy(text.normal(F.coalesce("source", F.lit(""))).alias("s"), text.normal(F.coalesce("target", F.lit(""))).alias("t")).agg(F.array_sort(F.collect_set("predicate")).alias("p"), F.max(F.col("predicate").isin(*text.POSITIVE)).alias("pos"), F.max(F.col("predicate").isin(*text.NEGATIVE)).alias("neg"))
    return by.select("s", "t", F.array_join("p", "|").alias("predicates"), (F.col("pos") & F.col("neg")).alias("bad"))


def contradictions(e: DataFrame) -> DataFrame:
    """(s, t, predicates) of the bad pairs."""
    return pairs(e).filter("bad").drop("bad")


def s3(e: DataFrame) -> DataFrame:
    """No contradictory pair; the score is 1 or 0."""
    c = pairs(e).agg(F.count("*").alias("total"), F.count_if("bad").alias("bad"))
    return c.select(F.lit("S3").alias("check"), "bad", "total", F.when(F.col("bad") == 0, 1.0).otherwise(0.0).alias("score"), (F.col("bad") == 0).alias("passed"))


def s4(e: DataFrame) -> DataFrame:
    """Edges with both names, a predicate and some provenance."""
    said = (F.coalesce(F.size("records"), F.lit(0)) > 0) | (F.coalesce(F.size("docs"), F.lit(0)) > 0)
    bad = text.is_placeholder(F.col("source")) | text.is_placeholder(F.col("target")) | (text.strip(F.coalesce("predicate", F.lit(""))) == "") | ~said
    c = e.agg(F.count("*").alias("total"), F.count_if(bad).alias("bad"))
    return _row(c, "S4", F.col("bad"), F.col("total"))


def s5(e: DataFrame) -> DataFrame:
    """Edges beyond the first of each (source, predicate, target), nulls being equal."""
    g = e.groupBy("source", "predicate", "target").agg(F.count("*").alias("n"))
    c = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad"))
    return _row(c, "S5", F.col("bad"), F.col("total"), F.col("bad") == 0)


def verdict(checks: list[DataFrame]) -> DataFrame:
    """(verdict, failed): PASS if every check passed."""
    rows = reduce(DataFrame.unionByName, checks)
    return rows.agg(F.when(F.min("passed"), "PASS").otherwise("FAIL").alias("verdict"), F.count_if(~F.col("passed")).alias("failed"))
