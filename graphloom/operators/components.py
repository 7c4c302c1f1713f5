"""Connected components and closures by iterated joins, checkpointed in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(name, root): the smallest name of each name's component, by alternating large-star and small-star.

    Each round replaces links by links to smaller names, so that a component of n names needs about log n rounds,
    whatever its diameter. Null names and self-links say nothing; an empty table gives an empty result.
    """
    s = Scratch(links.sparkSession)
    own = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    state = s.write(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = s.write(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        s.drop(state)
        state = new
        if mark == before:
            break
        before = mark
    roots = state.select("v").distinct()
    return state.select(F.col("u").alias("name"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("name"), F.col("v").alias("root")))


def same_as(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(name, canonical) of the clusters of two names or more; the canonical name is the shortest, then the smallest."""
    c = components(links, a, b)
    best = c.groupBy("root").agg(F.min(F.struct(F.length("name").alias("n"), "name")).alias("m"))
    return c.join(best.select("root", F.col("m.name").alias("canonical")), "root").select("name", "canonical")


def overlay(aliases: DataFrame, clusters: DataFrame) -> DataFrame:
    """(name, canonical) of the aliases, or of the clusters for names that are in one; the two are not composed."""
    return aliases.select("name", "canonical").join(clusters, "name", "left_anti").unionByName(clusters.select("name", "canonical"))


def inherit(types: DataFrame, parents: DataFrame) -> DataFrame:
    """(name, type): types of names and of all that is above them over (name, parent), to the fixpoint, whatever the depth; cycles are harmless.

    Links are doubled: in round k each name takes the types of what is 2**k links above it, so that rounds grow with the logarithm of the
    depth. A round that brings nothing new ends it: a type first met farther up would have been brought to a name on the way.
    """
    s = Scratch(types.sparkSession)
    jump = s.write(parents.select("name", "parent").filter("name is not null and parent is not null and name <> parent").distinct())
    known = s.write(types.select("name", "type").filter("name is not null and type is not null").distinct())
    while True:
        got = jump.join(known.select(F.col("name").alias("parent"), "type"), "parent").select("name", "type").distinct()
        fresh = s.write(got.join(known, ["name", "type"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)  # what is known is only read, never written again
        longer = s.write(jump.join(jump.select(F.col("name").alias("parent"), F.col("parent").alias("above")), "parent").select("name", F.col("above").alias("parent")).distinct())
        s.drop(jump)
        jump = longer
