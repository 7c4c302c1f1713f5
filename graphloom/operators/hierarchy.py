"""Full hierarchies from parent-child links: path, depth, root, descendants and cycles.

A hash of the name picks one node in SPLIT as a splitter. Every node walks to its next splitter or
root (its terminal) by doubling its walk; the terminals' own pointers form a reduced graph that is solved
the same way; then every node's path is its terminal's path and its own walk. Nothing is
collected, each step is a join of a table with a unique key, and rounds grow with the logarithm of
the depth. Hot parents are left to adaptive skew joins, sums have map-side combining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import Scratch, blank

#: One node in so many is a splitter.
SPLIT = 4
TRIM = r"(?U)^\s+|\s+$"


def links(edges: DataFrame, source: str, target: str, predicate: str, wanted: str) -> DataFrame:
    """(node, parent) of the rows whose predicate is `wanted` apart from case, spacing, separators and punctuation.

    Names lose white space at both ends; rows with a null or blank name or a null predicate are no link.
    A link stated more than once counts once; of several parents of a node the smallest name is taken.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    name = lambda c: F.regexp_replace(F.col(c).cast("string"), TRIM, "")
    rows = edges.filter(bare(F.col(predicate).cast("string")) == bare(F.lit(wanted))).filter(~blank(F.col(source).cast("string")) & ~blank(F.col(target).cast("string")))
    return rows.select(name(source).alias("node"), name(target).alias("parent")).groupBy("node").agg(F.min("parent").alias("parent"))


def is_splitter(c: str) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("splitter"), F.col(c)), F.lit(SPLIT)) == 0


def _walk(s: Scratch, link: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, ptr, at_root, walk) of the nodes with a parent that reach a terminal ptr, and (node) of those that never do.

    walk has the names from below ptr down to the node.
    """
    parents = link.select(F.col("node").alias("ptr"), F.lit(True).alias("has_parent"))
    start = link.select("node", F.col("parent").alias("ptr"), F.array("node").alias("walk")).join(parents, "ptr", "left")
    start = start.select("node", "ptr", "walk", F.col("has_parent").isNull().alias("at_root"))
    state = s.write(start.withColumn("over", F.col("at_root") | is_splitter("ptr")))
    left = state.filter("not over").count()
    while left:
        b = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("b_ptr"), F.col("walk").alias("b_walk"), F.col("at_root").alias("b_root"), F.col("over").alias("b_over"))
        open_ = state.filter("not over").join(b, "ptr").select("node", F.col("b_ptr").alias("ptr"), F.concat("b_walk", "walk").alias("walk"), F.col("b_root").alias("at_root"), F.col("b_over").alias("over"))
        new = s.write(state.filter("over").unionByName(open_))
        s.drop(state)
        state, before = new, left
        left = state.filter("not over").count()
        if left == before:  # nodes at every smaller distance exist, so the rest never arrives
            break
    return state.filter("over").drop("over"), state.filter("not over").select("node")


def _reduce(s: Scratch, link: DataFrame, walks: DataFrame) -> DataFrame:
    """(node, root, path, n_desc) of every terminal that leads to a root; path has the names from the root down."""
    own = walks.groupBy(F.col("ptr").alias("node")).agg(F.count("*").alias("own"), F.max("at_root").alias("is_root"))
    up = walks.filter(is_splitter("node")).select("node", F.col("ptr").alias("anc"), "walk")
    state = up.join(own, "node", "full").select("node", F.when(~F.coalesce("is_root", F.lit(False)), F.col("anc")).alias("anc"), F.coalesce("is_root", F.lit(False)).alias("over"), F.coalesce("walk", F.array("node")).alias("path"), F.coalesce("own", F.lit(0)).alias("n_desc"))
    # A splitter above which nothing ends in a terminal has no walk of its own and is no root: it leads to a cycle.
    state = s.write(state.filter("over or anc is not null"))
    left = state.filter("not over").count()
    while left:
        b = state.select(F.col("node").alias("anc"), F.col("anc").alias("b_anc"), F.col("path").alias("b_path"), F.col("over").alias("b_over"))
        gain = state.filter("anc is not null").groupBy(F.col("anc").alias("node")).agg(F.sum("n_desc").alias("gain"))
        new = state.join(b, "anc", "left").select("node", F.col("b_anc").alias("anc"), (F.col("over") | F.coalesce("b_over", F.lit(False))).alias("over"), F.when(F.col("over") | F.col("b_path").isNull(), F.col("path")).otherwise(F.concat("b_path", "path")).alias("path"), "n_desc")
        new = s.write(new.join(gain, "node", "left").select("node", "anc", "over", "path", (F.col("n_desc") + F.coalesce("gain", F.lit(0))).alias("n_desc")))
        s.drop(state)
        state, before = new, left
        left = state.filter("not over").count()
        if left == before:
            break
    return state.filter("over").select("node", F.col("path")[0].alias("root"), "path", "n_desc")


def _cycles(s: Scratch, link: DataFrame, lost: DataFrame) -> DataFrame:
    """(node, kind) of the nodes without a root: their pointers are doubled until the set of targets no longer shrinks."""
    state = s.write(link.join(lost, "node", "left_semi").select("node", F.col("parent").alias("ptr")))
    size = state.select("ptr").distinct().count()
    while size:
        b = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("b_ptr"))
        new = s.write(state.join(b, "ptr").select("node", F.col("b_ptr").alias("ptr")))
        s.drop(state)
        state, before = new, size
        size = state.select("ptr").distinct().count()
        if size == before:
            break
    on = state.select(F.col("ptr").alias("node"), F.lit("cycle").alias("kind")).distinct()
    return state.select("node").join(on, "node", "left").select("node", F.coalesce("kind", F.lit("below_cycle")).alias("kind"))


def hierarchy(link: DataFrame) -> DataFrame:
    """(node, kind, root, depth, path_names, n_desc) of every name in (node, parent) links unique in node.

    kind is `tree`, `cycle` (on a cycle, a link to itself being one) or `below_cycle` (leads into one). For
    a tree node, path_names lists the names from root to node, depth is the number of links to the
    root and n_desc the number of all descendants. For the others root is '', path_names empty, depth and n_desc
    -1. Rows with a null node or parent are ignored; an empty table gives an empty result.
    """
    s = Scratch(link.sparkSession)
    link = s.write(link.select("node", "parent").filter("node is not null and parent is not null"))
    walks, stuck = _walk(s, link)
    ends = s.write(_reduce(s, link, walks))
    # What lies below a node of a walk passes it on a walk of its own: a splitter brings all that is below it.
    inner = walks.filter("size(walk) > 1").join(ends.select("node", F.col("n_desc").alias("below")), "node", "left")
    inner = inner.select(F.explode(F.slice("walk", F.lit(1), F.size("walk") - 1)).alias("node"), (F.lit(1) + F.coalesce("below", F.lit(0))).alias("n"))
    below = inner.groupBy("node").agg(F.sum("n").alias("n_desc"))
    up = ends.select(F.col("node").alias("ptr"), "root", F.col("path").alias("up"))
    plain = walks.filter(~is_splitter("node")).join(up, "ptr").select("node", "root", F.concat("up", "walk").alias("path")).join(below, "node", "left")
    tree = ends.unionByName(plain.select("node", "root", "path", F.coalesce("n_desc", F.lit(0)).alias("n_desc")))
    tree = tree.select("node", F.lit("tree").alias("kind"), "root", (F.size("path") - 1).alias("depth"), F.col("path").alias("path_names"), F.col("n_desc").cast("int").alias("n_desc"))
    known = ends.select(F.col("node").alias("ptr"))
    lost = stuck.unionByName(walks.join(known, "ptr", "left_anti").select("node"))
    none = _cycles(s, link, lost).select("node", "kind", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("path_names"), F.lit(-1).alias("n_desc"))
    return tree.unionByName(none)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for every tree node of `hierarchy` and each node above it."""
    rows = tree.filter("kind = 'tree' and depth > 0").select("node", "depth", F.posexplode(F.slice("path_names", F.lit(1), F.size("path_names") - 1)).alias("at", "ancestor"))
    return rows.select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    from graphloom.session import table

    return links(table(spark, folder, "provenance_edges"), "source", "target", "predicate", "IsSubclassOf")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(p3_links(spark, folder)).select("node", "kind", "root", "depth", F.array_join("path_names", " > ").alias("path"), "n_desc")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return descendants(hierarchy(p3_links(spark, folder)))
