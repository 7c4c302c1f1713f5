"""Similarity of texts to the nodes of a graph through the entities that they name: the neighbours are the nodes' own relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import encoder, phrases, retrieval
from graphloom.operators.provenance import TRIPLE
from graphloom.session import Scratch, unique_join


def node_relations(e: DataFrame, most: int) -> DataFrame:
    """(node, label, nth, source, predicate, target): the first `most` distinct relations of each node, by edge_id; nodes by their key, labels by the first edge."""
    once = e.groupBy(*TRIPLE).agg(F.min("edge_id").alias("edge_id"))
    ends = once.select("*", F.explode(F.array_distinct(F.array("source", "target"))).alias("label"))
    ends = ends.withColumn("node", text.entity_key(F.col("label"))).filter("node <> ''")
    first = ends.groupBy("node").agg(F.min(F.struct("edge_id", F.when(F.col("label") == F.col("source"), 0).otherwise(1).alias("side"), "label")).alias("f")).select("node", F.col("f.label").alias("label"))
    own = ends.groupBy("node", *TRIPLE).agg(F.min("edge_id").alias("edge_id"))
    ranked = own.selectExpr("node", *TRIPLE, "row_number() over (partition by node order by edge_id, source, predicate, target) as nth").filter(f"nth <= {most}")
    return ranked.join(first, "node").select("node", "label", "nth", *TRIPLE)


def scored_entities(qualities: DataFrame, key: str, quality: str, nodes: DataFrame, k: int, most: int, stop: frozenset[str] | None = None) -> DataFrame:
    """(key, pos, entity, node, nth, cos): for each entity of a text its k nearest nodes; nodes has (node)."""
    q = qualities.select(F.col(key).alias("key"), F.posexplode(phrases.entity_lists(F.col(quality), most, stop)).alias("pos", "entity"))
    q = q.withColumn("k", F.concat(F.lit("e:"), text.entity_key(F.col("entity"))))
    own = q.select("k").distinct().select("k", encoder.encode(F.substring("k", 3, 2**31 - 1)).alias("v"))
    all_ = nodes.select(F.concat(F.lit("n:"), F.col("node")).alias("k"), encoder.encode(F.col("node")).alias("v"))
    hits = retrieval.top_k(own, all_, "k", "v", k)
    return q.join(hits, q["k"] == hits["query_id"]).select("key", "pos", "entity", F.substring("row_id", 3, 2**31 - 1).alias("node"), "nth", "cos")


def neighbours(qualities: DataFrame, key: str, quality: str, e: DataFrame, k: int = 5, threshold: float = 0.5, most: int = 8, stop: frozenset[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, neighbours) of texts against the edges (edge_id, source, predicate, target).

    decisions: (key, max_score, decision, reason), KEPT where the best entity reaches the threshold, else DROPPED with the reason; a text
    without any entity, as a null or blank one, has the score 0. neighbours: of each kept text up to k relations (key, nth, source, predicate, target, score, entity, node), those of
    its nearest nodes first: by score, then place of the entity, then place of the node, each relation once, at its best place.

    Of a node no more than 2 k relations are looked at: at most k of them can have been taken before.
    """
    s = Scratch(e.sparkSession)
    rel = s.write(node_relations(e, 2 * k))
    nodes = rel.filter("nth = 1").select("node", "label")
    hits = s.write(scored_entities(qualities, key, quality, nodes, k, most, stop))
    best = hits.groupBy("key").agg(F.max("cos").alias("best"))
    decisions = qualities.select(F.col(key).alias("key")).distinct().join(best, "key", "left")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0))
    reason = F.when(F.col("best").isNull(), "No candidate entities extracted.").when(score < threshold, "No extracted entity matched a KG node above threshold.")
    decisions = decisions.select(F.col("key").alias(key), score.alias("max_score"), F.when(score >= threshold, "KEPT").otherwise("DROPPED").alias("decision"), F.when(score < threshold, reason).alias("reason"))
    near = hits.filter(F.col("cos") >= threshold).selectExpr("*", "row_number() over (partition by key order by cos desc, pos, nth) as rank").drop("nth")
    lists = rel.groupBy("node").agg(F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("nth", *TRIPLE))).alias("rels"))
    met = unique_join(near, lists, "node").select("key", "rank", "cos", "entity", F.col("label").alias("node"), F.explode("rels").alias("r"))
    once = met.groupBy("key", *(F.col(f"r.{c}").alias(c) for c in TRIPLE)).agg(F.min(F.struct("rank", "r.nth", "cos", "entity", "node")).alias("f"))
    ranked = once.selectExpr("key", *TRIPLE, "f.cos as score", "f.entity as entity", "f.node as node", "row_number() over (partition by key order by f.rank, f.nth, source, predicate, target) as nth").filter(f"nth <= {k}")
    return decisions, ranked.select(F.col("key").alias(key), "nth", *TRIPLE, "score", "entity", "node")
