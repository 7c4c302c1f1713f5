"""The graph store as tables: append-only upsert, purge, decisions and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators.provenance import TRIPLE

RECORD = "struct<doc string, quality string, chunk_index int, chunk_excerpt string, modality string>"


def merge(incoming: DataFrame) -> DataFrame:
    """One row for each (source, predicate, target): docs and records united in the order of edge_id, the last knowledge_type, the first creation and the last update.

    Only distinct records and documents are gathered, in their first order; both are combined before they are shuffled.
    """
    updated = F.coalesce("last_updated_at", "created_at") if "last_updated_at" in incoming.columns else F.col("created_at")
    keyed = incoming.select(*TRIPLE, "edge_id", "docs", "records", "knowledge_type", "created_at", updated.alias("last_updated_at"))
    rec = keyed.select(*TRIPLE, "edge_id", F.posexplode("records").alias("pos", "r")).filter("r is not null").groupBy(*TRIPLE, "r").agg(F.min(F.struct("edge_id", "pos")).alias("at"))
    rec = rec.groupBy(*TRIPLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("records"))
    doc = keyed.select(*TRIPLE, "edge_id", F.posexplode("docs").alias("pos", "d")).filter("d is not null").groupBy(*TRIPLE, "d").agg(F.min(F.struct("edge_id", "pos")).alias("at"))
    doc = doc.groupBy(*TRIPLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]).alias("docs"))
    head = keyed.groupBy(*TRIPLE).agg(F.min("edge_id").alias("edge_id"), F.max_by("knowledge_type", F.when(F.col("knowledge_type").isNotNull(), F.col("edge_id"))).alias("knowledge_type"), F.min("created_at").alias("created_at"), F.max("last_updated_at").alias("last_updated_at"))
    out = head.join(doc, [*TRIPLE], "left").join(rec, [*TRIPLE], "left")
    return out.select("edge_id", *TRIPLE, F.coalesce("docs", F.array().cast("array<string>")).alias("docs"), F.coalesce("records", F.array().cast(f"array<{RECORD}>")).alias("records"), "knowledge_type", "created_at", "last_updated_at")


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored table after an append-only upsert; what comes in overwrites the knowledge_type and dates the update. Doing it again changes nothing."""
    cols = [*TRIPLE, "edge_id", "docs", "records", "knowledge_type", "created_at"]
    with_date = lambda df: df.select(*cols, F.coalesce("last_updated_at", "created_at").alias("last_updated_at") if "last_updated_at" in df.columns else F.col("created_at").alias("last_updated_at"))
    return merge(with_date(current).unionByName(with_date(incoming)))


def purge(e: DataFrame, knowledge_type: str) -> DataFrame:
    """Edges of other or no knowledge type; nodes without an edge go with them (see nodes)."""
    return e.filter(~F.col("knowledge_type").eqNullSafe(F.lit(knowledge_type)))


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("source", "target")).alias("name")).distinct()


def latest_decisions(log: DataFrame) -> DataFrame:
    """(term_a, term_b, accept, score, decided_at): of each unordered pair the latest; blank or equal terms are rejected, ties go to accept."""
    ok = log.filter("trim(term_a) <> '' and trim(term_b) <> '' and term_a <> term_b")
    ok = ok.select(F.least("term_a", "term_b").alias("term_a"), F.greatest("term_a", "term_b").alias("term_b"), F.struct("decided_at", "accept", "score").alias("d"))
    return ok.groupBy("term_a", "term_b").agg(F.max("d").alias("d")).select("term_a", "term_b", "d.accept", "d.score", "d.decided_at")


def keyword_subgraph(e: DataFrame, keyword: str, limit: int = 50) -> DataFrame:
    """Edges found by source name, target name, or type and record text, the first `limit` of each pattern by edge_id, once each; pattern is the first that found it."""
    low = keyword.lower()
    said = F.coalesce(F.expr("exists(records, r -> lower(coalesce(r.quality, '')) like concat('%', kw, '%'))".replace("kw", "'" + low.replace("'", "''") + "'")), F.lit(False))
    hits = [
        F.lower("source").contains(low),
        F.lower("target").contains(low),
        F.col("predicate").contains(low) | F.replace("predicate", F.lit("_"), F.lit(" ")).contains(low) | said,
    ]
    parts = [e.filter(h).orderBy("edge_id").limit(limit).select("edge_id", *TRIPLE, F.lit(k).alias("pattern")) for k, h in enumerate(hits, 1)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy(*TRIPLE).agg(F.min(F.struct("pattern", "edge_id")).alias("f")).select("f.edge_id", *TRIPLE, "f.pattern")


def full_graph(e: DataFrame, limit: int = 5000) -> DataFrame:
    """The first `limit` edges by edge_id."""
    return e.select("edge_id", *TRIPLE).orderBy("edge_id").limit(limit)


def neighbourhood(e: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(name, distance): names within `hops` undirected steps of the seeds; the frontier alone is joined in each step."""
    both = e.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(e.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    seen = frontier = seeds.select("name").distinct().withColumn("distance", F.lit(0))
    for k in range(1, hops + 1):
        step = both.join(frontier.select(F.col("name").alias("a")), "a", "left_semi").select(F.col("b").alias("name")).distinct()
        frontier = step.join(seen, "name", "left_anti").withColumn("distance", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen


def incident(e: DataFrame) -> DataFrame:
    """(name, out_edges, in_edges) of every node."""
    rows = e.select(F.col("source").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("target").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return rows.groupBy("name").agg(F.sum("o").alias("out_edges"), F.sum("i").alias("in_edges"))


def display_nodes(e: DataFrame) -> DataFrame:
    """(node_id, label) for a graph viewer; the id is the first 12 digits of the label's SHA-1."""
    return nodes(e).select(F.substring(F.sha1("name"), 1, 12).alias("node_id"), F.col("name").alias("label"))


def numbered_edges(e: DataFrame) -> DataFrame:
    """(nth, source_id, target_id, label) for a graph viewer: distinct triples by edge_id, numbered from 0, with the ids of display_nodes."""
    from graphloom.operators.retrieval import batches

    once = e.groupBy(*TRIPLE).agg(F.min("edge_id").alias("edge_id"))
    ident = lambda c: F.substring(F.sha1(c), 1, 12)
    return batches(once, "edge_id", 1).join(once, "edge_id").select(F.col("batch").alias("nth"), ident("source").alias("source_id"), ident("target").alias("target_id"), F.replace("predicate", F.lit("_"), F.lit(" ")).alias("label"))


def combined_subgraph(e: DataFrame, keywords: list[str], limit: int = 50) -> DataFrame:
    """(edge_id, source, predicate, target, nth_keyword): the subgraphs of the keywords united, each triple once, at the first keyword that finds it."""
    out = None
    for k, w in enumerate(keywords):
        part = keyword_subgraph(e, w, limit).select("edge_id", *TRIPLE, F.lit(k).alias("nth_keyword"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*TRIPLE).agg(F.min(F.struct("nth_keyword", "edge_id")).alias("f")).select("f.edge_id", *TRIPLE, "f.nth_keyword")


def nested(r: DataFrame) -> DataFrame:
    """(edge_id, pos, source, edge, target): records as relations of two labelled nodes and an edge with its label and properties; the sentence falls back to the triple."""
    node = lambda c: F.struct(F.col(c).alias("label"))
    said = F.coalesce("text", F.concat_ws(" ", "source", "predicate", "target"))
    edge = F.struct(F.col("predicate").alias("label"), F.struct(said.alias("sentence"), "doc", "modality", "chunk_index").alias("properties"))
    return r.select("edge_id", "pos", node("source").alias("source"), edge.alias("edge"), node("target").alias("target"))
