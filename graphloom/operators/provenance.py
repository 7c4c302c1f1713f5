"""The provenance layer: stored edges, their records, and the reports of coverage and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.session import free_name

TRIPLE = ("source", "predicate", "target")
#: An edge and a place within it as one number, which hash aggregation can hold: edge_id * PLACES + place.
PLACES = 2**32


def delivered(rows: DataFrame, key: str, when: str = "ingested_at") -> DataFrame:
    """Rows delivered more than once under a key, once: the last delivery.

    A ranking and not an aggregate of whole rows, so that only the columns that are used later are read and shuffled.
    """
    nth = free_name(rows, "nth")
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(when).desc_nulls_last()))
    return rows.withColumn(nth, last).filter(F.col(nth) == 1).drop(nth)


def edges(rows: DataFrame) -> DataFrame:
    """(edge_id, source, predicate, target, docs, records, knowledge_type, created_at) of the rows that a graph can hold.

    Rows delivered twice count once; names are collapsed; rows with a null or blank name or a predicate
    without a safe type are rejected (see rejected).
    """
    e = delivered(rows, "edge_id")
    e = e.select("edge_id", text.name("source").alias("source"), text.relationship_type("predicate").alias("predicate"), text.name("target").alias("target"), "docs", "records", "knowledge_type", "created_at")
    return e.filter("source <> '' and target <> '' and predicate is not null")


def records(e: DataFrame) -> DataFrame:
    """(source, predicate, target, edge_id, pos, doc, modality, text, chunk_index), one row for each distinct record of a stored triple.

    The same record stated again for a triple counts once, at its first (edge_id, pos); records with a null
    or blank doc are left out; blank modalities are null; the text is the quality, else the chunk excerpt.
    """
    r = e.select(*TRIPLE, "edge_id", F.posexplode("records").alias("pos", "r")).filter(F.col("r").isNotNull())
    r = r.select(*TRIPLE, (F.col("edge_id").cast("decimal(20,0)") * PLACES + F.col("pos")).alias("at"), text.text_or_null(F.col("r.doc")).alias("doc"), F.upper(text.text_or_null(F.col("r.modality"))).alias("modality"), F.coalesce(text.text_or_null(F.col("r.quality")), text.text_or_null(F.col("r.chunk_excerpt"))).alias("text"), F.col("r.chunk_index").alias("chunk_index"))
    key = [*TRIPLE, "doc", "modality", "text", "chunk_index"]
    first = r.filter("doc is not null").groupBy(*key).agg(F.min("at").alias("at"))
    edge = F.floor(F.col("at") / PLACES).cast("long")
    return first.select(*TRIPLE, edge.alias("edge_id"), (F.col("at") - edge * PLACES).cast("int").alias("pos"), "doc", "modality", "text", "chunk_index")


def triple_docs(e: DataFrame) -> DataFrame:
    """(source, predicate, target, doc): the documents of a stored triple, from its list and its records."""
    listed = e.select(*TRIPLE, F.explode("docs").alias("doc"))
    said = e.select(*TRIPLE, F.explode(F.expr("transform(records, r -> r.doc)")).alias("doc"))
    return listed.unionByName(said).withColumn("doc", text.text_or_null(F.col("doc"))).filter("doc is not null").distinct()


def document_coverage(r: DataFrame) -> DataFrame:
    """(doc, assertions, concepts, normative): records, distinct names in them and records with a modality, by document."""
    counts = r.groupBy("doc").agg(F.count("*").alias("assertions"), F.count("modality").alias("normative"))
    names = r.select("doc", F.explode(F.array("source", "target")).alias("name")).distinct().groupBy("doc").agg(F.count("*").alias("concepts"))
    return counts.join(names, "doc").select("doc", "assertions", "concepts", "normative")


def source_filter(e: DataFrame, docs: list[str]) -> DataFrame:
    """Edges of which any document is selected, with all their records."""
    own = F.concat(F.coalesce("docs", F.array().cast("array<string>")), F.coalesce(F.expr("transform(records, r -> r.doc)"), F.array().cast("array<string>")))
    return e.filter(F.arrays_overlap(own, F.array(*(F.lit(d) for d in docs))))


def overlap_relations(e: DataFrame, r: DataFrame) -> DataFrame:
    """Triples stated by two documents or more: (source, predicate, target, n_docs, modalities, verdict).

    A document counts with its first modality only; two different ones make a TENSION, else it is an AGREEMENT.
    """
    docs = triple_docs(e).groupBy(*TRIPLE).agg(F.count("*").alias("n_docs")).filter("n_docs >= 2")
    first = r.filter("modality is not null").groupBy(*TRIPLE, "doc").agg(F.min_by("modality", F.struct("edge_id", "pos")).alias("modality"))
    found = first.groupBy(*TRIPLE).agg(F.array_join(F.array_sort(F.collect_set("modality")), "|").alias("modalities"))
    out = docs.join(found, [*TRIPLE], "left").withColumn("modalities", F.coalesce("modalities", F.lit("")))
    return out.select(*TRIPLE, "n_docs", "modalities", F.when(F.col("modalities").contains("|"), "TENSION").otherwise("AGREEMENT").alias("verdict"))


def concept_counts(r: DataFrame, canon: DataFrame) -> DataFrame:
    """(concept, doc, n): records that name a canonical concept, a self-loop once, by document."""
    c = canon.select("name", "canonical")
    both = r.join(c.select(F.col("name").alias("source"), F.col("canonical").alias("cs")), "source", "left").join(c.select(F.col("name").alias("target"), F.col("canonical").alias("ct")), "target", "left")
    both = both.select("doc", F.array_distinct(F.array(F.coalesce("cs", "source"), F.coalesce("ct", "target"))).alias("names"))
    return both.select(F.explode("names").alias("concept"), "doc").groupBy("concept", "doc").agg(F.count("*").alias("n"))


def concept_coverage(counts: DataFrame, limit: int = 500) -> DataFrame:
    """The `limit` concepts of the most documents, then records, then name: (concept, n_docs, total)."""
    return counts.groupBy("concept").agg(F.count("*").alias("n_docs"), F.sum("n").alias("total")).orderBy(F.desc("n_docs"), F.desc("total"), "concept").limit(limit)
