"""Terms that documents leave undefined or vague."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text


def undefined_terms(r: DataFrame, per_doc: int = 50) -> DataFrame:
    """(doc, term, predicate, example): the first `per_doc` terms, by name, that a document obliges but never defines.

    A term is obliged by a normative predicate or a MANDATORY or PROHIBITED record; predicate and example come from its
    first record. The limit is the feature: a report page.
    """
    obliged = r.filter(~F.col("predicate").isin(*text.DEFINING)).filter(F.col("predicate").isin(*text.NORMATIVE) | F.col("modality").isin("MANDATORY", "PROHIBITED"))
    terms = obliged.select("doc", F.explode(F.array_distinct(F.array("source", "target"))).alias("term"), F.struct("edge_id", "pos").alias("at"), "predicate", F.coalesce("text", F.lit("")).alias("example"))
    first = terms.groupBy("doc", "term").agg(F.min_by(F.struct("predicate", "example"), "at").alias("f"))
    defined = r.filter(F.col("predicate").isin(*text.DEFINING)).select("doc", F.lower("source").alias("low")).distinct()
    left = first.withColumn("low", F.lower("term")).join(defined, ["doc", "low"], "left_anti")
    return left.selectExpr("doc", "term", "f.predicate as predicate", "f.example as example", "row_number() over (partition by doc order by term) as nth").filter(f"nth <= {per_doc}").drop("nth")


def vague_language(texts: DataFrame, terms: tuple[str, ...] = text.VAGUE_TERMS, examples: int = 3) -> DataFrame:
    """(doc, term, n, examples): how many distinct texts of a document use a vague term, and the first few of them by order.

    texts has (doc, text, at); a text counts once for each document.
    """
    distinct = texts.filter("doc is not null and text is not null").groupBy("doc", "text").agg(F.min("at").alias("at"))
    found = F.array_compact(F.array(*(F.when(text.has_term(F.col("text"), t), F.lit(t)) for t in terms)))
    hits = distinct.select("doc", "text", "at", F.explode(found).alias("term"))
    ranked = hits.selectExpr("*", "row_number() over (partition by doc, term order by at, text) as nth")
    return ranked.groupBy("doc", "term").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= examples, F.struct("nth", "text")))), lambda x: x["text"]), " | ").alias("examples"))
