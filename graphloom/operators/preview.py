"""What merging new triples into a graph would mean, and duplicate relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text


def preview(triples: DataFrame, e: DataFrame, r: DataFrame) -> DataFrame:
    """(triple_id, subject, predicate, object, category, subject_known, object_known) of each complete new triple.

    triples has (triple_id, subject, predicate, object). The modality of a new triple follows from its predicate, that of
    a stored edge from its records, else its predicate. CONFLICT: the same statement with the opposite obligation, or an allowing
    against a denying predicate of the same pair; TENSION: another strength; EXISTING: the same; RELATED: another predicate; else NEW.
    Triples with a null or blank part are left out. The stored side is reduced to one row for each pair before the join.
    """
    said = r.filter("modality is not null").select("source", "predicate", "target", "modality").distinct()
    default = F.coalesce(*(F.when(F.col("predicate") == k, v) for k, v in text.MODALITY_OF.items()))
    own = e.select("source", "predicate", "target").distinct().join(said.groupBy("source", "predicate", "target").agg(F.collect_set("modality").alias("m")), ["source", "predicate", "target"], "left")
    own = own.select(text.normal(F.col("source")).alias("s"), text.normal(F.col("target")).alias("t"), "predicate", F.coalesce("m", F.when(default.isNotNull(), F.array(default)), F.array().cast("array<string>")).alias("m"))
    by_pred = own.groupBy("s", "t", "predicate").agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("kb"))
    by_pair = by_pred.groupBy("s", "t").agg(F.max(F.col("predicate").isin(*text.PREVIEW_POSITIVE)).alias("pos"), F.max(F.col("predicate").isin(*text.NEGATIVE)).alias("neg"))
    names = e.select(F.explode(F.array("source", "target")).alias("n")).select(text.normal(F.col("n")).alias("n")).distinct()
    new = triples.filter("subject rlike '(?U)\\\\S' and predicate rlike '(?U)\\\\S' and object rlike '(?U)\\\\S'")
    new = new.select("triple_id", text.strip(F.col("subject")).alias("subject"), text.strip(F.col("predicate")).alias("predicate"), text.strip(F.col("object")).alias("object"))
    rel = F.coalesce(text.relationship_type(F.col("predicate")), F.lower("predicate"))
    new = new.withColumns({"rel": rel, "s": text.normal(F.col("subject")), "t": text.normal(F.col("object"))})
    new = new.withColumn("mod", F.coalesce(*(F.when(F.col("rel") == k, v) for k, v in text.MODALITY_OF.items())))
    j = new.join(by_pred.withColumnRenamed("predicate", "rel"), ["s", "t", "rel"], "left").join(by_pair, ["s", "t"], "left")
    j = j.join(names.select(F.col("n").alias("s"), F.lit(True).alias("subject_known")), "s", "left").join(names.select(F.col("n").alias("t"), F.lit(True).alias("object_known")), "t", "left")
    deny = F.array_contains("kb", "PROHIBITED")
    clash = (F.size("kb") > 0) & (((F.col("mod") == "PROHIBITED") & ~deny) | ((F.col("mod") != "PROHIBITED") & deny))
    category = (
        F.when(F.col("kb").isNotNull() & clash, "CONFLICT")
        .when(F.col("kb").isNotNull() & F.col("mod").isNotNull() & (F.size("kb") > 0) & ~F.array_contains("kb", F.col("mod")), "TENSION")
        .when(F.col("kb").isNotNull(), "EXISTING")
        .when((F.col("rel").isin(*text.PREVIEW_POSITIVE) & F.col("neg")) | (F.col("rel").isin(*text.NEGATIVE) & F.col("pos")), "CONFLICT")
        .when(F.col("pos").isNotNull(), "RELATED")
        .otherwise("NEW")
    )
    return j.select("triple_id", "subject", "predicate", "object", category.alias("category"), F.coalesce("subject_known", F.lit(False)).alias("subject_known"), F.coalesce("object_known", F.lit(False)).alias("object_known"))


def _normal_triples(triples: DataFrame) -> DataFrame:
    t = triples.filter("subject rlike '(?U)\\\\S' and predicate rlike '(?U)\\\\S' and object rlike '(?U)\\\\S'")
    rel = F.coalesce(text.relationship_type(F.col("predicate")), F.lower(text.strip(F.col("predicate"))))
    return t.withColumns({"s": text.normal(F.col("subject")), "rel": rel, "t": text.normal(F.col("object"))})


def relation_duplicates(triples: DataFrame) -> DataFrame:
    """(s, rel, t, n, predicates): triples that are the same in normal form, with the spellings of their predicate."""
    g = _normal_triples(triples).groupBy("s", "rel", "t").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(text.strip(F.col("predicate")))), "|").alias("predicates"))
    return g.filter("n > 1")


def duplicate_members(triples: DataFrame) -> DataFrame:
    """(triple_id, s, rel, t, predicate, sentence) of the triples in groups of relation_duplicates."""
    t = _normal_triples(triples).select("triple_id", "s", "rel", "t", text.strip(F.col("predicate")).alias("predicate"), "sentence")
    n = t.groupBy("s", "rel", "t").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return t.join(n, ["s", "rel", "t"], "left_semi").select("triple_id", "s", "rel", "t", "predicate", "sentence")
