"""Conflicts between documents: obligation strength, definition, taxonomy and value.

The modality and value reports compare the first two modalities or documents in the order of their names, each with its first
record. Where every difference counts, what says the same is one class with a representative document: pairs are pairs of classes, and
the members of a class are a report of their own, so that a name in many documents doesn't give all pairs of them.

With canon, (name, canonical) unique in name, sources and targets are grouped by their canonical names, and concepts are canonical
names; the definitions and values shown stay as they are written. Names that it lacks stand for themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators.provenance import TRIPLE

OUT = ("conflict_id", "type", "concept", "predicate", "side_a", "doc_a", "side_b", "doc_b")
_AT = ("edge_id", "pos")


def _out(df: DataFrame, kind: str, concept: Column | str, predicate: Column | str) -> DataFrame:
    c, p = (F.col(x) if isinstance(x, str) else x for x in (concept, predicate))
    ident = text.short_id(F.lit(kind), c, p, F.col("side_a"), F.col("doc_a"), F.col("side_b"), F.col("doc_b"))
    return df.select(ident.alias("conflict_id"), F.lit(kind).alias("type"), c.alias("concept"), p.alias("predicate"), "side_a", "doc_a", "side_b", "doc_b")


def _first_two(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """The two smallest values of `side` in each group, next to each other."""
    shown = F.struct(*dict.fromkeys((side, "doc", *[c for c in ("value",) if c in df.columns])))
    pair = df.groupBy(*keys).agg(F.min(shown).alias("a"), F.count("*").alias("n")).filter("n >= 2")
    rest = df.join(pair.select(*keys, "a"), keys).filter(F.col(side) > F.col(f"a.{side}"))
    second = rest.groupBy(*keys).agg(F.min(shown).alias("b"))
    return pair.join(second, keys)


def _canonical(rows: DataFrame, canon: DataFrame | None, *columns: str) -> DataFrame:
    """The rows with canonical names in the columns."""
    if canon is None:
        return rows
    for c in columns:
        to = canon.select(F.col("name").alias(c), F.col("canonical").alias("_canonical"))
        rows = rows.join(to, c, "left").withColumn(c, F.coalesce("_canonical", c)).drop("_canonical")
    return rows


def modality(r: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """A triple stated with different obligation strengths by different documents: the first two modalities by name."""
    rows = _canonical(r.filter("modality is not null"), canon, "source", "target")
    first = rows.groupBy(*TRIPLE, "modality").agg(F.min_by("doc", F.struct(*_AT)).alias("doc"))
    both = _first_two(first, [*TRIPLE], "modality").selectExpr(*TRIPLE, "a.modality as side_a", "a.doc as doc_a", "b.modality as side_b", "b.doc as doc_b").filter("doc_a <> doc_b")
    return _out(both, "MODALITY_CONFLICT", "source", F.concat_ws(" ", "predicate", "target"))


def modality_members(r: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """(source, predicate, target, modality, doc): the documents that state a triple with a modality."""
    return _canonical(r.filter("modality is not null"), canon, "source", "target").select(*TRIPLE, "modality", "doc").distinct()


def modality_pairs(r: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """Every two modalities of a triple that different documents state, each with a document: the smallest, or the largest of the side that has another one."""
    g = _canonical(r.filter("modality is not null"), canon, "source", "target").groupBy(*TRIPLE, "modality").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    b = g.withColumnsRenamed({"modality": "side_b", "low": "low_b", "high": "high_b"})
    both = g.withColumnRenamed("modality", "side_a").join(b, [*TRIPLE]).filter("side_a < side_b")
    both = both.withColumn("doc_b", F.when(F.col("low") != F.col("low_b"), F.col("low_b")).otherwise(F.col("high_b")))
    both = both.withColumn("doc_a", F.when(F.col("low") != F.col("doc_b"), F.col("low")).otherwise(F.col("high"))).filter("doc_a <> doc_b")
    return _out(both, "MODALITY_CONFLICT", "source", F.concat_ws(" ", "predicate", "target"))


def _by_doc(r: DataFrame, predicates: tuple[str, ...], keys: list[str], canon: DataFrame | None) -> DataFrame:
    return _canonical(r.filter(F.col("predicate").isin(*predicates)), canon, "source").groupBy(*keys, "doc").agg(F.min_by("target", F.struct(*_AT)).alias("value"))


def definition_members(r: DataFrame, predicates: tuple[str, ...] = text.DEFINING, canon: DataFrame | None = None) -> DataFrame:
    """(concept, definition, doc): the documents whose first definition of a concept it is, case aside."""
    return _by_doc(r, predicates, ["source"], canon).select(F.col("source").alias("concept"), F.lower("value").alias("definition"), "doc")


def definition(r: DataFrame, predicates: tuple[str, ...] = text.DEFINING, canon: DataFrame | None = None) -> DataFrame:
    """A concept defined differently by two documents, each with its first definition: pairs of the different definitions, each with its smallest document."""
    d = _by_doc(r, predicates, ["source"], canon).groupBy("source", F.lower("value").alias("low")).agg(F.min(F.struct("doc", "value")).alias("f")).select("source", "f.*")
    b = d.withColumnsRenamed({"value": "side_b", "doc": "doc_b"})
    both = d.withColumnsRenamed({"value": "side_a", "doc": "doc_a"}).join(b, "source").filter("doc_a < doc_b")
    return _out(both, "DEFINITION_DIVERGENCE", "source", F.lit("defines"))


def taxonomy(e: DataFrame, r: DataFrame, predicates: tuple[str, ...] = text.TAXONOMY, canon: DataFrame | None = None) -> DataFrame:
    """Two names placed below each other; the smaller name comes first, with the first document of each side or ''."""
    t = _canonical(e.filter(F.col("predicate").isin(*predicates)).select(*TRIPLE).distinct(), canon, "source", "target").distinct()
    docs = _canonical(r.filter(F.col("predicate").isin(*predicates)), canon, "source", "target").groupBy(*TRIPLE).agg(F.min_by("doc", F.struct(*_AT)).alias("doc"))
    t = t.join(docs, [*TRIPLE], "left").withColumn("doc", F.coalesce("doc", F.lit("")))
    b = t.select(F.col("target").alias("source"), "predicate", F.col("source").alias("target"), F.col("doc").alias("doc_b"))
    both = t.join(b, [*TRIPLE]).filter("source < target").select(F.col("source").alias("side_a"), F.col("doc").alias("doc_a"), F.col("target").alias("side_b"), "doc_b", "predicate")
    return _out(both, "TAXONOMY_CONFLICT", F.col("side_a"), "predicate")


def value(r: DataFrame, predicates: tuple[str, ...] = text.VALUED, canon: DataFrame | None = None) -> DataFrame:
    """Different values of a concept; the first two documents are shown, even if a third has the different one."""
    d = _by_doc(r, predicates, ["source", "predicate"], canon)
    some = d.groupBy("source", "predicate").agg(F.min(F.lower("value")).alias("lo"), F.max(F.lower("value")).alias("hi")).filter("lo <> hi").select("source", "predicate")
    both = _first_two(d.join(some, ["source", "predicate"], "left_semi"), ["source", "predicate"], "doc")
    both = both.selectExpr("source", "predicate", "a.value as side_a", "a.doc as doc_a", "b.value as side_b", "b.doc as doc_b")
    return _out(both, "VALUE_CONFLICT", "source", "predicate")


def recorded(log: DataFrame) -> DataFrame:
    """The decisions on conflicts, (conflict_id, concept, accepted, decided_at), the last of each conflict_id, ties to accepted; blank ids are left out."""
    ok = log.filter(text.strip(F.col("conflict_id")) != "").select("conflict_id", "concept", "accepted", "decided_at")
    return ok.groupBy("conflict_id").agg(F.max(F.struct("decided_at", "accepted", "concept")).alias("d")).select("conflict_id", "d.concept", F.when(F.col("d.accepted"), "accepted").otherwise("dismissed").alias("status"), "d.decided_at")


def involved(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conflict_id, name): accepted conflicts and the node of their concept, where there is one."""
    return decisions.filter("status = 'accepted'").select("conflict_id", F.col("concept").alias("name")).join(nodes.select("name").distinct(), "name", "left_semi").select("conflict_id", "name")


def excluding(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Conflicts whose id is not recorded."""
    return found.join(recorded.select("conflict_id").distinct(), "conflict_id", "left_anti")
