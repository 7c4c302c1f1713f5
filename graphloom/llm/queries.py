"""The queries of the training-data operators, over the whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import canonical, encode, formatting, packing, pairs, sentences, similar, splitting
from graphloom.session import blank, table

#: Capacity of a container; limit and overlap of pieces; all in tokens of byte_bpe_50k.
CAPACITY, LIMIT, OVERLAP = 4096, 512, 64


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    languages = pairs.fit_languages(table(spark, folder, "documents"), "text", "lang")
    results = table(spark, folder, "novelty_results")
    return pairs.find_defects(results, languages, pairs.fit_refusals(results, "rationale"), when="ingested_at")


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The number of defective results of each kind."""
    return p1_found(spark, folder).groupBy("defect").agg(F.count("*").alias("n_results"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "paragraph_matches").groupBy("para_id").agg(F.max_by("paragraph", F.struct("ingested_at", "paragraph")).alias("paragraph"))
    return sentences.split_sentences(rows, "para_id", "paragraph")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "kept_qualities").select("vec_id", "vector").unionByName(table(spark, folder, "neighbor_views").select("vec_id", "vector"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar.pairs(similar.nearest(_vectors(spark, folder), "vec_id", "vector"), "vec_id")


def p4_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the true nearest are missed, by exact search for every vector whose id is divisible by 100."""
    v = _vectors(spark, folder)
    return similar.recall(similar.nearest(v, "vec_id", "vector"), v, "vec_id", "vector")


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "predicate_vocab")
    return v.select("pred_id", F.explode(F.concat(F.array("canonical", "rel_type"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelling"))


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, row_id, predicate) of the predicates that are not spelt exactly as in the vocabulary."""
    edges, seeds, v = (table(spark, folder, n) for n in ("provenance_edges", "seed_triples", "predicate_vocab"))
    rows = edges.select(F.lit("provenance_edges").alias("tbl"), F.col("edge_id").alias("row_id"), "predicate").unionByName(seeds.select(F.lit("seed_triples").alias("tbl"), F.col("triple_id").alias("row_id"), "predicate"))
    exact = v.select(F.explode(F.array("canonical", "rel_type")).alias("predicate")).distinct()
    return rows.filter(~blank("predicate")).join(exact, "predicate", "left_anti")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    got = canonical.canonicalise(_typed(spark, folder), "predicate", _vocabulary(spark, folder), "pred_id", "spelling", out="pred_id")
    return got.select("tbl", "row_id", "pred_id").distinct()


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values that fit no entry, and how many rows have them."""
    got = canonical.canonicalise(_typed(spark, folder).distinct(), "predicate", _vocabulary(spark, folder), "pred_id", "spelling", out="pred_id")
    return got.filter("pred_id = -1").groupBy("predicate").agg(F.count("*").alias("n_rows"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return formatting.copies(table(spark, folder, "seed_triples"), "triple_id", "raw_record")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return formatting.groups(table(spark, folder, "seed_triples"), "triple_id", "raw_record").select("keep_id", "copies", "variants", *formatting.FIELDS)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(table(spark, folder, "documents").select("doc_id", "text"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = encode.token_counts(table(spark, folder, "documents").select("doc_id", "text"))
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p8_containers(spark, folder), CAPACITY)


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_long(table(spark, folder, "documents"), "doc_id", "text", LIMIT, OVERLAP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_counts, p2_found, p4_found, p4_recall, p5_found, p5_unmatched, p6_found, p6_groups, p7_ids, p8_containers, p8_fill, p9_pieces)}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_FOUND, "p6_groups": P6_GROUPS}


_P6_ROWS = r"""
WITH r AS (
  SELECT triple_id,
    subject IS NULL AND predicate IS NULL AND object IS NULL AND raw_record IS NOT NULL AS is_raw, subject, predicate, object, raw_record
  FROM seed_triples
), c AS (
  SELECT triple_id,
    replace(replace(lower(upper(regexp_replace(coalesce(CASE WHEN is_raw THEN json_extract_string(raw_record, '$.subject') ELSE subject END, ''), '[^\p{L}\p{N}]', '', 'g'))), 'ß', 'ss'), 'ς', 'σ') AS subject,
    replace(replace(lower(upper(regexp_replace(coalesce(CASE WHEN is_raw THEN json_extract_string(raw_record, '$.predicate') ELSE predicate END, ''), '[^\p{L}\p{N}]', '', 'g'))), 'ß', 'ss'), 'ς', 'σ') AS predicate,
    replace(replace(lower(upper(regexp_replace(coalesce(CASE WHEN is_raw THEN json_extract_string(raw_record, '$.object') ELSE object END, ''), '[^\p{L}\p{N}]', '', 'g'))), 'ß', 'ss'), 'ς', 'σ') AS object,
    concat_ws('|', coalesce(r.subject, chr(1)), coalesce(r.predicate, chr(1)), coalesce(r.object, chr(1)), coalesce(raw_record, chr(1))) AS spelt
  FROM r
)
"""
P6_FOUND = _P6_ROWS + """
SELECT keep_id, triple_id AS copy_id FROM (SELECT triple_id, min(triple_id) OVER (PARTITION BY subject, predicate, object) AS keep_id FROM c) WHERE triple_id > keep_id
"""
P6_GROUPS = _P6_ROWS + """
SELECT min(triple_id) AS keep_id, count(*) AS copies, count(DISTINCT spelt) AS variants, subject, predicate, object FROM c GROUP BY subject, predicate, object
"""
