"""Every query of the core with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import ambiguity, components, conflicts, encoder, hierarchy, ingest, preview, provenance, retrieval, store, verify
from graphloom.session import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYWORD, DOCS = "drift", ("iso-0000001.pdf", "gl-0000001.pdf", "std-0000001.pdf", "memo-0000002.pdf", "rec-0000010.pdf")
TERMS = text.VAGUE_TERMS
BM25_WORDS = ("drift", "report", "retraining")

# --- shared pieces of SQL -------------------------------------------------------------------------
_SPACE = r"[\s\x0b\x85\p{Z}]+"
_NAME = lambda c: f"trim(regexp_replace({c}, '{_SPACE}', ' ', 'g'))"
_NORM = lambda c: f"lower({_NAME(c)})"
_SNAKE = lambda c: f"regexp_replace(regexp_replace(lower(regexp_replace(trim({c}), '([A-Z])', '_\\1', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_REL = lambda c: f"CASE WHEN regexp_matches({_SNAKE(c)}, '^[a-z][a-z0-9_]*$') THEN {_SNAKE(c)} END"
_BLANK = lambda c: f"nullif(trim({c}), '')"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_ONCE = "raw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC NULLS LAST) AS nth FROM provenance_edges) WHERE nth = 1)"
_EDGES = f"""{_ONCE}, e AS (
  SELECT * FROM (SELECT edge_id, {_NAME("source")} AS source, {_REL("predicate")} AS predicate, {_NAME("target")} AS target, docs, records, knowledge_type, created_at FROM raw)
  WHERE source <> '' AND target <> '' AND predicate IS NOT NULL
)"""
_RECORDS = f"""{_EDGES}, r0 AS (
  SELECT source, predicate, target, edge_id, unnest(records) AS r, generate_subscripts(records, 1) AS pos FROM e
), r1 AS (
  SELECT source, predicate, target, edge_id, pos, {_BLANK("r.doc")} AS doc, upper({_BLANK("r.modality")}) AS modality, coalesce({_BLANK("r.quality")}, {_BLANK("r.chunk_excerpt")}) AS text, r.chunk_index AS chunk_index FROM r0 WHERE r IS NOT NULL
), r AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, predicate, target, doc, modality, text, chunk_index ORDER BY edge_id, pos) AS k FROM r1 WHERE doc IS NOT NULL) WHERE k = 1
)"""
_DIMENSION = "CASE lower(trim(name)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.DIMENSION_ALIASES.items()) + " END"
_CANON = f"""alias AS (SELECT name, canonical FROM (SELECT name, {_DIMENSION} AS canonical FROM (SELECT source AS name FROM e UNION SELECT target FROM e)) WHERE canonical <> name)"""
# Decisions on equivalent names, taken from the links.
_LOG = f"lg AS (SELECT source AS term_a, target AS term_b, edge_id % 3 <> 0 AS accept, round((edge_id % 100) / 100.0, 2) AS score, created_at AS decided_at FROM e WHERE predicate = 'is_equivalent_to' AND source <> target)"
_FULL_CANON = f"""{_CANON}, {_LOG},
ac AS (SELECT term_a, term_b FROM (SELECT least(term_a, term_b) AS term_a, greatest(term_a, term_b) AS term_b, accept, row_number() OVER (PARTITION BY least(term_a, term_b), greatest(term_a, term_b) ORDER BY decided_at DESC NULLS LAST, accept DESC, score DESC) AS k FROM lg) WHERE k = 1 AND accept),
lk AS (SELECT term_a AS a, term_b AS b FROM ac UNION SELECT term_b, term_a FROM ac), rc AS (SELECT a AS name, a AS other FROM lk UNION SELECT rc.name, lk.b FROM rc JOIN lk ON lk.a = rc.other),
sa AS (SELECT name, arg_min(other, (length(other), other)) AS canonical FROM rc GROUP BY name),
canon AS (SELECT name, canonical FROM alias WHERE name NOT IN (SELECT name FROM sa) UNION ALL SELECT name, canonical FROM sa)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def raw(spark: SparkSession, d: str) -> DataFrame:
    return provenance.delivered(table(spark, d, "provenance_edges"), "edge_id")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return provenance.edges(table(spark, d, "provenance_edges"))


def records(spark: SparkSession, d: str) -> DataFrame:
    return provenance.records(edges(spark, d))


def dimensions(spark: SparkSession, d: str) -> DataFrame:
    """(name, canonical) of the names that stand for a dimension of another name."""
    return node_names(spark, d).select("name", text.dimension(F.col("name")).alias("canonical")).filter("canonical is not null")


def canon(spark: SparkSession, d: str) -> DataFrame:
    """The dimension aliases overlaid by the clusters of accepted decisions, written once: reports read it more than once."""
    accepted = latest_alignment_decision(spark, d).filter("accept")
    return Scratch(spark).write(components.overlay(dimensions(spark, d), components.same_as(accepted, "term_a", "term_b")))


# --- overlap and coverage ---------------------------------------------------------------------------
@query(
    "overlap_relations",
    f"""WITH {_RECORDS}, d AS (
  SELECT source, predicate, target, count(DISTINCT doc) AS n_docs FROM (SELECT source, predicate, target, {_BLANK("doc")} AS doc FROM (SELECT source, predicate, target, unnest(docs) AS doc FROM e) UNION ALL SELECT source, predicate, target, doc FROM r1)
  WHERE doc IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc) >= 2
), m AS (SELECT source, predicate, target, modality FROM (SELECT *, row_number() OVER (PARTITION BY source, predicate, target, doc ORDER BY edge_id, pos) AS f FROM r WHERE modality IS NOT NULL) WHERE f = 1),
g AS (SELECT source, predicate, target, string_agg(DISTINCT modality, '|' ORDER BY modality) AS modalities FROM m GROUP BY ALL)
SELECT source, predicate, target, n_docs, coalesce(modalities, '') AS modalities, CASE WHEN coalesce(modalities, '') LIKE '%|%' THEN 'TENSION' ELSE 'AGREEMENT' END AS verdict FROM d LEFT JOIN g USING (source, predicate, target)""",
)
def overlap_relations(spark, d):
    e = edges(spark, d)
    return provenance.overlap_relations(e, provenance.records(e))


_COVER = "SELECT doc, count(*) AS assertions, (SELECT count(DISTINCT n) FROM (SELECT source AS n, doc AS dd FROM {0} UNION ALL SELECT target, doc FROM {0}) WHERE dd = x.doc) AS concepts, count(modality) AS normative FROM {0} AS x GROUP BY doc"


@query("document_coverage", f"WITH {_RECORDS} {_COVER.format('r')}")
def document_coverage(spark, d):
    return provenance.document_coverage(records(spark, d))


@query(
    "source_filtered_coverage",
    f"""WITH {_EDGES.replace("e AS (", "e0 AS (")}, e AS (SELECT * FROM e0 WHERE list_has_any(coalesce(docs, []), {list(DOCS)}) OR list_has_any(coalesce(list_transform(records, lambda x: x.doc), []), {list(DOCS)})), {_RECORDS.split(", r0 AS", 1)[0] and "r0 AS" + _RECORDS.split(", r0 AS", 1)[1]} {_COVER.format('r')}""",
)
def source_filtered_coverage(spark, d):
    return provenance.document_coverage(provenance.records(provenance.source_filter(edges(spark, d), list(DOCS))))


_COUNTS = f"""WITH RECURSIVE {_RECORDS}, {_FULL_CANON}, c AS (
  SELECT doc, coalesce(a.canonical, source) AS cs, coalesce(b.canonical, target) AS ct FROM r LEFT JOIN canon a ON a.name = source LEFT JOIN canon b ON b.name = target
), counts AS (SELECT concept, doc, count(*) AS n FROM (SELECT cs AS concept, doc FROM c UNION ALL SELECT ct, doc FROM c WHERE ct <> cs) GROUP BY ALL)"""


@query("concept_matrix", _COUNTS + " SELECT * FROM counts")
def concept_matrix(spark, d):
    """The sparse matrix of concepts, names of one concept being one, and documents."""
    return provenance.concept_counts(records(spark, d), canon(spark, d))


@query("concept_coverage", _COUNTS + " SELECT concept, count(*) AS n_docs, sum(n) AS total FROM counts GROUP BY concept ORDER BY n_docs DESC, total DESC, concept LIMIT 500")
def concept_coverage(spark, d):
    return provenance.concept_coverage(concept_matrix(spark, d))


@query("distinct_sources", f"WITH {_RECORDS} SELECT DISTINCT doc FROM r")
def distinct_sources(spark, d):
    return records(spark, d).select("doc").distinct()


@query("node_names", f"WITH {_EDGES} SELECT source AS name FROM e UNION SELECT target FROM e")
def node_names(spark, d):
    return store.nodes(edges(spark, d))


@query("dimension_names", f"WITH {_EDGES}, {_CANON} SELECT name, canonical FROM alias")
def dimension_names(spark, d):
    return dimensions(spark, d)


@query("canonical_names", f"WITH RECURSIVE {_EDGES}, {_FULL_CANON} SELECT name, canonical FROM canon")
def canonical_names(spark, d):
    return canon(spark, d)


# --- conflicts, by canonical names ------------------------------------------------------------------
_ID = "substr(sha1(concat_ws(chr(31), type, concept, predicate, side_a, doc_a, side_b, doc_b)), 1, 12) AS conflict_id"
_CONFLICT = lambda body: f"SELECT {_ID}, type, concept, predicate, side_a, doc_a, side_b, doc_b FROM ({body})"
_TO_CANON = lambda t: f"SELECT {t}.* REPLACE (coalesce(ca.canonical, {t}.source) AS source, coalesce(cb.canonical, {t}.target) AS target) FROM {t} LEFT JOIN canon ca ON ca.name = {t}.source LEFT JOIN canon cb ON cb.name = {t}.target"
_TO_CANON_SOURCE = "SELECT r.* REPLACE (coalesce(ca.canonical, r.source) AS source) FROM r LEFT JOIN canon ca ON ca.name = r.source"
_BY_CANON = f"WITH RECURSIVE {_RECORDS}, {_FULL_CANON}, cr AS ({_TO_CANON('r')}), sr AS ({_TO_CANON_SOURCE}), ce AS ({_TO_CANON('e')})"
_MODALITY = """SELECT 'MODALITY_CONFLICT' AS type, source AS concept, predicate || ' ' || target AS predicate, a.modality AS side_a, a.doc AS doc_a, b.modality AS side_b, b.doc AS doc_b FROM fm a JOIN fm b USING (source, predicate, target) WHERE a.mr = 1 AND b.mr = 2 AND a.doc <> b.doc"""
_FM = "fm AS (SELECT *, row_number() OVER (PARTITION BY source, predicate, target ORDER BY modality) AS mr FROM (SELECT *, row_number() OVER (PARTITION BY source, predicate, target, modality ORDER BY edge_id, pos) AS f FROM cr WHERE modality IS NOT NULL) WHERE f = 1)"
_DEFS = f"df AS (SELECT source, doc, target AS value FROM (SELECT *, row_number() OVER (PARTITION BY source, doc ORDER BY edge_id, pos) AS f FROM sr WHERE predicate IN {_IN(text.DEFINING)}) WHERE f = 1), dc AS (SELECT source, doc, value FROM (SELECT *, row_number() OVER (PARTITION BY source, lower(value) ORDER BY doc, value) AS f FROM df) WHERE f = 1)"
_DEFINITION = "SELECT 'DEFINITION_DIVERGENCE' AS type, a.source AS concept, 'defines' AS predicate, a.value AS side_a, a.doc AS doc_a, b.value AS side_b, b.doc AS doc_b FROM dc a JOIN dc b ON a.source = b.source AND a.doc < b.doc"
_TAX = f"tx AS (SELECT source, predicate, target, coalesce(doc, '') AS doc FROM (SELECT DISTINCT source, predicate, target FROM ce WHERE predicate IN {_IN(text.TAXONOMY)}) LEFT JOIN (SELECT source, predicate, target, doc FROM (SELECT *, row_number() OVER (PARTITION BY source, predicate, target ORDER BY edge_id, pos) AS f FROM cr) WHERE f = 1) USING (source, predicate, target))"
_TAXONOMY = "SELECT 'TAXONOMY_CONFLICT' AS type, a.source AS concept, a.predicate AS predicate, a.source AS side_a, a.doc AS doc_a, a.target AS side_b, b.doc AS doc_b FROM tx a JOIN tx b ON a.source = b.target AND a.target = b.source AND a.predicate = b.predicate AND a.source < a.target"
_VALS = f"vl AS (SELECT *, row_number() OVER (PARTITION BY source, predicate ORDER BY doc) AS dr FROM (SELECT source, predicate, doc, target AS value FROM (SELECT *, row_number() OVER (PARTITION BY source, predicate, doc ORDER BY edge_id, pos) AS f FROM sr WHERE predicate IN {_IN(text.VALUED)}) WHERE f = 1)), vd AS (SELECT source, predicate FROM vl GROUP BY ALL HAVING count(DISTINCT lower(value)) >= 2)"
_VALUE = "SELECT 'VALUE_CONFLICT' AS type, a.source AS concept, a.predicate AS predicate, a.value AS side_a, a.doc AS doc_a, b.value AS side_b, b.doc AS doc_b FROM vl a JOIN vl b ON a.source = b.source AND a.predicate = b.predicate AND a.dr = 1 AND b.dr = 2 JOIN vd ON vd.source = a.source AND vd.predicate = a.predicate"
_ALL_CONFLICTS = f"{_BY_CANON}, {_FM}, {_DEFS}, {_TAX}, {_VALS} {_CONFLICT(' UNION ALL '.join((_MODALITY, _DEFINITION, _TAXONOMY, _VALUE)))}"


@query("conflict_modality", f"{_BY_CANON}, {_FM} {_CONFLICT(_MODALITY)}")
def conflict_modality(spark, d):
    return conflicts.modality(records(spark, d), canon(spark, d))


@query(
    "conflict_modality_full",
    f"{_BY_CANON}, g AS (SELECT source, predicate, target, modality, min(doc) AS low, max(doc) AS high FROM cr WHERE modality IS NOT NULL GROUP BY ALL), "
    "p AS (SELECT source, predicate, target, a.modality AS side_a, b.modality AS side_b, a.low, a.high, CASE WHEN a.low <> b.low THEN b.low ELSE b.high END AS doc_b FROM g a JOIN g b USING (source, predicate, target) WHERE a.modality < b.modality) "
    + _CONFLICT("SELECT 'MODALITY_CONFLICT' AS type, source AS concept, predicate || ' ' || target AS predicate, side_a, CASE WHEN low <> doc_b THEN low ELSE high END AS doc_a, side_b, doc_b FROM p")
    + " WHERE doc_a <> doc_b",
)
def conflict_modality_full(spark, d):
    """Pairs of modalities of a triple with a document for each; conflict_modality_members has the others."""
    return conflicts.modality_pairs(records(spark, d), canon(spark, d))


@query("conflict_modality_members", f"{_BY_CANON} SELECT DISTINCT source, predicate, target, modality, doc FROM cr WHERE modality IS NOT NULL")
def conflict_modality_members(spark, d):
    return conflicts.modality_members(records(spark, d), canon(spark, d))


@query("conflict_definition", f"{_BY_CANON}, {_DEFS} {_CONFLICT(_DEFINITION)}")
def conflict_definition(spark, d):
    """Pairs of the different definitions of a concept with a document for each; conflict_definition_members has the others."""
    return conflicts.definition(records(spark, d), canon=canon(spark, d))


@query("conflict_definition_members", f"{_BY_CANON}, {_DEFS} SELECT source AS concept, lower(value) AS definition, doc FROM df")
def conflict_definition_members(spark, d):
    return conflicts.definition_members(records(spark, d), canon=canon(spark, d))


@query("conflict_taxonomy", f"{_BY_CANON}, {_TAX} {_CONFLICT(_TAXONOMY)}")
def conflict_taxonomy(spark, d):
    e = edges(spark, d)
    return conflicts.taxonomy(e, provenance.records(e), canon=canon(spark, d))


@query("conflict_value", f"{_BY_CANON}, {_VALS} {_CONFLICT(_VALUE)}")
def conflict_value(spark, d):
    return conflicts.value(records(spark, d), canon=canon(spark, d))


def _scan(spark: SparkSession, e: DataFrame, canon: DataFrame) -> DataFrame:
    """All four kinds of conflicts; four reports read the records, which are written once."""
    r = Scratch(spark).write(provenance.records(e))
    return conflicts.modality(r, canon).unionByName(conflicts.definition(r, canon=canon)).unionByName(conflicts.taxonomy(e, r, canon=canon)).unionByName(conflicts.value(r, canon=canon))


def _equivalences(e: DataFrame) -> DataFrame:
    """Decisions on equivalent names, taken from the links: accepted unless the edge_id is divisible by 3."""
    e = e.filter("predicate = 'is_equivalent_to' and source <> target")
    return e.select(F.col("source").alias("term_a"), F.col("target").alias("term_b"), (F.col("edge_id") % 3 != 0).alias("accept"), F.round((F.col("edge_id") % 100) / 100.0, 2).alias("score"), F.col("created_at").alias("decided_at"))


#: A first review of the conflicts took place then: what it saw is recorded, half of it accepted.
REVIEW = "2025-09-01 00:00:00"
_REVIEWED = _ALL_CONFLICTS.replace("FROM provenance_edges)", f"FROM provenance_edges WHERE ingested_at < TIMESTAMP '{REVIEW}')", 1)
_DECIDED = f"SELECT conflict_id, concept, CASE WHEN ascii(right(conflict_id, 1)) % 2 = 0 THEN 'accepted' ELSE 'dismissed' END AS status, TIMESTAMP '{REVIEW}' AS decided_at FROM ({_REVIEWED})"


def _review_log(spark: SparkSession, d: str) -> DataFrame:
    """The decisions of the first review: the conflicts among what had been delivered by then."""
    e = provenance.edges(table(spark, d, "provenance_edges").filter(f"ingested_at < timestamp_ntz '{REVIEW}'"))
    names = store.nodes(e).select("name", text.dimension(F.col("name")).alias("canonical")).filter("canonical is not null")
    accepted = store.latest_decisions(_equivalences(e)).filter("accept")
    seen = _scan(spark, e, Scratch(spark).write(components.overlay(names, components.same_as(accepted, "term_a", "term_b"))))
    return seen.select("conflict_id", "concept", (F.ascii(F.right("conflict_id", F.lit(1))) % 2 == 0).alias("accepted"), F.expr(f"timestamp_ntz '{REVIEW}'").alias("decided_at"))


@query("recorded_conflicts", _DECIDED)
def recorded_conflicts(spark, d):
    return conflicts.recorded(_review_log(spark, d))


@query("conflict_nodes", f"SELECT conflict_id, concept AS name FROM ({_DECIDED}) WHERE status = 'accepted' AND concept IN (SELECT name FROM (WITH {_EDGES} SELECT source AS name FROM e UNION SELECT target FROM e))")
def conflict_nodes(spark, d):
    """The nodes that accepted conflicts are about."""
    return conflicts.involved(recorded_conflicts(spark, d), node_names(spark, d))


@query("conflicts_excluding_recorded", f"SELECT * FROM ({_ALL_CONFLICTS}) WHERE conflict_id NOT IN (SELECT conflict_id FROM ({_REVIEWED}))")
def conflicts_excluding_recorded(spark, d):
    """All four kinds without those that a first review recorded."""
    return conflicts.excluding(_scan(spark, edges(spark, d), canon(spark, d)), recorded_conflicts(spark, d))


# --- ambiguity --------------------------------------------------------------------------------------
@query(
    "undefined_normative_terms",
    f"""WITH {_RECORDS}, ob AS (SELECT * FROM r WHERE predicate NOT IN {_IN(text.DEFINING)} AND (predicate IN {_IN(text.NORMATIVE)} OR modality IN ('MANDATORY', 'PROHIBITED'))),
t AS (SELECT doc, source AS term, edge_id, pos, predicate, coalesce(text, '') AS example FROM ob UNION ALL SELECT doc, target, edge_id, pos, predicate, coalesce(text, '') FROM ob WHERE target <> source),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, term ORDER BY edge_id, pos) AS k FROM t) WHERE k = 1),
u AS (SELECT doc, term, predicate, example, row_number() OVER (PARTITION BY doc ORDER BY term) AS nth FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE predicate IN {_IN(text.DEFINING)} AND r.doc = f.doc AND lower(r.source) = lower(f.term)))
SELECT doc, term, predicate, example FROM u WHERE nth <= 50""",
)
def undefined_normative_terms(spark, d):
    return ambiguity.undefined_terms(records(spark, d))


@query(
    "vague_language",
    f"""WITH p AS (SELECT doc_id AS doc, paragraph AS text, min(para_id) AS first_id FROM paragraph_matches WHERE doc_id IS NOT NULL AND paragraph IS NOT NULL GROUP BY ALL),
t AS (SELECT unnest({list(TERMS)}) AS term), h AS (SELECT doc, text, first_id, term FROM p, t WHERE regexp_matches(lower(text), '(^|[^a-z])' || term || '([^a-z]|$)')),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, term ORDER BY first_id, text) AS nth FROM h)
SELECT doc, term, count(*) AS n, string_agg(text, ' | ' ORDER BY nth) FILTER (WHERE nth <= 3) AS examples FROM k GROUP BY doc, term""",
)
def vague_language(spark, d):
    p = table(spark, d, "paragraph_matches").select(F.col("doc_id").alias("doc"), F.col("paragraph").alias("text"), F.col("para_id").alias("at"))
    return ambiguity.vague_language(p, TERMS)


# --- verification -----------------------------------------------------------------------------------
_PLACE = lambda c: f"lower(trim(coalesce({c}, ''))) IN {_IN(text.PLACEHOLDER_NAMES)}"
_CHECK = lambda n, bad, total, src, passed=None: f"SELECT '{n}' AS \"check\", CAST({bad} AS BIGINT) AS bad, CAST({total} AS BIGINT) AS total, round(CASE WHEN {total} = 0 THEN 1.0 ELSE ({total} - {bad}) / {total} END, 6) AS score, {passed or f'CASE WHEN {total} = 0 THEN 1.0 ELSE ({total} - {bad}) / {total} END >= {verify.THRESHOLDS[n]}'} AS passed FROM {src}"
_S1 = _CHECK("S1", "(total - hit)", "total", f"(SELECT count(*) AS total, count(h.k) AS hit FROM (SELECT DISTINCT {_NORM('quality')} AS k FROM kept_qualities WHERE {_NORM('quality')} <> '') w LEFT JOIN (SELECT DISTINCT {_NORM('sentence')} AS k FROM neighbor_views WHERE {_NORM('sentence')} <> '') h ON w.k = h.k)")
_S2 = _CHECK("S2", "bad", "total", f"(SELECT n + k AS total, b + k AS bad FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {_PLACE('source')} OR {_PLACE('target')}) AS b FROM raw), (SELECT count(DISTINCT coalesce(x, 'null')) AS k FROM (SELECT source AS x FROM raw UNION ALL SELECT target FROM raw) WHERE trim(coalesce(x, '')) = ''))")
_PAIRS = f"SELECT {_NORM('source')} AS s, {_NORM('target')} AS t, string_agg(DISTINCT predicate, '|' ORDER BY predicate) AS predicates FROM e GROUP BY 1, 2 "
_BAD = f" HAVING bool_or(predicate IN {_IN(text.POSITIVE)}) AND bool_or(predicate IN {_IN(text.NEGATIVE)})"
_S3 = f"SELECT 'S3' AS \"check\", bad, total, CASE WHEN bad = 0 THEN 1.0 ELSE 0.0 END AS score, bad = 0 AS passed FROM (SELECT (SELECT count(*) FROM ({_PAIRS}{_BAD})) AS bad, (SELECT count(*) FROM ({_PAIRS})) AS total)"
_S4 = _CHECK("S4", "bad", "total", f"(SELECT count(*) AS total, count(*) FILTER (WHERE {_PLACE('source')} OR {_PLACE('target')} OR trim(coalesce(predicate, '')) = '' OR (coalesce(len(records), 0) = 0 AND coalesce(len(docs), 0) = 0)) AS bad FROM raw)")
_S5 = _CHECK("S5", "bad", "total", "(SELECT coalesce(sum(n), 0) AS total, coalesce(sum(n - 1), 0) AS bad FROM (SELECT count(*) AS n FROM e GROUP BY source, predicate, target))", "bad = 0")


@query("verify_s1", _S1)
def verify_s1(spark, d):
    """How many distinct kept qualities are covered by a neighbour sentence."""
    return verify.s1(table(spark, d, "kept_qualities").select(F.col("quality").alias("sentence")), table(spark, d, "neighbor_views"))


@query("verify_s2", f"WITH {_ONCE} {_S2}")
def verify_s2(spark, d):
    return verify.s2(raw(spark, d))


@query("verify_s3", f"WITH {_EDGES} {_S3}")
def verify_s3(spark, d):
    return verify.s3(edges(spark, d))


@query("contradictory_pairs", f"WITH {_EDGES} {_PAIRS}{_BAD}")
def contradictory_pairs(spark, d):
    return verify.contradictions(edges(spark, d))


@query("verify_s4", f"WITH {_ONCE} {_S4}")
def verify_s4(spark, d):
    return verify.s4(raw(spark, d))


@query("verify_s5", f"WITH {_EDGES} {_S5}")
def verify_s5(spark, d):
    return verify.s5(edges(spark, d))


@query("verify_verdict", f"WITH {_EDGES}, c AS ({_S1} UNION ALL {_S2} UNION ALL {_S3} UNION ALL {_S4} UNION ALL {_S5}) SELECT CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) FILTER (WHERE NOT passed) AS failed FROM c")
def verify_verdict(spark, d):
    return verify.verdict([f(spark, d) for f in (verify_s1, verify_s2, verify_s3, verify_s4, verify_s5)])


# --- preview and duplicates ---------------------------------------------------------------------------
_MOD = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.MODALITY_OF.items()) + " END"
_PREVIEW = f"""WITH {_RECORDS}, sd AS (SELECT source, predicate, target, list(DISTINCT modality) AS m FROM r WHERE modality IS NOT NULL GROUP BY ALL),
own AS (SELECT {_NORM("source")} AS s, {_NORM("target")} AS t, predicate, coalesce(m, CASE WHEN {_MOD("predicate")} IS NOT NULL THEN [{_MOD("predicate")}] END, []) AS m FROM (SELECT DISTINCT source, predicate, target FROM e) LEFT JOIN sd USING (source, predicate, target)),
bp AS (SELECT s, t, predicate AS rel, flatten(list(m)) AS kb FROM own GROUP BY ALL), pr AS (SELECT s, t, bool_or(rel IN {_IN(text.PREVIEW_POSITIVE)}) AS pos, bool_or(rel IN {_IN(text.NEGATIVE)}) AS neg FROM bp GROUP BY ALL),
nm AS (SELECT {_NORM("source")} AS n FROM e UNION SELECT {_NORM("target")} FROM e),
tr AS (SELECT triple_id, trim(subject) AS subject, trim(predicate) AS predicate, trim(object) AS object, coalesce({_REL("trim(predicate)")}, lower(trim(predicate))) AS rel, {_NORM("trim(subject)")} AS s, {_NORM("trim(object)")} AS t FROM seed_triples WHERE trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> ''),
i AS (SELECT triple_id, subject, predicate, object, CASE
  WHEN kb IS NOT NULL AND len(kb) > 0 AND (({_MOD("tr.rel")} = 'PROHIBITED' AND NOT list_contains(kb, 'PROHIBITED')) OR ({_MOD("tr.rel")} <> 'PROHIBITED' AND list_contains(kb, 'PROHIBITED'))) THEN 'CONFLICT'
  WHEN kb IS NOT NULL AND {_MOD("tr.rel")} IS NOT NULL AND len(kb) > 0 AND NOT list_contains(kb, {_MOD("tr.rel")}) THEN 'TENSION'
  WHEN kb IS NOT NULL THEN 'EXISTING'
  WHEN (tr.rel IN {_IN(text.PREVIEW_POSITIVE)} AND neg) OR (tr.rel IN {_IN(text.NEGATIVE)} AND pos) THEN 'CONFLICT'
  WHEN pos IS NOT NULL THEN 'RELATED' ELSE 'NEW' END AS category, a.n IS NOT NULL AS subject_known, b.n IS NOT NULL AS object_known
  FROM tr LEFT JOIN bp ON tr.s = bp.s AND tr.t = bp.t AND tr.rel = bp.rel LEFT JOIN pr ON tr.s = pr.s AND tr.t = pr.t LEFT JOIN nm a ON a.n = tr.s LEFT JOIN nm b ON b.n = tr.t)"""


@query("preview_items", _PREVIEW + " SELECT * FROM i")
def preview_items(spark, d):
    """The seed triples against the stored edges."""
    e = edges(spark, d)
    return preview.preview(table(spark, d, "seed_triples"), e, provenance.records(e))


@query("preview_summary", _PREVIEW + " SELECT category, count(*) AS n FROM i GROUP BY category")
def preview_summary(spark, d):
    return preview_items(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "relation_duplicates",
    f"""SELECT * FROM (SELECT {_NORM("subject")} AS s, coalesce({_REL("predicate")}, lower(trim(predicate))) AS rel, {_NORM("object")} AS t, count(*) AS n, string_agg(DISTINCT trim(predicate), '|' ORDER BY trim(predicate)) AS predicates
FROM seed_triples WHERE trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> '' GROUP BY 1, 2, 3) WHERE n > 1""",
)
def relation_duplicates(spark, d):
    return preview.relation_duplicates(table(spark, d, "seed_triples"))


# --- graph --------------------------------------------------------------------------------------------
@query(
    "same_as_clusters",
    f"""WITH RECURSIVE {_EDGES}, lk AS (SELECT source AS a, target AS b FROM e WHERE predicate = 'is_equivalent_to' AND source <> target UNION SELECT target, source FROM e WHERE predicate = 'is_equivalent_to' AND source <> target),
rc AS (SELECT a AS name, a AS other FROM lk UNION SELECT rc.name, lk.b FROM rc JOIN lk ON lk.a = rc.other) SELECT name, arg_min(other, (length(other), other)) AS canonical FROM rc GROUP BY name""",
)
def same_as_clusters(spark, d):
    """Clusters over is_equivalent_to links."""
    return components.same_as(edges(spark, d).filter("predicate = 'is_equivalent_to'").select(F.col("source").alias("a"), F.col("target").alias("b")))


@query(
    "type_closure",
    f"""WITH RECURSIVE {_EDGES}, up AS (SELECT DISTINCT source AS name, target AS parent FROM e WHERE predicate = 'is_subclass_of' AND source <> target),
ty AS (SELECT DISTINCT source AS name, target AS type FROM e WHERE predicate = 'is_instance_of'),
cl AS (SELECT name, type FROM ty UNION SELECT up.name, cl.type FROM cl JOIN up ON up.parent = cl.name)
SELECT DISTINCT name, type FROM cl""",
)
def type_closure(spark, d):
    e = edges(spark, d)
    own = e.filter("predicate = 'is_instance_of'").select(F.col("source").alias("name"), F.col("target").alias("type"))
    return components.inherit(own, e.filter("predicate = 'is_subclass_of'").select(F.col("source").alias("name"), F.col("target").alias("parent")))


@query(
    "keyword_subgraph",
    f"""WITH {_EDGES}, h AS (
  (SELECT 1 AS pattern, edge_id, source, predicate, target FROM e WHERE contains(lower(source), '{KEYWORD}') ORDER BY edge_id LIMIT 50) UNION ALL
  (SELECT 2, edge_id, source, predicate, target FROM e WHERE contains(lower(target), '{KEYWORD}') ORDER BY edge_id LIMIT 50) UNION ALL
  (SELECT 3, edge_id, source, predicate, target FROM e WHERE contains(predicate, '{KEYWORD}') OR len(list_filter(coalesce(records, []), lambda x: contains(lower(coalesce(x.quality, '')), '{KEYWORD}'))) > 0 ORDER BY edge_id LIMIT 50))
SELECT edge_id, source, predicate, target, pattern FROM (SELECT *, row_number() OVER (PARTITION BY source, predicate, target ORDER BY pattern, edge_id) AS k FROM h) WHERE k = 1""",
)
def keyword_subgraph(spark, d):
    return store.keyword_subgraph(edges(spark, d), KEYWORD)


@query("full_graph", f"WITH {_EDGES} SELECT edge_id, source, predicate, target FROM e ORDER BY edge_id LIMIT 5000")
def full_graph(spark, d):
    return store.full_graph(edges(spark, d))


@query(
    "two_hop_neighbourhood",
    f"""WITH {_EDGES}, b AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), s AS (SELECT DISTINCT a AS name FROM b WHERE starts_with(lower(a), 'operator of')),
h1 AS (SELECT DISTINCT b.b AS name FROM b JOIN s ON b.a = s.name WHERE b.b NOT IN (SELECT name FROM s)), h2 AS (SELECT DISTINCT b.b AS name FROM b JOIN h1 ON b.a = h1.name WHERE b.b NOT IN (SELECT name FROM s) AND b.b NOT IN (SELECT name FROM h1))
SELECT name, 0 AS distance FROM s UNION ALL SELECT name, 1 FROM h1 UNION ALL SELECT name, 2 FROM h2""",
)
def two_hop_neighbourhood(spark, d):
    e = edges(spark, d)
    return store.neighbourhood(e, store.nodes(e).filter("lower(name) like 'operator of%'"))


@query("incident_relations", f"WITH {_EDGES} SELECT name, sum(o) AS out_edges, sum(i) AS in_edges FROM (SELECT source AS name, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY name")
def incident_relations(spark, d):
    return store.incident(edges(spark, d))


@query("display_nodes", f"WITH {_EDGES} SELECT substr(sha1(name), 1, 12) AS node_id, name AS label FROM (SELECT source AS name FROM e UNION SELECT target FROM e)")
def display_nodes(spark, d):
    return store.display_nodes(edges(spark, d))


@query(
    "upsert_merge",
    f"""WITH {_EDGES}, h AS (SELECT source, predicate, target, min(edge_id) AS edge_id, arg_max(knowledge_type, edge_id) FILTER (WHERE knowledge_type IS NOT NULL) AS knowledge_type, min(created_at) AS created_at FROM e GROUP BY ALL),
dd AS (SELECT source, predicate, target, string_agg(x, '|' ORDER BY edge_id, pos) AS docs FROM (SELECT *, row_number() OVER (PARTITION BY source, predicate, target, x ORDER BY edge_id, pos) AS k FROM (SELECT source, predicate, target, edge_id, unnest(docs) AS x, generate_subscripts(docs, 1) AS pos FROM e) WHERE x IS NOT NULL) WHERE k = 1 GROUP BY ALL),
rr AS (SELECT source, predicate, target, count(DISTINCT x) AS n_records FROM (SELECT source, predicate, target, unnest(records) AS x FROM e) WHERE x IS NOT NULL GROUP BY ALL)
SELECT edge_id, source, predicate, target, coalesce(docs, '') AS docs, coalesce(n_records, 0) AS n_records, knowledge_type, created_at FROM h LEFT JOIN dd USING (source, predicate, target) LEFT JOIN rr USING (source, predicate, target)""",
)
def upsert_merge(spark, d):
    """The stored table after seed edges are there and all edges are upserted."""
    e = edges(spark, d)
    m = store.upsert(e.filter("knowledge_type = 'seed'"), e)
    return m.select("edge_id", *provenance.TRIPLE, F.array_join("docs", "|").alias("docs"), F.size("records").cast("long").alias("n_records"), "knowledge_type", "created_at")


@query("purge_seed", f"WITH {_EDGES}, k AS (SELECT * FROM e WHERE knowledge_type IS DISTINCT FROM 'seed') SELECT source AS name FROM k UNION SELECT target FROM k")
def purge_seed(spark, d):
    """Nodes left when seed knowledge is purged."""
    return store.nodes(store.purge(edges(spark, d), "seed"))


@query(
    "latest_alignment_decision",
    f"WITH {_EDGES}, {_LOG} SELECT term_a, term_b, accept, score, decided_at FROM (SELECT least(term_a, term_b) AS term_a, greatest(term_a, term_b) AS term_b, accept, score, decided_at, row_number() OVER (PARTITION BY least(term_a, term_b), greatest(term_a, term_b) ORDER BY decided_at DESC NULLS LAST, accept DESC, score DESC) AS k FROM lg) WHERE k = 1",
)
def latest_alignment_decision(spark, d):
    """Decisions on equivalent names, taken from the links: accepted unless the edge_id is divisible by 3."""
    return store.latest_decisions(_equivalences(edges(spark, d)))


@query("near_synonyms", f"WITH {_EDGES}, {_LOG}, l AS (SELECT * FROM (SELECT least(term_a, term_b) AS term_a, greatest(term_a, term_b) AS term_b, accept, score, row_number() OVER (PARTITION BY least(term_a, term_b), greatest(term_a, term_b) ORDER BY decided_at DESC NULLS LAST, accept DESC, score DESC) AS k FROM lg) WHERE k = 1) SELECT term_a, term_b, score FROM l WHERE NOT accept AND score >= 0.8")
def near_synonyms(spark, d):
    """Names judged different although they score 0.8 or more."""
    return latest_alignment_decision(spark, d).filter("not accept and score >= 0.8").select("term_a", "term_b", "score")


# --- vectors and texts ----------------------------------------------------------------------------------
_COS = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6)"
_TOP = f"tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, row_id) AS nth FROM (SELECT a.vec_id AS query_id, b.vec_id AS row_id, {_COS} AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE nth <= 10)"


@query("topk_neighbours", f"WITH {_TOP} SELECT * FROM tk")
def topk_neighbours(spark, d):
    """The stated query set - vectors whose id is divisible by 100 - against all vectors."""
    v = table(spark, d, "embeddings")
    return retrieval.top_k(v.filter("vec_id % 100 = 0"), v, "vec_id", "embedding", 10)


@query("similarity_kept", f"WITH {_TOP} SELECT query_id, max(cos) AS max_score, CASE WHEN max(cos) >= 0.4 THEN 'KEPT' ELSE 'DROPPED' END AS decision FROM tk GROUP BY query_id")
def similarity_kept(spark, d):
    return retrieval.kept(topk_neighbours(spark, d), 0.4)


@query("vector_pairs", f"SELECT a, b, round(cos, 4) AS score FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS cos FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id) WHERE cos >= 0.35 ORDER BY score DESC, a, b LIMIT 200")
def vector_pairs(spark, d):
    """The best 200 pairs of all vectors of at least 0.35."""
    return retrieval.best_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.35, 200)


def encoded_sql(rows: str, key: str, body: str, into: str = "") -> str:
    """CTEs {into}gv (key, place, weight) and {into}gn (key, norm) of the encoded texts of rows."""
    norm = _NORM(f"replace({body}, '_', ' ')")
    return f"""{into}gv AS (SELECT k, h % {encoder.DIM} AS b, sum(CASE WHEN (h // {encoder.DIM}) % 2 = 0 THEN 1 ELSE -1 END) AS w FROM (SELECT k, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM (SELECT k, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g FROM (SELECT {key} AS k, ' ' || {norm} || ' ' AS p FROM {rows} WHERE {norm} <> ''))) GROUP BY 1, 2),
{into}gn AS (SELECT k, sqrt(sum(w * w)) AS n FROM {into}gv GROUP BY k HAVING sum(w * w) > 0)"""


@query(
    "alignment_candidates",
    f"""WITH {_EDGES}, {_LOG}, dp AS (SELECT DISTINCT least(term_a, term_b) AS a, greatest(term_a, term_b) AS b FROM lg), nm AS (SELECT source AS name FROM e UNION SELECT target FROM e), {encoded_sql("nm", "name", "name")},
c AS (SELECT x.k AS a, y.k AS b, round(dot / (p.n * q.n), 6) AS cos FROM (SELECT x.k AS xk, y.k AS yk, sum(x.w * y.w) AS dot FROM gv x JOIN gv y ON x.b = y.b AND x.k < y.k GROUP BY ALL) d, (SELECT k FROM gn) x, (SELECT k FROM gn) y, gn p, gn q WHERE x.k = d.xk AND y.k = d.yk AND p.k = d.xk AND q.k = d.yk)
SELECT a, b, round(cos, 4) AS score FROM c ANTI JOIN dp USING (a, b) WHERE cos >= 0.78 ORDER BY score DESC, a, b LIMIT 200""",
)
def alignment_candidates(spark, d):
    """The best 200 pairs of node names of a cosine of at least 0.78 on which no decision is recorded."""
    names = node_names(spark, d).select("name", encoder.encode(F.col("name")).alias("v"))
    decided = latest_alignment_decision(spark, d).select(F.col("term_a").alias("a"), F.col("term_b").alias("b"))
    return retrieval.best_pairs(names, "name", "v", 0.78, 200, decided)


@query("index_search", f"WITH {_TOP}, pl AS (SELECT vec_id AS query_id, unnest(range(1, 13)) AS nth FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, nth, row_id, coalesce(cos, 0.0) AS score FROM pl LEFT JOIN tk USING (query_id, nth)".replace("nth <= 10", "nth <= 12"))
def index_search(spark, d):
    """Twelve places for each query of the stated set, filled up with the score 0.0."""
    v = table(spark, d, "embeddings")
    return encoder.search(v.filter("vec_id % 100 = 0"), v, "vec_id", "embedding", 12)


_LINES = "ln AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, line FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE line <> '')"


@query("document_lines", f"WITH {_LINES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, line FROM ln")
def document_lines(spark, d):
    return ingest.lines(table(spark, d, "documents"))


_SECTION = ingest.SECTION_PREFIX.replace("(?i)", "").replace("\\s", r"[\s\x0b\x85\p{Z}]")
_MARKS = r"[ .:;,\-–—()\[\]{}]+"
_ENDS = lambda c: f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"
_HEADING = lambda c: f"lower({_ENDS('regexp_replace(' + f"replace(regexp_replace({_ENDS('regexp_replace(' + _ENDS('regexp_replace(' + _ENDS(c) + ", '^[#*•\\-–— ]+', '')") + f", '{_SECTION}', '', 'i')")}, '^{_MARKS}|{_MARKS}$', '', 'g'), '&', ' and ')" + f", '{_SPACE}', ' ', 'g')")})"


@query("document_paragraphs", "SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS idx, unnest(p) AS paragraph FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n[ \\t]*\\n+'), lambda x: trim(x) <> '') AS p FROM documents WHERE text IS NOT NULL)")
def document_paragraphs(spark, d):
    return ingest.paragraphs(table(spark, d, "documents"))


@query(
    "reference_cut",
    f"""WITH {_LINES}, n AS (SELECT doc_id, count(*) AS n FROM ln GROUP BY 1),
h AS (SELECT doc_id, min(idx) AS cut FROM ln JOIN n USING (doc_id) WHERE length(line) <= 90 AND {_HEADING('line')} IN {_IN(ingest.REFERENCE_HEADINGS)} AND idx >= greatest(5, CAST(ceil(0.45 * n) AS INTEGER)) GROUP BY 1)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, line FROM ln LEFT JOIN h USING (doc_id) WHERE cut IS NULL OR idx < cut""",
)
def reference_cut(spark, d):
    return ingest.cut_references(ingest.lines(table(spark, d, "documents")), body="line")


_NOISE = " AND ".join(f"NOT regexp_matches(x, '{r}')" for r in ingest.NOISE)


@query("clean_chunks", f"SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_NOISE}), lambda x: {_NAME('x')}), lambda x: x <> ''), ' ') AS chunk FROM documents")
def clean_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", ingest.clean_chunk(F.col("text")).alias("chunk"))


_PARA = "pm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY ingested_at DESC NULLS LAST) AS nth FROM paragraph_matches) WHERE nth = 1)"
GATE, GATE_SYNONYMS = "audit", ("review", "assessor")


@query(
    "keyword_gate",
    f"""WITH {_PARA} SELECT para_id, CASE WHEN regexp_matches(lower(paragraph), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){GATE}([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)') THEN 'exact'
WHEN regexp_matches(lower(paragraph), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({'|'.join(GATE_SYNONYMS)})([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)') THEN 'synonym' WHEN cosine_sim_score >= 0.45 THEN 'near_paragraph_global' ELSE 'unmatched' END AS match FROM pm""",
)
def keyword_gate(spark, d):
    p = provenance.delivered(table(spark, d, "paragraph_matches"), "para_id")
    return ingest.keyword_gate(p, "paragraph", GATE, [*GATE_SYNONYMS], "cosine_sim_score").select("para_id", "match")


_RELEVANCE = f"""{_PARA}, tm AS (SELECT doc_id, para_index, string_agg(DISTINCT t, '|' ORDER BY t) AS terms FROM (SELECT doc_id, para_index, unnest(matched_terms) AS t FROM pm) WHERE t IS NOT NULL GROUP BY ALL),
rl AS (SELECT doc_id, para_index, max(cosine_sim_score) AS max_score, bool_or(coalesce(match_type IN ('exact', 'synonym'), false)) AS literal FROM pm GROUP BY ALL)"""


@query("paragraph_relevance", f"WITH {_RELEVANCE} SELECT doc_id, para_index, max_score, literal, coalesce(terms, '') AS terms FROM rl LEFT JOIN tm USING (doc_id, para_index)")
def paragraph_relevance(spark, d):
    return ingest.paragraph_relevance(provenance.delivered(table(spark, d, "paragraph_matches"), "para_id"))


@query("newly_included", f"WITH {_RELEVANCE} SELECT rl.doc_id, rl.para_index, max_score, coalesce(terms, '') AS terms FROM rl LEFT JOIN tm USING (doc_id, para_index) WHERE NOT literal AND max_score >= 0.4 AND NOT EXISTS (SELECT 1 FROM rl k WHERE k.max_score >= 0.6 AND k.doc_id = rl.doc_id AND k.para_index = rl.para_index)")
def newly_included(spark, d):
    """What a threshold lowered from 0.6 to 0.4 adds."""
    r = paragraph_relevance(spark, d)
    return ingest.newly_included(r, r.filter("max_score >= 0.6"), 0.4).select("doc_id", "para_index", "max_score", "terms")


_NOVEL = """nv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST) AS nth FROM novelty_results) WHERE nth = 1),
nd AS (SELECT result_id, regexp_replace(upper(trim(decision)), '[ -]+', '_', 'g') AS d, len(list_filter(coalesce(novel_spans, []), lambda s: s IS NOT NULL AND trim(s) <> '')) AS n_spans, greatest(0.0, least(1.0, coalesce(confidence, 0.5))) AS confidence FROM nv),
nk AS (SELECT result_id, CASE WHEN k = 'EXISTING' AND n_spans > 0 THEN 'PARTIALLY_NEW' ELSE k END AS decision, confidence, n_spans FROM (SELECT *, CASE WHEN d IN ('EXISTING', 'PARTIALLY_NEW', 'NEW') THEN d ELSE 'PARTIALLY_NEW' END AS k FROM nd))"""


@query("novelty_coercion", f"WITH {_NOVEL} SELECT * FROM nk")
def novelty_coercion(spark, d):
    return ingest.coerce_novelty(provenance.delivered(table(spark, d, "novelty_results"), "result_id"))


@query("novelty_counts", f"WITH {_NOVEL} SELECT decision, count(*) AS n FROM nk GROUP BY decision")
def novelty_counts(spark, d):
    return novelty_coercion(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


_TRIPLES = f"tp AS (SELECT triple_id, trim(subject) AS subject, trim(predicate) AS predicate, trim(object) AS object FROM seed_triples WHERE trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> '')"


@query("triplet_coercion", f"WITH {_TRIPLES} SELECT tp.*, v.l IS NULL AS non_standard, {_MOD('lower(predicate)')} AS modality FROM tp LEFT JOIN (SELECT DISTINCT lower(canonical) AS l FROM predicate_vocab) v ON v.l = lower(predicate)")
def triplet_coercion(spark, d):
    return ingest.coerce_triples(table(spark, d, "seed_triples"), table(spark, d, "predicate_vocab"))


@query("triplet_coercion_strict", f"WITH {_TRIPLES} SELECT tp.*, false AS non_standard, {_MOD('lower(predicate)')} AS modality FROM tp JOIN (SELECT DISTINCT lower(canonical) AS l FROM predicate_vocab) v ON v.l = lower(predicate)")
def triplet_coercion_strict(spark, d):
    return ingest.coerce_triples(table(spark, d, "seed_triples"), table(spark, d, "predicate_vocab"), relaxed=False)


@query("graph_flatten", f"WITH {_TRIPLES}, l AS (SELECT lower(subject) AS s, lower(predicate) AS p, lower(object) AS o FROM tp) SELECT 'entity' AS kind, s AS value FROM l UNION SELECT 'entity', o FROM l UNION SELECT 'edge', p FROM l UNION SELECT 'relation', s || ' | ' || p || ' | ' || o FROM l")
def graph_flatten(spark, d):
    return ingest.flatten_graph(table(spark, d, "seed_triples"))


@query("distinct_qualities", "SELECT vec_id, quality FROM (SELECT vec_id, quality, row_number() OVER (PARTITION BY trim(quality) ORDER BY vec_id) AS k FROM kept_qualities WHERE trim(quality) <> '') WHERE k = 1")
def distinct_qualities(spark, d):
    """The first of each quality by its trimmed text."""
    return ingest.first_by(table(spark, d, "kept_qualities"), text.text_or_null(F.col("quality")), "vec_id", "quality")


@query("quality_batches", "SELECT vec_id, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 5) AS BIGINT) AS batch FROM kept_qualities")
def quality_batches(spark, d):
    return retrieval.batches(table(spark, d, "kept_qualities"), "vec_id", 5)


@query("best_neighbours", "SELECT vec_id, sentence, score FROM (SELECT vec_id, sentence, score, row_number() OVER (PARTITION BY lower(trim(sentence)) ORDER BY score DESC NULLS LAST, vec_id) AS k FROM neighbor_views WHERE trim(sentence) <> '') WHERE k = 1")
def best_neighbours(spark, d):
    """The best scored view of each sentence, case aside."""
    n = table(spark, d, "neighbor_views").withColumn("o", F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), "vec_id"))
    return ingest.first_by(n, F.lower(text.text_or_null(F.col("sentence"))), "o", "vec_id", "sentence", "score").select("vec_id", "sentence", "score")


def _bm25_sql(words, table_="documents", k=10):
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(words))
    score = " + ".join(f"ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * l / avgdl))" for i in range(len(words)))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(words)))
    has = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS nth FROM (SELECT doc_id, round({score}, 6) AS score FROM (SELECT doc_id, len(w) AS l, {tf} FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)) t, (SELECT count(*) AS n, avg(l) AS avgdl, {df} FROM (SELECT len(w) AS l, {tf} FROM (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents))) s WHERE {has} ORDER BY score DESC, doc_id LIMIT {k})"


@query("bm25_topk", _bm25_sql(BM25_WORDS))
def bm25_topk(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", "text", [*BM25_WORDS], 10)


OTHER_WORDS = ("audit", "cycle")


@query("rank_fusion", f"WITH a AS ({_bm25_sql(BM25_WORDS)}), b AS ({_bm25_sql(OTHER_WORDS)}) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(0.5 / (60 + a.nth), 0.0) + coalesce(0.5 / (60 + b.nth), 0.0), 9) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def rank_fusion(spark, d):
    t = table(spark, d, "documents")
    return retrieval.fuse(retrieval.bm25(t, "doc_id", "text", [*BM25_WORDS], 10), retrieval.bm25(t, "doc_id", "text", [*OTHER_WORDS], 10), "doc_id")


@query("stat_block", "SELECT doc_type, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, round(median(n_chars), 6) AS median, round(stddev_samp(n_chars) / sqrt(count(n_chars)), 6) AS sem FROM documents GROUP BY doc_type")
def stat_block(spark, d):
    return retrieval.stat_block(table(spark, d, "documents"), "doc_type", "n_chars")


@query("mine_accuracy", f"WITH {_NOVEL} SELECT count(*) AS n_groups, round(avg(m), 6) AS mean FROM (SELECT model, avg(CASE WHEN nk.decision = 'EXISTING' THEN 1.0 ELSE 0.0 END) AS m, bool_or(nv.rationale IS NULL AND nv.model IS NULL) AS f FROM nv JOIN nk USING (result_id) GROUP BY model) WHERE NOT f")
def mine_accuracy(spark, d):
    """Mean of the models' shares of EXISTING; a model with a row without rationale and name is left out."""
    r = provenance.delivered(table(spark, d, "novelty_results"), "result_id").select("result_id", "model", (F.col("rationale").isNull() & F.col("model").isNull()).alias("failed"))
    return retrieval.two_level_mean(r.join(novelty_coercion(spark, d).select("result_id", (F.col("decision") == "EXISTING").cast("int").alias("hit")), "result_id"), "model", "hit", "failed")


# --- presentation and grouping ----------------------------------------------------------------------------
@query("relation_texts", f"WITH {_EDGES} SELECT DISTINCT source, predicate, target, upper(substr(t, 1, 1)) || substr(t, 2) AS text FROM (SELECT source, predicate, target, replace(source || ' ' || predicate || ' ' || target, '_', ' ') AS t FROM e)")
def relation_texts(spark, d):
    """Stored triples in words, with a capital first letter."""
    e = edges(spark, d).select(*provenance.TRIPLE).distinct()
    return e.select("*", text.relation_text(F.col("source"), F.col("predicate"), F.col("target"), F.lit(None).cast("string")).alias("text"))


@query("family_counts", f"WITH {_EDGES} SELECT coalesce(family, 'other') AS family, count(*) AS n, count(DISTINCT predicate) AS n_predicates FROM e LEFT JOIN (SELECT DISTINCT rel_type, family FROM predicate_vocab) v ON v.rel_type = predicate GROUP BY 1")
def family_counts(spark, d):
    """Edges and distinct predicates by family of the vocabulary; the vocabulary is a fixed small table."""
    v = table(spark, d, "predicate_vocab").select(F.col("rel_type").alias("predicate"), "family").distinct()
    by = edges(spark, d).groupBy("predicate").agg(F.count("*").alias("n")).join(v, "predicate", "left")
    return by.groupBy(F.coalesce("family", F.lit("other")).alias("family")).agg(F.sum("n").alias("n"), F.count("*").alias("n_predicates"))


@query("score_histogram", "SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM neighbor_views WHERE score BETWEEN 0 AND 1 GROUP BY 1")
def score_histogram(spark, d):
    """Ten bins of the neighbour scores between 0 and 1."""
    n = table(spark, d, "neighbor_views").filter("score between 0 and 1")
    return n.groupBy(F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("included_results", f"WITH {_PARA} SELECT para_id FROM pm WHERE match_type IN ('exact', 'synonym') OR cosine_sim_score IS NULL OR cosine_sim_score >= 0.6")
def included_results(spark, d):
    """Literal matches, those without a score, and those that reach the threshold."""
    p = provenance.delivered(table(spark, d, "paragraph_matches"), "para_id")
    return p.filter("match_type in ('exact', 'synonym') or cosine_sim_score is null or cosine_sim_score >= 0.6").select("para_id")


@query("payload_groups", f"WITH {_RECORDS} SELECT doc, text, count(DISTINCT (source, predicate, target)) AS n_triples, count(*) AS n_records FROM r WHERE text IS NOT NULL GROUP BY doc, text")
def payload_groups(spark, d):
    """Distinct triples and records by document and sentence."""
    r = records(spark, d).filter("text is not null")
    by = r.groupBy("doc", "text", *provenance.TRIPLE).agg(F.count("*").alias("n"))
    return by.groupBy("doc", "text").agg(F.count("*").alias("n_triples"), F.sum("n").alias("n_records"))


@query(
    "strongest_modality",
    f"""WITH {_RECORDS}, m AS (SELECT DISTINCT source, predicate, target, modality FROM r WHERE modality IS NOT NULL)
SELECT source, predicate, target, CASE WHEN bool_or(modality = 'PROHIBITED') THEN 'PROHIBITED' WHEN bool_or(modality = 'MANDATORY') THEN 'MANDATORY' WHEN bool_or(modality = 'RECOMMENDED') THEN 'RECOMMENDED' WHEN bool_or(modality = 'OPTIONAL') THEN 'OPTIONAL' END AS modality FROM m GROUP BY ALL""",
)
def strongest_modality(spark, d):
    """The strongest known modality of each triple that has any; null if none of them is known."""
    m = records(spark, d).filter("modality is not null").groupBy(*provenance.TRIPLE).agg(F.collect_set("modality").alias("m"))
    return m.select(*provenance.TRIPLE, text.strongest(F.col("m")).alias("modality"))


@query("key_words", f"WITH {_EDGES} SELECT name, array_to_string(regexp_extract_all(lower(replace(name, '_', ' ')), '[a-z0-9+#.-]+'), ' ') AS words FROM (SELECT source AS name FROM e UNION SELECT target FROM e)")
def key_words(spark, d):
    """The schema key of every node name."""
    return node_names(spark, d).select("name", text.key_words(F.col("name")).alias("words"))


@query("rejected_edges", f"WITH {_EDGES} SELECT edge_id FROM raw WHERE edge_id NOT IN (SELECT edge_id FROM e)")
def rejected_edges(spark, d):
    """Rows that the store rejects: a blank name or no safe predicate."""
    return raw(spark, d).select("edge_id").join(edges(spark, d).select("edge_id"), "edge_id", "left_anti")


_TREE = f"""WITH RECURSIVE lk AS (SELECT node, min(parent) AS parent FROM (SELECT trim(source) AS node, trim(target) AS parent FROM provenance_edges WHERE lower(regexp_replace(predicate, '[^\\p{{L}}\\p{{N}}]', '', 'g')) = 'issubclassof' AND trim(source) <> '' AND trim(target) <> '') GROUP BY node),
up AS (SELECT node, parent AS cur, [node] AS path FROM lk UNION ALL SELECT up.node, lk.parent, list_append(up.path, lk.node) FROM up JOIN lk ON lk.node = up.cur WHERE NOT list_contains(up.path, up.cur)),
en AS (SELECT * FROM up WHERE list_contains(path, cur) OR cur NOT IN (SELECT node FROM lk)),
tr AS (SELECT node, cur AS root, list_reverse(list_append(path, cur)) AS path FROM en WHERE NOT list_contains(path, cur) UNION ALL SELECT DISTINCT cur, cur, [cur] FROM en WHERE NOT list_contains(path, cur))"""
SQL["p3_found"] = f"""{_TREE}, nd AS (SELECT cur AS node, count(*) AS n FROM up WHERE NOT list_contains(path, cur) GROUP BY cur)
SELECT node, 'tree' AS kind, root, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, ' > ') AS path, CAST(coalesce(n, 0) AS INTEGER) AS n_desc FROM tr LEFT JOIN nd USING (node)
UNION ALL SELECT node, CASE WHEN cur = node THEN 'cycle' ELSE 'below_cycle' END, '', -1, '', -1 FROM en WHERE list_contains(path, cur)"""
SQL["p3_descendants"] = f"{_TREE} SELECT ancestor, node, CAST(n - nth AS INTEGER) AS distance FROM (SELECT node, len(path) AS n, unnest(path) AS ancestor, generate_subscripts(path, 1) AS nth FROM tr) WHERE nth < n"
QUERIES["p3_found"] = hierarchy.p3_found
QUERIES["p3_descendants"] = hierarchy.p3_descendants


def _full_trim(sql: str) -> str:
    """trim() of every kind of white space, as the Spark side does."""
    while (at := sql.find("trim(")) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}regexp_replace({sql[at + 5 : end - 1]}, '^{_SPACE}|{_SPACE}$', '', 'g'){sql[end:]}"
    return sql


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: _full_trim(v) for k, v in SQL.items()}
