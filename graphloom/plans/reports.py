"""More queries of the core with their SQL: review, grounding, similarity by entities, ordered reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import components, encoder, grounding, ingest, node_entity, phrases, preview, provenance, quality, retrieval, review, store, verify
from graphloom.plans import catalog
from graphloom.plans.catalog import _ALL_CONFLICTS, _EDGES, _FULL_CANON, _IN, _LINES, _NORM, _NOVEL, _ONCE, _PARA, _PREVIEW, _RECORDS, _RELEVANCE, _REL, _TRIPLES, edges, encoded_sql, query, raw, records
from graphloom.session import Scratch, table

_REPORT = lambda name, order: f"SELECT * FROM ({catalog.SQL[name]}) ORDER BY {order}"
_SPACED = lambda c: f"trim(regexp_replace({c}, '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g'))"
_CLEAN = lambda c: f"trim(coalesce({c}, ''))"


def paragraphs(spark, d):
    return provenance.delivered(table(spark, d, "paragraph_matches"), "para_id")


def novelty(spark, d):
    return provenance.delivered(table(spark, d, "novelty_results"), "result_id")


# --- orders of reports -----------------------------------------------------------------------------
@query("overlap_report", _REPORT("overlap_relations", "verdict = 'TENSION' DESC, n_docs DESC, source, predicate, target"))
def overlap_report(spark, d):
    """Shared triples, tensions first, then those of the most documents."""
    return catalog.overlap_relations(spark, d).orderBy(F.desc(F.col("verdict") == "TENSION"), F.desc("n_docs"), *provenance.TRIPLE)


@query("coverage_report", _REPORT("document_coverage", "assertions DESC, doc"))
def coverage_report(spark, d):
    return catalog.document_coverage(spark, d).orderBy(F.desc("assertions"), "doc")


@query("vague_report", _REPORT("vague_language", "doc, n DESC, term"))
def vague_report(spark, d):
    return catalog.vague_language(spark, d).orderBy("doc", F.desc("n"), "term")


@query("preview_report", _REPORT("preview_items", f"list_position({list(review.CATEGORIES)}, category), triple_id"))
def preview_report(spark, d):
    """The preview, conflicts first."""
    return catalog.preview_items(spark, d).orderBy(F.array_position(F.array(*(F.lit(c) for c in review.CATEGORIES)), F.col("category")), "triple_id")


@query("kept_report", _REPORT("similarity_kept", "max_score DESC, query_id"))
def kept_report(spark, d):
    return catalog.similarity_kept(spark, d).orderBy(F.desc("max_score"), "query_id")


@query("review_sheet", f"WITH {_RECORDS} SELECT coalesce(CAST(chunk_index AS VARCHAR), '') AS chunk, text AS quality, edge_id, pos, source, predicate, target, doc FROM (SELECT * REPLACE (pos - 1 AS pos) FROM r) ORDER BY chunk_index NULLS LAST, quality NULLS LAST, edge_id, pos")
def review_sheet(spark, d):
    """The records by chunk and quality, those without one last."""
    r = records(spark, d).select("chunk_index", F.col("text").alias("quality"), "edge_id", "pos", *provenance.TRIPLE, "doc")
    ordered = r.orderBy(F.asc_nulls_last("chunk_index"), F.asc_nulls_last("quality"), "edge_id", "pos")
    return ordered.select(F.coalesce(F.col("chunk_index").cast("string"), F.lit("")).alias("chunk"), "quality", "edge_id", "pos", *provenance.TRIPLE, "doc")


@query(
    "overlap_summary",
    f"""WITH RECURSIVE {_RECORDS}, {_FULL_CANON}, cs AS (SELECT coalesce(a.canonical, n) AS concept FROM (SELECT source AS n FROM r UNION SELECT target FROM r) LEFT JOIN canon a ON a.name = n)
SELECT (SELECT count(*) FROM (SELECT DISTINCT source, predicate, target FROM e)) AS n_triples, (SELECT count(DISTINCT doc) FROM r) AS n_docs, (SELECT count(*) FROM ({catalog.SQL["overlap_relations"]})) AS n_shared, (SELECT count(*) FROM ({catalog.SQL["overlap_relations"]}) WHERE verdict = 'TENSION') AS n_tensions, (SELECT count(DISTINCT concept) FROM cs) AS n_concepts""",
)
def overlap_summary(spark, d):
    """The overlap report in one row: triples, documents, shared triples, tensions and concepts by canonical names."""
    e = edges(spark, d)
    r = provenance.records(e)
    shared = provenance.overlap_relations(e, r).agg(F.count("*").alias("n_shared"), F.count_if(F.col("verdict") == "TENSION").alias("n_tensions"))
    concepts = provenance.concept_counts(r, catalog.canon(spark, d)).agg(F.countDistinct("concept").alias("n_concepts"))
    n = e.select(*provenance.TRIPLE).distinct().agg(F.count("*").alias("n_triples"))
    return n.crossJoin(r.agg(F.countDistinct("doc").alias("n_docs"))).crossJoin(shared).crossJoin(concepts)


_TERM = lambda c: f"SELECT '{c}' AS kind"


@query(
    "ambiguity_export",
    f"SELECT 'undefined' AS kind, doc, term, predicate AS detail, CAST(NULL AS VARCHAR) AS n FROM ({catalog.SQL['undefined_normative_terms']}) UNION ALL SELECT 'vague', CAST(doc AS VARCHAR), term, examples, CAST(n AS VARCHAR) FROM ({catalog.SQL['vague_language']}) UNION ALL SELECT 'near_synonym', NULL, term_a, term_b, NULL FROM ({catalog.SQL['near_synonyms']})",
)
def ambiguity_export(spark, d):
    """The three reports on ambiguity in one sheet."""
    u = catalog.undefined_normative_terms(spark, d).select(F.lit("undefined").alias("kind"), "doc", "term", F.col("predicate").alias("detail"))
    v = catalog.vague_language(spark, d).select(F.lit("vague").alias("kind"), F.col("doc").cast("string").alias("doc"), "term", F.col("examples").alias("detail"), F.col("n").cast("string").alias("n"))
    s = catalog.near_synonyms(spark, d).select(F.lit("near_synonym").alias("kind"), F.col("term_a").alias("term"), F.col("term_b").alias("detail"))
    return u.unionByName(v, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)


# --- upserts and their checks ------------------------------------------------------------------------
@query("upsert_summary", f"WITH {_ONCE}, k AS (SELECT {_SPACED('coalesce(source, chr(32))')} <> '' AND {_SPACED('coalesce(target, chr(32))')} <> '' AND {_REL('predicate')} IS NOT NULL AS ok FROM raw) SELECT count(*) AS attempted, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed FROM k")
def upsert_summary(spark, d):
    return review.upsert_summary(raw(spark, d))


_WHOLE = f"({_CLEAN('subject')} <> '' AND {_CLEAN('predicate')} <> '' AND {_CLEAN('object')} <> '')"


@query("request_check", f"SELECT batch, count(*) AS n_triples, count(*) FILTER (WHERE NOT {_WHOLE}) AS n_malformed, count(*) FILTER (WHERE {_WHOLE} AND {_REL('predicate')} IS NULL) > 0 AS rejected FROM seed_triples GROUP BY batch")
def request_check(spark, d):
    """Each batch of seed triples as one request."""
    return review.request_check(table(spark, d, "seed_triples"), "batch")


_SEEDS = f"sr AS (SELECT triple_id, row_number() OVER (ORDER BY triple_id) - 1 AS chunk_index, * EXCLUDE (triple_id) FROM (SELECT triple_id, {_SPACED('subject')} AS source, {_REL('predicate')} AS predicate, {_SPACED('object')} AS target, sentence FROM seed_triples) WHERE source <> '' AND target <> '' AND predicate IS NOT NULL)"


@query("triplet_relations", f"WITH {_SEEDS} SELECT triple_id, source, predicate, target, sentence FROM sr")
def triplet_relations(spark, d):
    return review.relations(table(spark, d, "seed_triples"), "triple_id").select("triple_id", *provenance.TRIPLE, "sentence")


@query("seed_relations", f"WITH {_SEEDS} SELECT triple_id, chunk_index, source, predicate, target, sentence, 'seed' AS knowledge_type FROM sr")
def seed_relations(spark, d):
    """Seed triples as relations, numbered."""
    return review.relations(table(spark, d, "seed_triples"), "triple_id", "seed")


@query("upsert_extracted", f"WITH {_SEEDS}, {_EDGES} SELECT source, predicate, target, bool_or(old) AS known, bool_or(NOT old) AS incoming FROM (SELECT source, predicate, target, true AS old FROM e UNION ALL SELECT source, predicate, target, false FROM sr) GROUP BY ALL")
def upsert_extracted(spark, d):
    """The triples of the store after the extracted ones are upserted: which were known and which came in."""
    old = edges(spark, d).select(*provenance.TRIPLE, F.lit(True).alias("old"))
    new = triplet_relations(spark, d).select(*provenance.TRIPLE, F.lit(False).alias("old"))
    return old.unionByName(new).groupBy(*provenance.TRIPLE).agg(F.max("old").alias("known"), F.max(~F.col("old")).alias("incoming"))


@query("seed_graph", f"WITH {_SEEDS}, {_EDGES}, k AS (SELECT source, target FROM e WHERE knowledge_type IS DISTINCT FROM 'seed' UNION ALL SELECT source, target FROM sr) SELECT source AS name FROM k UNION SELECT target FROM k")
def seed_graph(spark, d):
    """The nodes after the old seed knowledge is purged and the seed triples are written."""
    left = store.purge(edges(spark, d), "seed").select("source", "target")
    return store.nodes(left.unionByName(seed_relations(spark, d).select("source", "target")))


@query(
    "clean_provenance",
    f"""WITH {_ONCE}, x AS (SELECT edge_id, unnest(records) AS r, generate_subscripts(records, 1) - 1 AS pos FROM raw), c AS (SELECT edge_id, pos, {_CLEAN('r.doc')} AS doc, {_CLEAN('r.quality')} AS quality, r.chunk_index AS chunk_index, substr({_CLEAN('r.chunk_excerpt')}, 1, 500) AS chunk_excerpt, CASE WHEN upper({_CLEAN('r.modality')}) IN {_IN(review.MODALITIES)} THEN upper({_CLEAN('r.modality')}) ELSE '' END AS modality FROM x)
SELECT * REPLACE (coalesce(chunk_index, -1) AS chunk_index) FROM c WHERE doc <> '' OR quality <> '' OR chunk_index IS NOT NULL OR chunk_excerpt <> '' OR modality <> ''""",
)
def clean_provenance(spark, d):
    """The cleaned records; -1 stands for a missing index here."""
    r = raw(spark, d).select("edge_id", F.posexplode("records").alias("pos", "r")).select("edge_id", F.col("pos").cast("long").alias("pos"), "r.*")
    return review.clean_provenance(r, "edge_id", "pos").withColumn("chunk_index", F.coalesce("chunk_index", F.lit(-1)))


# --- filters and alignments ----------------------------------------------------------------------------
@query("nonblank_paragraphs", f"WITH {_PARA} SELECT para_id FROM pm WHERE trim(coalesce(paragraph, '')) <> ''")
def nonblank_paragraphs(spark, d):
    return review.nonblank(paragraphs(spark, d), "paragraph", required=True).select("para_id")


@query("qualifying_decisions", f"WITH {_NOVEL} SELECT result_id, decision FROM nk WHERE decision IN ('PARTIALLY_NEW', 'NEW')")
def qualifying_decisions(spark, d):
    """Results whose decision qualifies for extraction."""
    return catalog.novelty_coercion(spark, d).filter(F.col("decision").isin("PARTIALLY_NEW", "NEW")).select("result_id", "decision")


_LABEL = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(replace(trim({c}), '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g'))"
_DISPLAY = lambda c: f"upper(substr({_LABEL(c)}, 1, 1)) || substr({_LABEL(c)}, 2)"


@query("predicate_labels", f"SELECT predicate, {_DISPLAY('predicate')} AS label FROM (SELECT DISTINCT predicate FROM seed_triples UNION SELECT DISTINCT predicate FROM provenance_edges) WHERE predicate IS NOT NULL")
def predicate_labels(spark, d):
    """Every typed predicate as it is shown."""
    p = table(spark, d, "seed_triples").select("predicate").unionByName(table(spark, d, "provenance_edges").select("predicate")).filter("predicate is not null").distinct()
    return p.select("predicate", text.display_label(F.col("predicate")).alias("label"))


@query("triplet_filter", f"SELECT triple_id FROM seed_triples WHERE contains(lower(coalesce(subject, '')), 'audit') OR contains(lower(coalesce(predicate, '')), 'audit') OR contains(lower(coalesce({_DISPLAY('predicate')}, '')), 'audit') OR contains(lower(coalesce(object, '')), 'audit')")
def triplet_filter(spark, d):
    """Triples that say audit in a name, the predicate or its label."""
    t = table(spark, d, "seed_triples").withColumn("label", text.display_label(F.col("predicate")))
    return review.containing(t, "audit", "subject", "predicate", "label", "object").select("triple_id")


@query("include_default", f"WITH {_TRIPLES} SELECT tp.triple_id, v.l IS NOT NULL AS included FROM tp LEFT JOIN (SELECT DISTINCT lower(canonical) AS l FROM predicate_vocab) v ON v.l = lower(predicate)")
def include_default(spark, d):
    """Which triples are chosen at first: those of a standard predicate."""
    return catalog.triplet_coercion(spark, d).select("triple_id", (~F.col("non_standard")).alias("included"))


@query("quality_context", "WITH nv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST) AS nth FROM novelty_results) WHERE nth = 1), f AS (SELECT trim(quality) AS t, arg_min(result_id, result_id) AS result_id FROM nv WHERE trim(quality) <> '' GROUP BY 1) SELECT vec_id, coalesce(f.result_id, -1) AS result_id, n.doc AS doc FROM kept_qualities k LEFT JOIN f ON f.t = trim(k.quality) LEFT JOIN nv n ON n.result_id = f.result_id")
def quality_context(spark, d):
    """Each kept quality with the first result on the same text, -1 where there is none."""
    q = table(spark, d, "kept_qualities").select("vec_id", "quality")
    n = novelty(spark, d).select("result_id", "doc", F.col("quality").alias("t"))
    return review.first_context(q, "quality", n, "t", "result_id", "doc").join(review.first_context(q, "quality", n.withColumn("first_id", F.col("result_id")), "t", "result_id", "first_id").select("vec_id", F.col("first_id").alias("result_id")), "vec_id").select("vec_id", F.coalesce("result_id", F.lit(-1)).alias("result_id"), "doc")


@query("position_relevance", f"WITH {_RELEVANCE}, pp AS (SELECT doc_id, para_index, row_number() OVER (PARTITION BY doc_id ORDER BY para_index) - 1 AS pos FROM rl WHERE literal OR max_score >= 0.6) SELECT doc_id, pos, max_score, literal FROM pp JOIN rl USING (doc_id, para_index)")
def position_relevance(spark, d):
    """The relevance of what was handed on, by its place among the paragraphs of its document that were."""
    r = catalog.paragraph_relevance(spark, d)
    place = r.filter("literal or max_score >= 0.6").selectExpr("doc_id", "para_index", "row_number() over (partition by doc_id order by para_index) - 1 as pos")
    return place.join(r, ["doc_id", "para_index"]).select("doc_id", "pos", "max_score", "literal")


@query("paragraph_dimensions", f"WITH {_PARA} SELECT doc_id, para_index, string_agg(DISTINCT k, '|' ORDER BY k) AS dimensions FROM (SELECT doc_id, para_index, unnest(keywords) AS k FROM pm) WHERE k IS NOT NULL GROUP BY ALL")
def paragraph_dimensions(spark, d):
    """The keywords that a paragraph was found by."""
    k = paragraphs(spark, d).select("doc_id", "para_index", F.explode("keywords").alias("k")).filter("k is not null").distinct()
    return k.groupBy("doc_id", "para_index").agg(F.array_join(F.array_sort(F.collect_list("k")), "|").alias("dimensions"))


@query("quality_dimensions", f"WITH {_PARA}, dm AS (SELECT DISTINCT doc_name AS doc, t FROM (SELECT doc_name, unnest(matched_terms) AS t FROM pm JOIN documents USING (doc_id)) WHERE t IS NOT NULL), q AS (SELECT DISTINCT trim(quality) AS quality, doc FROM kept_qualities WHERE trim(quality) <> '') SELECT quality, coalesce(string_agg(DISTINCT t, '|' ORDER BY t), '') AS dimensions FROM q LEFT JOIN dm USING (doc) GROUP BY quality")
def quality_dimensions(spark, d):
    """The terms by which the documents of a quality were found, over all its documents."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_name").alias("doc"))
    terms = paragraphs(spark, d).select("doc_id", F.explode("matched_terms").alias("t")).filter("t is not null").distinct().join(docs, "doc_id").select("doc", "t").distinct()
    q = table(spark, d, "kept_qualities").select(text.text_or_null(F.col("quality")).alias("quality"), "doc").filter("quality is not null").distinct()
    both = q.join(terms, "doc", "left").select("quality", "t").distinct()
    return both.groupBy("quality").agg(F.array_join(F.array_sort(F.collect_list("t")), "|").alias("dimensions"))


@query("selected_extractions", f"WITH {_NOVEL}, {_TRIPLES} SELECT nk.result_id, tp.subject, tp.predicate, tp.object FROM nk JOIN tp ON tp.triple_id = nk.result_id WHERE nk.decision = 'NEW'")
def selected_extractions(spark, d):
    """The triples of the results chosen as new, by id."""
    chosen = catalog.novelty_coercion(spark, d).filter("decision = 'NEW'").select("result_id")
    t = catalog.triplet_coercion(spark, d).select(F.col("triple_id").alias("result_id"), "subject", "predicate", "object")
    return chosen.join(t, "result_id")


@query("conflict_verdicts", f"SELECT conflict_id, CASE WHEN type <> 'MODALITY_CONFLICT' THEN 'UNJUDGED' WHEN (side_a = 'PROHIBITED' AND side_b IN ('MANDATORY', 'OPTIONAL')) OR (side_b = 'PROHIBITED' AND side_a IN ('MANDATORY', 'OPTIONAL')) THEN 'CONTRADICT' WHEN side_a IN {_IN(review.MODALITIES)} AND side_b IN {_IN(review.MODALITIES)} THEN 'TENSION' ELSE 'UNJUDGED' END AS verdict FROM ({_ALL_CONFLICTS})")
def conflict_verdicts(spark, d):
    return review.verdicts(catalog._scan(spark, edges(spark, d), catalog.canon(spark, d)))


@query("aligned_answers", "SELECT k.vec_id, a.sentence, CASE WHEN a.q IS NULL THEN 'Missing in the answer.' END AS reason FROM kept_qualities k LEFT JOIN (SELECT quality_vec_id AS q, sentence FROM (SELECT *, row_number() OVER (PARTITION BY quality_vec_id ORDER BY neighbor_rank NULLS FIRST, sentence NULLS FIRST) AS n FROM neighbor_views WHERE quality_vec_id IS NOT NULL) WHERE n = 1) a ON a.q = k.vec_id")
def aligned_answers(spark, d):
    """The first answer to each quality by id, or that it is missing."""
    return review.align(table(spark, d, "kept_qualities"), "vec_id", table(spark, d, "neighbor_views"), "quality_vec_id", "neighbor_rank", "sentence")


@query("common_documents", "SELECT doc, a, b FROM (SELECT doc, count(*) AS a FROM novelty_results GROUP BY doc) JOIN (SELECT doc, count(*) AS b FROM kept_qualities GROUP BY doc) USING (doc)")
def common_documents(spark, d):
    """Documents that both systems have, with the rows of each."""
    a, b = (table(spark, d, t).groupBy("doc").agg(F.count("*").alias(c)) for t, c in (("novelty_results", "a"), ("kept_qualities", "b")))
    return a.join(b, "doc")


@query("review_distinct", f"WITH nv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST) AS nth FROM novelty_results) WHERE nth = 1), x AS (SELECT result_id, upper({_CLEAN('decision')}) AS decision, {_CLEAN('quality')} AS quality, coalesce(doc, '') AS doc, lower({_CLEAN('matched_neighbor_sentence')}) AS near FROM nv) SELECT result_id, decision, quality FROM (SELECT *, row_number() OVER (PARTITION BY decision, lower(quality), doc, near ORDER BY result_id) AS k FROM x WHERE decision IN {_IN(text.DECISIONS)} AND quality <> '') WHERE k = 1")
def review_distinct(spark, d):
    return review.distinct_reviews(novelty(spark, d))


@query("batch_guard", "WITH nv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST) AS nth FROM novelty_results) WHERE nth = 1) SELECT model, count(*) AS n, count(*) FILTER (WHERE rationale IS NULL) AS failed, count(*) FILTER (WHERE rationale IS NULL) = count(*) AS all_failed FROM nv GROUP BY model")
def batch_guard(spark, d):
    """For each model whether all its answers failed (no rationale at all)."""
    return novelty(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("rationale").isNull()).alias("failed")).withColumn("all_failed", F.col("failed") == F.col("n"))


@query("predicate_options", "SELECT row_number() OVER (ORDER BY f, i) AS nth, predicate FROM (SELECT list_position(['normative', 'taxonomy'], lower(family)) AS f, pred_id AS i, canonical AS predicate FROM predicate_vocab WHERE lower(family) IN ('normative', 'taxonomy') UNION ALL VALUES (3, 0, 'IsAuditedBy'), (3, 1, 'Covers')) WHERE lower(predicate) NOT IN ('recommends', 'isequivalentto')")
def predicate_options(spark, d):
    """Normative and taxonomy predicates and two of one's own, without two excluded ones."""
    return review.predicate_options(table(spark, d, "predicate_vocab"), ["normative", "taxonomy"], ["IsAuditedBy", " Covers ", "Requires"], ["RECOMMENDS", "IsEquivalentTo"])


# --- graph ----------------------------------------------------------------------------------------------
@query("display_edges", f"WITH {_EDGES}, o AS (SELECT source, predicate, target, min(edge_id) AS edge_id FROM e GROUP BY ALL) SELECT row_number() OVER (ORDER BY edge_id) - 1 AS nth, substr(sha1(source), 1, 12) AS source_id, substr(sha1(target), 1, 12) AS target_id, replace(predicate, '_', ' ') AS label FROM o")
def display_edges(spark, d):
    return store.numbered_edges(edges(spark, d))


_ONE_KEYWORD = lambda k, n: catalog.SQL["keyword_subgraph"].split(" SELECT edge_id, source, predicate, target, pattern FROM", 1)[0] if n is None else f"SELECT edge_id, source, predicate, target, {n} AS nth_keyword FROM ({catalog.SQL['keyword_subgraph'].replace(catalog.KEYWORD, k)})"


@query("combined_subgraph", f"SELECT edge_id, source, predicate, target, nth_keyword FROM (SELECT *, row_number() OVER (PARTITION BY source, predicate, target ORDER BY nth_keyword, edge_id) AS k FROM ({_ONE_KEYWORD('drift', 0)} UNION ALL {_ONE_KEYWORD('audit', 1)} UNION ALL {_ONE_KEYWORD('risk', 2)})) WHERE k = 1")
def combined_subgraph(spark, d):
    """The subgraphs of three keywords."""
    return store.combined_subgraph(edges(spark, d), ["drift", "audit", "risk"])


_NODE = lambda c: _NORM(f"replace({c}, '_', ' ')")
_NODE_RELATIONS = f"""on1 AS (SELECT source, predicate, target, min(edge_id) AS edge_id FROM e GROUP BY ALL), en AS (SELECT *, {_NODE('source')} AS node FROM on1 UNION ALL SELECT *, {_NODE('target')} FROM on1 WHERE target <> source),
nr AS (SELECT node, source, predicate, target, row_number() OVER (PARTITION BY node ORDER BY edge_id, source, predicate, target) AS nth FROM (SELECT node, source, predicate, target, min(edge_id) AS edge_id FROM en WHERE node <> '' GROUP BY ALL))"""


@query("node_relations", f"WITH {_EDGES}, {_NODE_RELATIONS} SELECT node, nth, source, predicate, target FROM nr WHERE nth <= 5")
def node_relations(spark, d):
    """The first five relations of each node."""
    return node_entity.node_relations(edges(spark, d), 5).select("node", "nth", *provenance.TRIPLE)


@query("relation_duplicate_members", f"WITH t AS (SELECT triple_id, {_NORM('subject')} AS s, coalesce({_REL('predicate')}, lower(trim(predicate))) AS rel, {_NORM('object')} AS t, trim(predicate) AS predicate, sentence FROM seed_triples WHERE {_WHOLE}) SELECT * FROM t WHERE (s, rel, t) IN (SELECT (s, rel, t) FROM t GROUP BY s, rel, t HAVING count(*) > 1)")
def relation_duplicate_members(spark, d):
    """The triples of each group of relation_duplicates with their sentences."""
    return preview.duplicate_members(table(spark, d, "seed_triples"))


_FLAG = {
    "S2": f"SELECT coalesce(source, '') || ' -> ' || coalesce(target, '') AS label, 'empty or placeholder endpoint' AS reason FROM raw WHERE {catalog._PLACE('source')} OR {catalog._PLACE('target')}",
    "S3": "SELECT s || ' -> ' || t AS label, predicates AS reason FROM (" + catalog._PAIRS + catalog._BAD + ")",
    "S5": "SELECT source || ' -> ' || target AS label, predicate || ' x ' || count(*) AS reason FROM e GROUP BY source, predicate, target HAVING count(*) > 1",
}


@query("verify_flagged", f"WITH {_EDGES} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS \"check\", label, reason, (SELECT count(*) FROM ({v})) AS flagged_total FROM ({v}) ORDER BY label, reason LIMIT 50)" for k, v in _FLAG.items()))
def verify_flagged(spark, d):
    """The first fifty findings of the checks of single edges, pairs and duplicates, with their full number."""
    r, e = raw(spark, d), edges(spark, d)
    at = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.lit(" -> "), F.coalesce(b, F.lit("")))
    s2 = r.filter(text.is_placeholder(F.col("source")) | text.is_placeholder(F.col("target"))).select(at("source", "target").alias("label"), F.lit("empty or placeholder endpoint").alias("reason"))
    s3 = verify.contradictions(e).select(at("s", "t").alias("label"), F.col("predicates").alias("reason"))
    s5 = e.groupBy(*provenance.TRIPLE).agg(F.count("*").alias("n")).filter("n > 1").select(at("source", "target").alias("label"), F.concat("predicate", F.lit(" x "), F.col("n").cast("string")).alias("reason"))
    return review.flagged([("S2", s2), ("S3", s3), ("S5", s5)])


@query("verify_checks", f"WITH {_EDGES}, c AS ({catalog._S1} UNION ALL {catalog._S2} UNION ALL {catalog._S3} UNION ALL {catalog._S4} UNION ALL {catalog._S5}) SELECT \"check\", bad, total, score, passed, CAST(NULL AS VARCHAR) AS error FROM c")
def verify_checks(spark, d):
    """The five checks, each on its own: one that fails with an error doesn't end the others."""
    return review.guarded({k: lambda f=getattr(catalog, f"verify_{k.lower()}"): f(spark, d) for k in verify.THRESHOLDS})


# --- grounding ------------------------------------------------------------------------------------------
#: The vocabulary of the tables has one predicate that gives a type.
TYPING = ("IsInstanceOf",)


def schema(spark, d):
    return grounding.from_edges(edges(spark, d), table(spark, d, "predicate_vocab"))


def scanned(spark, d):
    return schema(spark, d).orderBy("edge_id").limit(grounding.SCAN)


_SCHEMA = f"ss AS (SELECT edge_id, source AS subject, canonical AS predicate, target AS object, source || ' ' || replace(predicate, '_', ' ') || ' ' || target AS raw FROM e JOIN (SELECT DISTINCT rel_type, canonical FROM predicate_vocab) v ON v.rel_type = predicate ORDER BY edge_id LIMIT {grounding.SCAN})"


@query("schema_edges", f"WITH {_EDGES}, {_SCHEMA} SELECT * FROM ss")
def schema_edges(spark, d):
    """The schema that the stored edges state; the cap is the feature."""
    return scanned(spark, d)


@query("schema_examples", f"WITH {_EDGES}, {_SCHEMA} SELECT predicate, nth, raw FROM (SELECT predicate, row_number() OVER (PARTITION BY predicate ORDER BY edge_id) AS nth, raw FROM ss) WHERE nth <= 12")
def schema_examples(spark, d):
    return grounding.examples(scanned(spark, d))


_ROLE_OF = "CASE predicate " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in grounding.ROLES.items()) + " END"


@query(
    "schema_templates",
    f"""WITH RECURSIVE {_EDGES}, {_SCHEMA}, up AS (SELECT DISTINCT subject AS name, object AS parent FROM ss WHERE predicate = 'IsSubclassOf' AND subject <> object), cl AS (SELECT subject AS name, object AS type FROM ss WHERE predicate = 'IsInstanceOf' UNION SELECT up.name, cl.type FROM cl JOIN up ON up.parent = cl.name),
ro AS (SELECT name, string_agg(type, '/' ORDER BY type) AS role FROM (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY type) AS k FROM cl) WHERE k <= 3 GROUP BY name),
f AS (SELECT ss.predicate, ss.edge_id, coalesce(a.role, 'Concept') || ' --' || ss.predicate || '--> ' || coalesce(b.role, CASE WHEN ss.predicate IN ('IsInstanceOf', 'IsSubclassOf') THEN ss.object END, {_ROLE_OF.replace('CASE predicate', 'CASE ss.predicate')}, 'Concept') AS template FROM ss LEFT JOIN ro a ON a.name = ss.subject LEFT JOIN ro b ON b.name = ss.object)
SELECT predicate, nth, template, n FROM (SELECT predicate, template, n, row_number() OVER (PARTITION BY predicate ORDER BY n DESC, first) AS nth FROM (SELECT predicate, template, count(*) AS n, min(edge_id) AS first FROM f GROUP BY ALL)) WHERE nth <= 8""",
)
def schema_templates(spark, d):
    s = scanned(spark, d)
    return grounding.templates(s, grounding.node_types(s, TYPING), TYPING)


_KEYS = lambda c: f"array_to_string(regexp_extract_all(lower(replace({c}, '_', ' ')), '[a-z0-9+#.-]+'), ' ')"
_HINTS = "VALUES " + ", ".join(f"('{w}', '{p}')" for w, ps in grounding.HINTS.items() for p in ps)


@query("predicate_hints", f"SELECT vec_id, coalesce(string_agg(DISTINCT p, '|' ORDER BY p), '') AS hints FROM (SELECT vec_id, {_KEYS('coalesce(quality, chr(32))')} AS k FROM kept_qualities) q LEFT JOIN ({_HINTS}) h(w, p) ON contains(q.k, h.w) GROUP BY vec_id")
def predicate_hints(spark, d):
    """What the words of each quality hint at."""
    return table(spark, d, "kept_qualities").select("vec_id", F.array_join(F.array_sort(grounding.predicate_hints(F.col("quality"))), "|").alias("hints"))


@query("schema_matches")
def schema_matches(spark, d):
    """The best schema nodes of every kept quality, and the confidence that they give; tested against brute force."""
    q = table(spark, d, "kept_qualities").filter("quality is not null").select("vec_id", "quality")
    return grounding.match_nodes(q, "vec_id", "quality", schema(spark, d))


@query("grounding_confidence")
def grounding_confidence(spark, d):
    """How well each kept quality is grounded."""
    s = Scratch(spark).write(schema(spark, d))
    classes = grounding.node_types(s, TYPING).select(F.col("type").alias("name")).union(spark.createDataFrame([(r,) for r in sorted({*grounding.ROLES.values()})], "name string"))
    q = table(spark, d, "kept_qualities").select("vec_id", "quality")
    best = grounding.match_nodes(q.filter("quality is not null"), "vec_id", "quality", s).filter("nth = 1").select("vec_id", "score")
    said = grounding.classes_in(q.join(best, "vec_id", "left"), "quality", classes)
    return said.select("vec_id", F.round(grounding.confidence(F.col("score"), F.col("classes"), grounding.predicate_hints(F.col("quality"))), 3).alias("confidence"))


def _statuses(spark, d):
    s = scanned(spark, d)
    v = table(spark, d, "predicate_vocab")
    allowed = [r[0] for r in v.select("canonical").distinct().collect()]
    templated = [r[0] for r in s.select("predicate").distinct().collect()]
    classes = grounding.node_types(s, TYPING).select(F.col("type").alias("name")).distinct()
    t = table(spark, d, "seed_triples").select("triple_id", *(text.strip(F.col(c)).alias(c) for c in ("subject", "predicate", "object")), "sentence").filter("subject <> '' and predicate <> '' and object <> ''")
    return grounding.triple_status(t, allowed, templated, classes, store.nodes(s.select(F.col("subject").alias("source"), F.col("object").alias("target"))), sorted(phrases.stop_words()))


@query("schema_status")
def schema_status(spark, d):
    """How each complete seed triple fits the schema; tested on the cases of the ladder."""
    return _statuses(spark, d).select("triple_id", "schema_status")


@query("schema_sentence_status")
def schema_sentence_status(spark, d):
    return grounding.sentence_status(_statuses(spark, d).filter("sentence is not null"), "sentence")


# --- similarity by entities and texts -----------------------------------------------------------------------
def _stated(spark, d):
    """The stated query set: the kept qualities whose id is divisible by 100."""
    return table(spark, d, "kept_qualities").filter("vec_id % 100 = 0").select("vec_id", "quality")


@query("node_entity_neighbours")
def node_entity_neighbours(spark, d):
    """The relations nearest to the entities of the stated qualities; tested against brute force."""
    return node_entity.neighbours(_stated(spark, d), "vec_id", "quality", edges(spark, d))[1]


@query("node_entity_decisions")
def node_entity_decisions(spark, d):
    return node_entity.neighbours(_stated(spark, d), "vec_id", "quality", edges(spark, d))[0].orderBy(F.desc("max_score"), "vec_id")


_WORDS = "upper(substr(w, 1, 1)) || substr(w, 2)"


@query(
    "sentence_neighbours",
    f"""WITH {_EDGES}, rs AS (SELECT DISTINCT {_WORDS} AS s FROM (SELECT replace(source || ' ' || predicate || ' ' || target, '_', ' ') AS w FROM e)), qs AS (SELECT vec_id, quality FROM kept_qualities WHERE vec_id % 100 = 0), {encoded_sql("rs", "s", "s")}, {encoded_sql("qs", "vec_id", "quality", "q")},
c AS (SELECT q.k AS vec_id, r.k AS sentence, sum(q.w * r.w) AS dot FROM qgv q JOIN gv r ON q.b = r.b GROUP BY ALL), z AS (SELECT vec_id, sentence, round(dot / (a.n * b.n), 6) AS cos FROM c JOIN qgn a ON a.k = vec_id JOIN gn b ON b.k = sentence)
SELECT vec_id, nth, sentence, cos AS score, max(cos) OVER (PARTITION BY vec_id) >= 0.55 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, sentence) AS nth FROM z) WHERE nth <= 5""",
)
def sentence_neighbours(spark, d):
    """The five stored triples in words that are nearest to each stated quality; kept says whether the best reaches 0.55."""
    from pyspark.sql import Window

    rows = catalog.relation_texts(spark, d).select("text").distinct().select(F.concat(F.lit("r:"), "text").alias("k"), encoder.encode(F.col("text")).alias("v"))
    q = _stated(spark, d).filter("quality is not null").select(F.concat(F.lit("q:"), F.col("vec_id").cast("string")).alias("k"), encoder.encode(F.col("quality")).alias("v"))
    top = retrieval.top_k(q, rows, "k", "v", 5)
    best = F.max("cos").over(Window.partitionBy("query_id"))
    return top.select(F.substring("query_id", 3, 99).cast("long").alias("vec_id"), "nth", F.substring("row_id", 3, 2**31 - 1).alias("sentence"), F.col("cos").alias("score"), (best >= 0.55).alias("kept"))


_WORDS_ASKED = " ".join(catalog.BM25_WORDS)


@query(
    "hybrid_search",
    f"""WITH dq AS (SELECT 0 AS id, '{_WORDS_ASKED}' AS t), dt AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {encoded_sql("dq", "id", "t", "q")}, {encoded_sql("dt", "doc_id", "text")},
dn AS (SELECT doc_id, row_number() OVER (ORDER BY cos DESC, doc_id) AS nth FROM (SELECT r.k AS doc_id, round(sum(q.w * r.w) / (any_value(a.n) * any_value(b.n)), 6) AS cos FROM qgv q JOIN gv r ON q.b = r.b JOIN qgn a ON a.k = q.k JOIN gn b ON b.k = r.k GROUP BY r.k) ORDER BY cos DESC, doc_id LIMIT 10),
bm AS ({catalog._bm25_sql(catalog.BM25_WORDS)})
SELECT coalesce(bm.doc_id, dn.doc_id) AS doc_id, round(coalesce(0.5 / (60 + bm.nth), 0.0) + coalesce(0.5 / (60 + dn.nth), 0.0), 9) AS score FROM bm FULL JOIN dn ON bm.doc_id = dn.doc_id""",
)
def hybrid_search(spark, d):
    """The word ranking and the vector ranking of all documents for one question, fused by their ranks."""
    docs = table(spark, d, "documents")
    q = spark.createDataFrame([(-1, _WORDS_ASKED)], "doc_id long, text string")
    coded = lambda df: df.filter("text is not null").select("doc_id", encoder.encode(F.col("text")).alias("v"))
    dense = retrieval.top_k(coded(q), coded(docs), "doc_id", "v", 10).select(F.col("row_id").alias("doc_id"), "nth")
    return retrieval.fuse(retrieval.bm25(docs, "doc_id", "text", [*catalog.BM25_WORDS], 10), dense, "doc_id")


@query("dense_mmr")
def dense_mmr(spark, d):
    """Four of the ten nearest vectors of each query, near to it and far from each other; tested against brute force."""
    return review.mmr(catalog.topk_neighbours(spark, d), table(spark, d, "embeddings"), "vec_id", "embedding")


@query("keyphrases")
def keyphrases(spark, d):
    """The five keyphrases of every paragraph."""
    return paragraphs(spark, d).select("para_id", F.posexplode(phrases.keyphrase_lists(F.col("paragraph"))).alias("nth", "p")).select("para_id", "nth", "p.phrase", "p.score")


@query("keyword_cascade")
def keyword_cascade(spark, d):
    """How every paragraph matches a keyword, with synonyms by its ending; tested on the steps."""
    word = "traceability"
    p = phrases.keyword_cascade(paragraphs(spark, d).select("para_id", "paragraph"), "paragraph", word, phrases.synonyms(word, {}, {}))
    return p.select("para_id", "match_type", F.array_join("matched_terms", "|").alias("matched_terms"), "score")


@query("entity_tokens", f"WITH {_EDGES} SELECT name, array_to_string(regexp_extract_all(name, '[A-Za-z][A-Za-z0-9_+#.-]*'), '|') AS words FROM (SELECT source AS name FROM e UNION SELECT target FROM e)")
def entity_tokens(spark, d):
    """The words of every node name of which entities are made."""
    return catalog.node_names(spark, d).select("name", F.array_join(F.regexp_extract_all("name", F.lit(f"({phrases.ENTITY_WORD})"), F.lit(1)), "|").alias("words"))


@query("entity_candidates")
def entity_candidates(spark, d):
    """Node names that may be one; tested against brute force."""
    return quality.entity_candidates(catalog.node_names(spark, d))


@query("entity_duplicates")
def entity_duplicates(spark, d):
    return quality.entity_duplicates(catalog.node_names(spark, d))


@query("quality_summary")
def quality_summary(spark, d):
    return quality.quality_summary(table(spark, d, "seed_triples"), sorted(phrases.stop_words()))


# --- rules in place of a model -------------------------------------------------------------------------------
_MODAL = lambda c: f"CASE WHEN regexp_matches({c}, '\\b(?:shall|must|may)\\s+not\\b|\\bcannot\\b|\\bcan\\s+not\\b') THEN 'PROHIBITED' WHEN regexp_matches({c}, '\\b(?:shall|must)\\b') THEN 'MANDATORY' WHEN regexp_matches({c}, '\\bshould\\b') THEN 'RECOMMENDED' WHEN regexp_matches({c}, '\\b(?:may|can)\\b') THEN 'OPTIONAL' ELSE 'NONE' END"


@query("wording_modality", f"WITH {_PARA} SELECT para_id, {_MODAL(chr(108) + 'ower(coalesce(paragraph, chr(32)))')} AS modality FROM pm")
def wording_modality(spark, d):
    """The strongest obligation in the wording of every paragraph."""
    return paragraphs(spark, d).select("para_id", text.wording_modality(F.col("paragraph")).alias("modality"))


@query("novelty_bands", "WITH nv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST) AS nth FROM novelty_results) WHERE nth = 1) SELECT result_id, CASE WHEN max_score >= 0.9 THEN 'EXISTING' WHEN max_score >= 0.6 THEN 'PARTIALLY_NEW' ELSE 'NEW' END AS decision FROM nv")
def novelty_bands(spark, d):
    """What the best score alone says of every result."""
    return novelty(spark, d).select("result_id", review.novelty_band(F.col("max_score")).alias("decision"))


_DECOMPOSED = f"{_PARA}, dq AS (SELECT doc_id, para_index, para_id, {_SPACED('p')} AS quality FROM (SELECT doc_id, para_index, para_id, unnest(string_split(regexp_replace(paragraph, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(31), 'g'), chr(31))) AS p FROM pm WHERE paragraph IS NOT NULL) WHERE {_SPACED('p')} <> '')"


@query("decomposed_qualities", f"WITH {_DECOMPOSED} SELECT para_id, quality FROM dq")
def decomposed_qualities(spark, d):
    """The sentences of every paragraph by the rule that stands in for a model."""
    return paragraphs(spark, d).select("para_id", F.explode(review.decompose(F.col("paragraph"))).alias("quality"))


@query("extend_extraction", f"WITH {_DECOMPOSED}, {_RELEVANCE.replace(_PARA + ', ', '', 1)}, nw AS (SELECT doc_id, para_index FROM rl WHERE NOT literal AND max_score >= 0.4 AND NOT EXISTS (SELECT 1 FROM rl k WHERE k.max_score >= 0.6 AND k.doc_id = rl.doc_id AND k.para_index = rl.para_index)) SELECT doc_id, para_index, quality FROM (SELECT doc_id, para_index, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id, para_index) AS k FROM (SELECT DISTINCT doc_id, para_index, quality FROM dq SEMI JOIN nw USING (doc_id, para_index))) WHERE k = 1 AND quality NOT IN (SELECT {_SPACED('quality')} FROM kept_qualities WHERE quality IS NOT NULL)")
def extend_extraction(spark, d):
    """What a threshold lowered from 0.6 to 0.4 adds to the qualities that are known."""
    p = paragraphs(spark, d)
    r = ingest.paragraph_relevance(p)
    return review.extend(r, r.filter("max_score >= 0.6"), 0.4, p, table(spark, d, "kept_qualities"))


# --- forms of rows ---------------------------------------------------------------------------------------------
@query("graph_relations", f"WITH {_RECORDS} SELECT edge_id, pos - 1 AS pos, source AS source_label, predicate AS edge_label, target AS target_label, coalesce(text, source || ' ' || predicate || ' ' || target) AS sentence FROM r")
def graph_relations(spark, d):
    """The flat rows of the store as nested relations, shown by their fields."""
    return store.nested(records(spark, d)).select("edge_id", F.col("pos").cast("long").alias("pos"), F.col("source.label").alias("source_label"), F.col("edge.label").alias("edge_label"), F.col("target.label").alias("target_label"), F.col("edge.properties.sentence").alias("sentence"))


@query("json_relations", f"WITH {_EDGES} SELECT edge_id, json_object('source', source, 'predicate', predicate, 'target', target) AS doc FROM e")
def json_relations(spark, d):
    """The stored triples as JSON objects."""
    return edges(spark, d).select("edge_id", F.to_json(F.struct(*provenance.TRIPLE)).alias("doc"))


@query("date_texts", "SELECT DISTINCT created_at, strftime(created_at, '%Y%m%d_%H%M%SZ') AS compact, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(created_at, '%b %d, %Y, %H:%M UTC') AS human FROM kept_qualities WHERE created_at IS NOT NULL")
def date_texts(spark, d):
    """Times as they stand in file names, logs and reports."""
    at = F.col("created_at")
    return table(spark, d, "kept_qualities").filter("created_at is not null").select(at, *(F.date_format(at, f).alias(n) for n, f in text.DATES.items())).distinct()


@query("keyword_list", "SELECT DISTINCT trim(k) AS keyword FROM (SELECT unnest(keywords) AS k FROM paragraph_matches) WHERE trim(k) <> ''")
def keyword_list(spark, d):
    """The keywords that are not blank, trimmed."""
    return table(spark, d, "paragraph_matches").select(F.explode("keywords").alias("k")).select(text.text_or_null(F.col("k")).alias("keyword")).filter("keyword is not null").distinct()


@query("document_chunks")
def document_chunks(spark, d):
    """Every document in overlapping chunks of at most 700 characters; tested by their properties."""
    return ingest.chunks(table(spark, d, "documents"))


@query("statement_triples")
def statement_triples(spark, d):
    """The triples that lines of the documents state; tested on the grammar."""
    from graphloom.sources import readers

    return readers.parse_statements(ingest.lines(table(spark, d, "documents")))
