from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import components, conflicts, ingest, provenance, retrieval, store
from graphloom.session import unique_join
from graphloom.sources import readers
from graphloom.streaming.increments import GraphTable, upsert_stream

EDGE = "edge_id long, source string, predicate string, target string, docs array<string>, records array<struct<doc string, quality string, chunk_index int, chunk_excerpt string, modality string>>, knowledge_type string, created_at timestamp_ntz, ingested_at timestamp_ntz"
NOW = datetime(2025, 1, 1)


def rec(doc, modality=None, quality="q"):
    return (doc, quality, 1, None, modality)


def frame(spark, rows):
    return provenance.edges(spark.createDataFrame([(i, s, p, t, [r[0] for r in rs if r[0]], rs, None, NOW, NOW) for i, (s, p, t, rs) in enumerate(rows)], EDGE))


def test_overlap_and_coverage(spark):
    e = frame(spark, [("pump", "feeds", "tank", [rec("m1", "OPTIONAL"), rec("m2")]), ("valve", "requires", "seal", [rec("m1", "MANDATORY"), rec("m1", "MANDATORY")]), ("pump", "needs", "valve", [rec("m2", "optional"), rec("m3", "PROHIBITED"), rec(None)]), ("seal", "  ", "pump", [rec("m3")])])
    r = provenance.records(e)
    cover = {x.doc: (x.assertions, x.concepts, x.normative) for x in provenance.document_coverage(r).collect()}
    assert cover == {"m1": (2, 4, 2), "m2": (2, 3, 1), "m3": (1, 2, 1)}
    got = {(x.source, x.target): (x.n_docs, x.verdict, x.modalities) for x in provenance.overlap_relations(e, r).collect()}
    assert got == {("pump", "tank"): (2, "AGREEMENT", "OPTIONAL"), ("pump", "valve"): (2, "TENSION", "OPTIONAL|PROHIBITED")}


def test_conflicts(spark):
    e = frame(spark, [("s", "requires", "t", [rec("a", "MANDATORY"), rec("b", "OPTIONAL")]), ("c", "defines", "one", [rec("a")]), ("c", "defines", "two", [rec("b")]), ("x", "is_a", "y", [rec("a")]), ("y", "is_a", "x", [rec("b")]), ("v", "has_threshold", "1", [rec("a")]), ("v", "has_threshold", "2", [rec("b")])])
    r = provenance.records(e)
    every = conflicts.modality(r).unionByName(conflicts.definition(r)).unionByName(conflicts.taxonomy(e, r, ("is_a",))).unionByName(conflicts.value(r))
    kinds = {x.type: x.conflict_id for x in every.collect()}
    assert set(kinds) == {"MODALITY_CONFLICT", "DEFINITION_DIVERGENCE", "TAXONOMY_CONFLICT", "VALUE_CONFLICT"}
    left = conflicts.excluding(every, every.filter("type = 'VALUE_CONFLICT'"))
    assert left.count() == 3


def test_conflicts_by_canonical_names(spark):
    e = frame(spark, [("s", "requires", "t", [rec("a", "MANDATORY")]), ("S2", "requires", "T2", [rec("b", "OPTIONAL")]), ("s", "defines", "one", [rec("a")]), ("S2", "defines", "two", [rec("b")]), ("s", "is_a", "t", [rec("a")]), ("T2", "is_a", "S2", [rec("b")]), ("s", "has_threshold", "1", [rec("a")]), ("S2", "has_threshold", "2", [rec("b")])])
    r = provenance.records(e)
    aliases = spark.createDataFrame([("S2", "elsewhere"), ("T2", "t")], "name string, canonical string")
    canon = components.overlay(aliases, components.same_as(spark.createDataFrame([("s", "S2")], "a string, b string")))
    assert {tuple(x) for x in canon.collect()} == {("T2", "t"), ("s", "s"), ("S2", "s")}
    each = [conflicts.modality(r, canon), conflicts.modality_pairs(r, canon), conflicts.definition(r, canon=canon), conflicts.taxonomy(e, r, ("is_a",), canon), conflicts.value(r, canon=canon)]
    assert [[(x.concept, x.side_a, x.side_b) for x in df.collect()] for df in each] == [[("s", "MANDATORY", "OPTIONAL")]] * 2 + [[("s", "one", "two")], [("s", "s", "t")], [("s", "1", "2")]]


def test_concepts_by_canonical_names(spark):
    from graphloom.plans import catalog

    d = "/root/testdata/sf0.001"
    same = {x.name: x.canonical for x in catalog.canonical_names(spark, d).collect()}
    aligned = {x.term_a for x in catalog.latest_alignment_decision(spark, d).filter("accept").collect()}
    assert aligned and aligned <= set(same)
    assert not {x.concept for x in catalog.concept_matrix(spark, d).collect()} & {k for k, v in same.items() if k != v}


def test_representatives_of_conflicts(spark):
    e = frame(spark, [("s", "requires", "t", [rec("b", "MANDATORY"), rec("a", "MANDATORY"), rec("a", "OPTIONAL")]), ("s", "requires", "u", [rec("a", "MANDATORY"), rec("a", "OPTIONAL")]), ("c", "defines", "One", [rec("a"), rec("b")]), ("c", "defines", "one", [rec("d")]), ("c", "defines", "two", [rec("c")])])
    r = provenance.records(e)
    assert [(x.concept, x.side_a, x.doc_a, x.side_b, x.doc_b) for x in conflicts.modality_pairs(r).collect()] == [("s", "MANDATORY", "b", "OPTIONAL", "a")]
    assert [(x.side_a, x.doc_a, x.side_b, x.doc_b) for x in conflicts.definition(r).collect()] == [("One", "a", "two", "c")]
    assert sorted(map(tuple, conflicts.definition_members(r).collect())) == [("c", "one", "a"), ("c", "one", "b"), ("c", "one", "d"), ("c", "two", "c")]


def test_decisions_on_conflicts(spark):
    log = spark.createDataFrame([("x", "s", True, 1), ("x", "s", False, 2), ("y", "s", True, 2), ("z", "gone", True, 1), (" ", "s", True, 1), (None, None, None, None)], "conflict_id string, concept string, accepted boolean, decided_at int")
    last = conflicts.recorded(log)
    assert {(r.conflict_id, r.status) for r in last.collect()} == {("x", "dismissed"), ("y", "accepted"), ("z", "accepted")}
    assert [tuple(r) for r in conflicts.involved(last, spark.createDataFrame([("s",)], "name string")).collect()] == [("y", "s")]


def test_types_over_deep_and_cyclic_links(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(2000)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c1", "n1999"), ("x", "x"), (None, "n1"), ("two", "n5"), ("two", "c1")]
    types = spark.createDataFrame([("n2000", "T"), ("c3", "U"), ("two", "V"), (None, "W")], "name string, type string")
    got = components.inherit(types, spark.createDataFrame(links, "name string, parent string"))
    by: dict = {}
    for r in got.collect():
        by.setdefault(r.name, set()).add(r.type)
    assert by["n0"] == {"T"} and by["c2"] == {"T", "U"} and by["two"] == {"T", "U", "V"} and len(by) == 2001 + 3 + 1
    assert components.inherit(types.limit(0), spark.createDataFrame([], "name string, parent string")).count() == 0


def test_predicates(spark):
    rows = spark.createDataFrame([("IsSubclassOf",), ("Shall Not Use!",), ("123",), ("!!!",), (None,)], "p string")
    assert [x[0] for x in rows.select(text.relationship_type(F.col("p"))).collect()] == ["is_subclass_of", "shall_not_use", None, None, None]


def test_clusters(spark):
    links = spark.createDataFrame([("explainability", "explicability"), ("explicability", "xai"), ("a", "a"), (None, "b"), *((f"k{i:03}", f"k{i + 1:03}") for i in range(120))], "a string, b string")
    got = {r.name: r.canonical for r in components.same_as(links).collect()}
    assert got["explainability"] == "xai" and {v for k, v in got.items() if k.startswith("k")} == {"k000"} and "a" not in got
    assert components.same_as(links.limit(0)).count() == 0


def test_upsert_is_idempotent(spark):
    e = frame(spark, [("a", "requires", "b", [rec("d1"), rec("d2")]), ("a", "requires", "b", [rec("d2"), rec("d3")])])
    once = store.upsert(e.limit(0), e)
    twice = store.upsert(once, e)
    assert once.collect() == twice.collect()
    assert [r.doc for r in once.first().records] == ["d1", "d2", "d3"]


def test_latest_decision_and_purge(spark):
    log = spark.createDataFrame([("a", "b", True, 0.9, 1), ("b", "a", False, 0.8, 2), ("a", "a", True, 1.0, 3), (" ", "b", True, 1.0, 3)], "term_a string, term_b string, accept boolean, score double, decided_at int")
    assert [tuple(r) for r in store.latest_decisions(log).collect()] == [("a", "b", False, 0.8, 2)]


def test_hot_keys(spark):
    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("4", 3)], "k string, v int")
    for how, n in (("inner", 1669), ("left", 5000)):
        got = unique_join(left, right, "k", how)
        assert got.count() == n and got.filter("v is not null").count() == 1669


def test_statement_grammar(spark):
    lines = ["# note", "", "Robustness contributes to  Safety", "robustness Contributes To safety", "A is a B which is an X", "nothing here", None, "Tool implements", "is a thing", "Drift is threat to Trust.", "Thesis a topic"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    got = sorted(tuple(r) for r in readers.parse_statements(df, order="n").collect())
    assert got == [("A", "IsA", "B which is an X", "A is a B which is an X"), ("Drift", "IsThreatTo", "Trust.", "Drift is threat to Trust."), ("Robustness", "ContributesTo", "Safety", "Robustness contributes to  Safety")]


def test_synonyms_by_suffix(spark):
    words = ["explainability", "visibility", "fairness", "density", "mitigation", "assessment", "audit", None, "ness"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.synonyms_by_suffix(F.col("w"))).collect()]
    assert got[:7] == [["explainable", "explaination", "explain"], ["visible", "vision", "vis"], ["fair"], ["dens"], ["mitigate"], ["assess"], []] and not got[7] and not got[8]


def test_headings(spark):
    said = ["## 9. References:", "Section 4: Bibliography", "C. Works Cited", "IV References & Notes", "— Reference list —", "Sources", "Preferences", "References used here", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "h string").select(ingest.heading_key(F.col("h")).isin(*ingest.REFERENCE_HEADINGS)).collect()]
    assert got == [True] * 5 + [False] * 4


def test_search_fills_up_places(spark):
    from graphloom.operators import encoder

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id int, v array<float>")
    got = {(r.query_id, r.nth): (r.row_id, r.score) for r in encoder.search(df, df, "id", "v", 2).collect()}
    assert got == {(1, 1): (2, 0.707107), (1, 2): (None, 0.0), (2, 1): (1, 0.707107), (2, 2): (None, 0.0), (3, 1): (None, 0.0), (3, 2): (None, 0.0)}


def test_json_answers():
    assert readers.first_json_object('```json\n{"a": "}"} rest') == '{"a": "}"}'
    assert readers.first_json_object("no") is None and readers.first_json_object(None) is None


def test_reference_cut(spark):
    rows = [(1, i, f"body {i}") for i in range(7)] + [(1, 7, "## 9. References:"), (1, 8, "entry")] + [(2, 0, "References"), *((2, i, "x") for i in range(1, 9))]
    got = ingest.cut_references(spark.createDataFrame(rows, "doc_id int, idx int, paragraph string"))
    assert {r[0]: r[1] for r in got.groupBy("doc_id").count().collect()} == {1: 7, 2: 9}


def test_stream_of_edges(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "requires", "b", ["d"], [rec("d")], None, NOW, NOW), (2, "a", "requires", "b", ["f"], [rec("f")], None, NOW, NOW)], EDGE)
    for i in (1, 2):
        rows.filter(f"edge_id = {i}").write.mode("append").parquet(str(tmp_path / "in"))
    target = GraphTable(spark, str(tmp_path / "graph"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert_stream(stream, target, str(tmp_path / "check")).awaitTermination()
    assert sorted(target.read().first().docs) == ["d", "f"]


def test_best_pairs_of_all(spark):
    x = np.random.default_rng(1).standard_normal((90, 6)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 6), (202, [1.0] * 5), (203, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    x = x.astype(np.float32).astype(float)
    cos = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1))
    half_up = lambda c: np.floor(np.floor(c * 1e6 + 0.5) / 100 + 0.5) / 1e4
    every = sorted((-half_up(cos[a, b]), a, b) for a in range(90) for b in range(a + 1, 90) if cos[a, b] >= 0.35)
    out = {(a, b) for _, a, b in every[:30:2]}
    decided = spark.createDataFrame([(b, a) for a, b in out], "a long, b long")  # in the other order
    want = [(a, b) for _, a, b in every if (a, b) not in out]
    for block in (30, 1000):
        for k in (40, 10**6):
            got = [(r.a, r.b) for r in retrieval.best_pairs(df, "id", "v", 0.35, k, decided, block).collect()]
            assert got == want[:k]
        assert len(retrieval.best_pairs(df, "id", "v", 0.35, 10**6, None, block).collect()) == len(every)
    assert retrieval.best_pairs(df.limit(0), "id", "v", 0.35, 5).count() == 0
