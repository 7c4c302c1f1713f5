import difflib
import random

from pyspark.sql import functions as F

from graphloom.operators import grounding, phrases
from graphloom.plans import reports

VOCABULARY = [("is a", "IsA"), ("is a kind of", "IsKindOf"), ("has parameter", "HasParameter"), ("with default", "WithDefault")]
STOP = frozenset(("the", "of", "a", "is"))


def test_statements_of_a_schema(spark):
    lines = ["# note", "", None, 'GridSearchCV  has parameter "cv"; with default 5 ; nothing; with default', "a is a kind of b", "no phrase", "is a thing", "is abc is a x"]
    got = [(r.subject, r.predicate, r.object, [tuple(m) for m in r.modifiers]) for r in grounding.parse_schema(spark.createDataFrame([(x,) for x in lines], "line string"), VOCABULARY).collect()]
    assert got == [("GridSearchCV", "HasParameter", "cv", [("WithDefault", "5")]), ("a", "IsA", "kind of b", []), ("is abc", "IsA", "x", [])]


def test_types_templates_and_examples(spark):
    rows = [(1, "a", "IsA", "Model"), (2, "b", "IsSubclassOf", "a"), (3, "b", "HasParameter", "depth"), (4, "a", "HasParameter", "rate"), (5, "c", "Runs", "x"), (6, "a", "IsAn", "Estimator")]
    s = spark.createDataFrame([(i, a, p, b, f"{a} {p} {b}") for i, a, p, b in rows], "edge_id long, subject string, predicate string, object string, raw string")
    types = grounding.node_types(s)
    assert {(r.name, r.type) for r in types.collect()} == {(n, t) for n in "ab" for t in ("Model", "Estimator")}
    got = {(r.predicate, r.nth): (r.template, r.n) for r in grounding.templates(s, types).collect()}
    assert got[("HasParameter", 1)] == ("Estimator/Model --HasParameter--> Parameter", 2) and got[("Runs", 1)] == ("Concept --Runs--> Concept", 1)
    assert [r.raw for r in grounding.examples(s, 1).filter("predicate = 'HasParameter'").collect()] == ["b HasParameter depth"]


def test_node_matches(spark):
    nodes = ["sklearn.GridSearchCV", "risk_register", "Audit plan", "model card"]
    index = grounding.AliasIndex(nodes)
    assert index.node["grid search c v"] == "sklearn.GridSearchCV" and index.node["risk register"] == "risk_register"
    for key in ("audit plans", "grid search", "modelcard", "register of risk", "zzz"):
        want = difflib.get_close_matches(key, index.keys, n=3, cutoff=0.78)
        assert [k for _, k in index.close(key, 0.78)] == want
    for key in ("the audit plan here", "audit"):
        assert index.contained(key) == {k for k in index.keys if f" {k} " in f" {key} " or f" {key} " in f" {k} "}
    df = spark.createDataFrame([(1, "The Audit Plan of it"), (2, None), (3, "the modelcard")], "id int, t string")
    s = spark.createDataFrame([(n, n) for n in nodes], "subject string, object string")
    got = {(r.id, r.node): (round(r.score, 4), r.match_type) for r in grounding.match_nodes(df, "id", "t", s, stop=STOP).collect()}
    assert got[(1, "Audit plan")] == (1.0, "alias") and got[(3, "model card")][1] == "fuzzy" and not [k for k in got if k[0] == 2]


def test_phrases_of_many_texts_are_looked_up_once(monkeypatch):
    words = "audit plan risk register model card data sheet drift report".split()
    nodes = [f"{a.title()} {b.title()} {i}" for i, (a, b) in enumerate((a, b) for a in words for b in words)] + [f"{a}_{b}" for a in words for b in words]
    texts = [f"The {a} {b}s of the {c} {a} is an {b}{c}" for a in words for b in words for c in words[:3]] + ["audit plan 0", "the Audit Plan 1", None, ""]
    index, looked = grounding.AliasIndex(nodes), []
    contained = index.contained
    monkeypatch.setattr(index, "contained", lambda k: (looked.append(k), contained(k))[1])
    got = index.match_all(texts, STOP)
    assert len(looked) == len({*looked})
    for t in texts:  # as by all aliases of each phrase
        best: dict = {}
        for q in (t or "", *phrases.schema_entities(t, STOP)):
            key = phrases.schema_key(q)
            if len(key) >= 3 and key in index.node:
                best[index.node[key]] = (1.0, q, "alias")
            elif len(key) >= 3:
                hits = [(index.node[a], min(0.96, 0.72 + min(len(key), len(a)) / max(len(key), len(a)) * 0.24), "substring") for a in sorted(contained(key)) if len(key) >= 5 and len(a) >= 5]
                hits += [(index.node[a], difflib.SequenceMatcher(None, key, a).ratio(), "fuzzy") for a in difflib.get_close_matches(key, index.keys, 3, 0.78)]
                for node, score, kind in hits:
                    if node not in best or score > best[node][0]:
                        best[node] = (score, q, kind)
        want = sorted(((-s, n, q, k) for n, (s, q, k) in best.items()))[:5]
        assert [(-m["score"], m["node"], m["query"], m["match_type"]) for m in got[t]] == want


def test_hints_and_confidence(spark):
    df = spark.createDataFrame([("The threshold of a risk score",), (None,)], "t string")
    got = df.select(grounding.predicate_hints(F.col("t")), grounding.class_hints(F.col("t"), ["Risk Score", "Of"])).collect()
    assert got[0][0] == ["IsA", "Evaluates", "HasThreshold", "MightIntroduce", "SurfacesRisk"] and got[0][1] == ["Risk Score"] and got[1][0] == []
    c = df.select(grounding.confidence(F.lit(None).cast("double"), F.array(F.lit("x")), F.array()), grounding.confidence(F.lit(0.9), F.array(), F.array())).first()
    assert tuple(c) == (0.72, 0.9)


def test_status_of_triples(spark):
    said = "The grid search has a threshold for bias here"
    rows = [("Grid search", "Requires", "threshold"), ("Grid search", "Odd", "threshold"), ("Cat", "Requires", "bias"), ("grid search", "IsA", "Parameter"), ("grid search", "Requires", "dog"), ("grid search", "IsA", "bias"), ("grid search", "MightIntroduce", "bias"), ("grid search", "Runs", "threshold"), ("grid search", "BelongsToFamily", "threshold")]
    t = spark.createDataFrame([(i, *r, said) for i, r in enumerate(rows)], "i int, subject string, predicate string, object string, sentence string")
    one = spark.createDataFrame([("Model",)], "name string")
    got = grounding.triple_status(t, ["Requires", "IsA", "MightIntroduce", "Runs", "BelongsToFamily"], ["IsA", "MightIntroduce", "BelongsToFamily"], one, one.limit(0), [*STOP])
    assert [r.schema_status for r in got.orderBy("i").collect()] == ["SCHEMA_VALID", "NON_STANDARD_PREDICATE", "NO_SCHEMA_FIT", "NEEDS_SCHEMA_REVIEW", "NO_SCHEMA_FIT", "NEEDS_SCHEMA_REVIEW", "SCHEMA_VALID", "NO_SCHEMA_FIT", "NEEDS_SCHEMA_REVIEW"]
    assert {r.schema_status for r in grounding.sentence_status(got.filter("i in (0, 6)"), "sentence").collect()} == {"SCHEMA_VALID"}
    assert phrases.schema_key("A_b (C)") == "a b c"


def test_confidence_reads_its_schema_once(spark, monkeypatch):
    read, schema = [], reports.schema
    monkeypatch.setattr(reports, "schema", lambda s, d: (read.append(d), schema(s, d))[1])
    d = "/root/testdata/sf0.001"
    best = {r.vec_id: r.score for r in reports.schema_matches(spark, d).filter("nth = 1").collect()}
    del read[:]
    got = {r.vec_id: r.confidence for r in reports.grounding_confidence(spark, d).collect()}
    assert len(read) == 1 and all(got[k] >= round(s, 3) for k, s in best.items()) and {*best} <= {*got}


def test_all_edges_are_read_and_matched_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    words = "audit plan risk register model card data sheet drift report".split()
    nodes = [f"{a.title()} {b.title()} {i}" for i, (a, b) in enumerate((a, b) for a in words for b in words)] + [f"{a}_{b}" for a in words for b in words] + ["X", "RISK_register", "Risk Registers", "audit.LogBook"]
    texts = [f"The {a} {b}s of the {c} {a} is an {b}{c}" for a in words for b in words[:4] for c in words[:2]] + ["audit plan 0", "the Audit Plan 1", "Risk register and risk_register", "logbook", None, "", " "]
    texts += [" ".join(rng.choice(words) for _ in range(25)) for _ in range(15)]
    rows = spark.createDataFrame([*enumerate(texts), (0, texts[5])], "id int, t string")
    e = spark.createDataFrame([(i, n, "runs", nodes[-i - 1]) for i, n in enumerate(nodes)], "edge_id long, source string, predicate string, target string")
    s = grounding.from_edges(e, spark.createDataFrame([("runs", "Runs")], "rel_type string, canonical string"))
    assert s.count() == len(nodes) and "Limit" not in s._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(grounding, "ALIASES", 40)
    monkeypatch.setattr(grounding, "PHRASES", 60)
    one = grounding.AliasIndex(nodes).match_all(texts, STOP)
    want = sorted((i, k + 1, m["query"], m["node"], m["score"], m["match_type"]) for i, t in [*enumerate(texts), (0, texts[5])] for k, m in enumerate(one[t]))
    for shared in (grounding.SHARED, 0):
        monkeypatch.setattr(grounding, "SHARED", shared)
        got = grounding.match_nodes(rows, "id", "t", s, stop=STOP)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_queries_read_edges_beyond_the_reports_of_a_schema(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grounding, "SCAN", 1)
    columns = "edge_id long, source string, predicate string, target string, knowledge_type string, created_at timestamp, ingested_at timestamp, docs array<string>, records array<struct<doc string, quality string, chunk_index int, chunk_excerpt string, modality string>>"
    edges = [(i, n, "is instance of", t, None, None, None, ["d"], []) for i, (n, t) in enumerate([("first thing", "Odd Thing"), ("consent ledger", "Ledger Kind"), ("release gate", "Gate Kind")])]
    spark.createDataFrame(edges, columns).write.parquet(f"{tmp_path}/provenance_edges.parquet")
    known = spark.read.parquet("/root/testdata/sf0.001/predicate_vocab.parquet").filter("canonical = 'IsInstanceOf'").first()
    spark.createDataFrame(edges, columns).withColumn("predicate", F.lit(known.rel_type)).write.mode("overwrite").parquet(f"{tmp_path}/provenance_edges.parquet")
    spark.read.parquet("/root/testdata/sf0.001/predicate_vocab.parquet").write.parquet(f"{tmp_path}/predicate_vocab.parquet")
    spark.createDataFrame([(1, "release gate"), (2, "This gate kind is shut"), (3, "nothing"), (4, None)], "vec_id long, quality string").write.parquet(f"{tmp_path}/kept_qualities.parquet")
    assert ("release gate", 1.0) in {(r.node, r.score) for r in reports.schema_matches(spark, str(tmp_path)).filter("vec_id = 1").collect()}
    got = {r.vec_id: r.confidence for r in reports.grounding_confidence(spark, str(tmp_path)).collect()}
    assert got[1] == 1.0 and got[2] >= 0.72 and (got[3], got[4]) == (0.0, 0.0)


def test_classes_in_many_texts_are_those_of_the_hints(spark):
    classes = ["Risk Score", "risk_score", "Of", "Data Sheet", "Model", "Parameter"] + [f"Kind {i}" for i in range(12)]
    texts = ["The risk score of a model matrix", "kind 1 kind 2 kind 3 kind 4 kind 5 kind 6 kind 7 kind 8 kind 9 algorithm", "an Array", None, "", "datasheet", "a data_sheet evaluation"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {r.t: r.c for r in df.select("t", grounding.class_hints(F.col("t"), classes).alias("c")).collect()}
    assert {r.t: r.classes for r in grounding.classes_in(df, "t", spark.createDataFrame([(c,) for c in classes], "name string")).collect()} == want
