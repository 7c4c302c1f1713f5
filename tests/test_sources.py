import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import ingest, judges, review
from graphloom.sources import readers
from graphloom.streaming.increments import KEPT, GraphTable, Progress, RunStore
from test_core import EDGE, NOW, rec


def put(folder, name, said):
    with open(os.path.join(str(folder), name), "w", encoding="utf-8") as f:
        f.write(said)
    return os.path.join(str(folder), name)


def test_readers(spark, tmp_path):
    at = put(tmp_path, "a.txt", "﻿First line.\n\n  Second!  \nThird\n\n\nFourth")
    assert [(r.line_no, r.line) for r in readers.read_source(spark, "TEXT", at).orderBy("line_no").collect()] == [(1, "First line"), (2, "Second"), (3, "Third"), (4, "Fourth")]
    assert readers.read_source(spark, "PARAGRAPHS", at).count() == 3 and readers.read_source(spark, "CHUNKS", at, size=20, overlap=5).count() >= 2
    with pytest.raises(ValueError):
        readers.read_source(spark, "PDF", at)
    csv = put(tmp_path, "t.csv", "source;relationship;destination\n A  b ;requires; c\n;x;y\nq;;z\n")
    assert [tuple(r) for r in readers.csv_triples(spark, csv).collect()] == [("A b", "requires", "c", "A b requires c")]
    words = put(tmp_path, "s.json", json.dumps({"Fair  Ness": ["Equity", "equity", " ", "fair ness", "Balance"], "x": "no list"}))
    assert [(r.keyword, r.synonyms) for r in readers.synonym_file(spark, put(tmp_path, "s2.json", json.dumps({"Fair  Ness": ["Equity", "equity", " ", "fair ness", "Balance"]}))).collect()] == [("fair ness", ["Equity", "Balance"])]
    assert readers.synonym_file(spark, words).count() <= 1 and readers.synonym_file(spark, put(tmp_path, "bad.json", "{")).count() == 0 and readers.synonym_file(spark, str(tmp_path / "none.json")).count() == 0
    out = str(tmp_path / "w.json")
    readers.write_synonyms(spark.createDataFrame([("b", ["c"]), ("a", ["d", "e"])], "keyword string, synonyms array<string>"), out)
    assert json.load(open(out)) == {"a": ["d", "e"], "b": ["c"]} and readers.synonym_file(spark, out).count() == 2
    assert [r.keyword for r in readers.keyword_lines(spark, put(tmp_path, "k.txt", " one \n\n two\n")).orderBy("keyword").collect()] == ["one", "two"]
    art = put(tmp_path, "m.json", "\n".join(json.dumps({"id": str(9 - i), "topic": "t"}) for i in range(4)))
    assert [(r.ordinal, r.id) for r in readers.articles(spark, art).orderBy("ordinal").collect()] == [(i, str(6 + i)) for i in range(4)]
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert spark.read.json(readers.write_stage(df, str(tmp_path), "decompose")).count() == 1
    readers.write_report(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().b == "x"
    readers.write_json(df, str(tmp_path / "j"))
    assert readers.json_triples(spark, str(tmp_path / "j")).count() == 1


def test_chunks(spark):
    said = ["", None, "short", "word " * 900, "x" * 3000, "para one.\n\n" * 200, "line\n" * 500, "  "]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")
    by: dict = {}
    for r in ingest.chunks(df, size=100, overlap=20).orderBy("doc_id", "start_index").collect():
        by.setdefault(r.doc_id, []).append(r)
    for i, x in enumerate(said):
        own, covered = by.get(i, []), 0
        for r in own:
            assert x[r.start_index : r.start_index + len(r.chunk)] == r.chunk and len(r.chunk) <= 100 and r.start_index <= covered
            covered = max(covered, r.start_index + len(r.chunk))
        assert not (x or "").strip() or covered == len(x)


def edge(i, s, docs, kind=None):
    return (i, s, "requires", "b", docs, [rec(d) for d in docs], kind, NOW, NOW)


def test_table_of_versions(spark, tmp_path):
    t = GraphTable(spark, str(tmp_path / "g"), buckets=4)
    assert t.read() is None
    t.upsert(spark.createDataFrame([edge(i, f"n{i}", ["d"]) for i in range(20)], EDGE))
    before = t.parts()
    t.upsert(spark.createDataFrame([edge(100, "n3", ["e"], "seed")], EDGE))
    after = t.parts()
    assert sum(before[b] != after[b] for b in before) == 1  # one part was rewritten
    row = t.read().filter("source = 'n3'").first()
    assert (row.docs, row.knowledge_type, t.read().count()) == (["d", "e"], "seed", 20)
    once = sorted(map(str, t.read().collect()))
    t.upsert(spark.createDataFrame([edge(100, "n3", ["e"], "seed")], EDGE))
    assert sorted(map(str, t.read().collect())) == once
    t.upsert(spark.createDataFrame([], EDGE))
    for i in range(KEPT):
        t.upsert(spark.createDataFrame([edge(200 + i, "n5", [f"f{i}"])], EDGE))
    assert len(t.versions.numbers()) == KEPT and t.read().count() == 20
    t.reset()
    assert t.read() is None


def test_runs_and_progress(spark, tmp_path):
    s = RunStore(spark, str(tmp_path / "runs"))
    for i in range(KEPT + 2):
        s.save(f"run {i}", spark.range(i + 1))
    assert [*s.runs()] == [f"run {i}" for i in range(2, KEPT + 2)] and s.load("run 0") is None and s.load("run 5").count() == 6
    s.save("run 5", spark.range(2))
    assert s.load("run 5").count() == 2

    class Event:
        class progress:  # noqa: N801
            batchId, numInputRows = 3, 7

    seen = []
    p = Progress(lambda *x: seen.append(x))
    p.onQueryProgress(Event)
    assert seen == p.seen == [(3, 7)]


def test_answers_in_batches(spark):
    class Flaky:
        def respond(self, prompt):
            if "boom" in prompt:
                raise OSError("down")
            return "```json\n" + judges.Rules(lambda t: {"n": len(t)}).respond(prompt) + "\n```"

    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "boom"), (5, "known"), (6, "cc")], "id int, t string")
    cache = spark.createDataFrame([("known", '{"n": 0}')], "text string, answer string")
    got = {r.id: (r.answer and json.loads(r.answer).get("n"), r.failed) for r in judges.answer_batches(df, "id", "t", "Judge $items of $other", Flaky(), 2, cache).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (None, False), 4: (None, True), 5: (0, False), 6: (None, True)}
    assert judges.render("$a $b", a=[1], c=2) == "[1] $b"
    answers = iter("axrqa")
    assert judges.review_by_hand([{"i": 1}, {"i": 2}, {"i": 3}], lambda _: next(answers)) == ([{"i": 1}], [{"i": 2}])
    times = iter([0.0, 2.0, 5.0, 6.5])
    timer = judges.StageTimer(lambda: next(times))
    for _ in range(2):
        with timer.stage("x"):
            pass
    assert timer.total == 3.5


def test_guards_and_forms(spark):
    rows = spark.createDataFrame([(True,), (True,)], "failed boolean")
    with pytest.raises(RuntimeError):
        review.raise_if_all_failed(rows, "failed")
    review.raise_if_all_failed(rows.limit(0), "failed")
    with pytest.raises(ValueError):
        review.nonblank(spark.createDataFrame([(" ",), (None,)], "t string"), "t", required=True)

    def broken():
        raise ZeroDivisionError("x")

    got = {r.check: (r.passed, r.error) for r in review.guarded({"S1": broken, "S5": lambda: spark.sql("select 'S5' check, 0L bad, 1L total, 1.0D score, true passed")}).collect()}
    assert got["S1"][0] is False and "ZeroDivisionError" in got["S1"][1] and got["S5"] == (True, None)
    said = spark.createDataFrame([(0.53,), (75.2,), (3723.0,)], "s double").select(text.duration(F.col("s"))).collect()
    assert [r[0] for r in said] == ["0.53s", "1m 15.20s", "1h 2m 3.00s"]
    top = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.89), (1, 4, 0.5)], "query_id int, row_id int, cos double")
    v = spark.createDataFrame([(2, [1.0, 0.0]), (3, [1.0, 0.01]), (4, [0.0, 1.0])], "id int, v array<double>")
    assert [r.row_id for r in review.mmr(top, v, "id", "v", 2).orderBy("nth").collect()] == [2, 4]
