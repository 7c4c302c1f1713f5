import random
import unicodedata

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")

from graphloom.llm import canonical, formatting, similar  # noqa: E402


def damerau(a, b):
    last, inf = {}, len(a) + len(b)
    d = {(-1, -1): inf}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = inf, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = inf, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), db
            cost = a[i - 1] != b[j - 1]
            db = db if cost else j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_distance_and_tree_against_brute_force():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    entries = [(word(rng.randrange(3, 9)), i) for i in range(40)]
    tree = canonical.BkTree(entries)
    values = [word(rng.randrange(1, 10)) for _ in range(150)]
    limits = np.array([rng.randrange(0, 4) for _ in values])
    got = tree.nearest(values, limits)
    for v, t, g in zip(values, limits, got):
        near = min(((damerau(e, v), i) for e, i in entries if damerau(e, v) <= t), default=None)
        assert (None if g < 0 else (g >> 32, g & 0xFFFFFFFF)) == near


def test_canonicalise(spark):
    entries = spark.createDataFrame([(1, "IsSubclassOf"), (1, "kind of"), (2, "Requires"), (2, None), (3, "DependsOn")], "pid int, name string")
    values = ["is_subclass_of", "KIND  OF", "reqiures", "requires (draft)", "rel: depends on", "dеpends-on", "Ｒｅｑｕｉｒｅｓ", "smells like", "", None, "%%%", "requires " + "x" * 9000, "requires"]
    want = [1, 1, 2, 2, 3, 3, 2, -1, -1, -1, -1, -1, 2]
    df = spark.createDataFrame([(i, v, "kept") for i, v in enumerate(values)], "v int, value string, entry_id string")
    for limit in (1000, 2):  # broadcast, and in shards
        got = canonical.canonicalise(df, "value", entries, "pid", "name", limit=limit)
        assert [r.entry_id for r in got.orderBy("v").collect()] == want
    assert {r.entry_id for r in canonical.canonicalise(df, "value", entries.limit(0), "pid", "name").collect()} == {-1}
    assert canonical.canonicalise(df.limit(0), "value", entries, "pid", "name").count() == 0


def test_formatting(spark):
    key = lambda t: "".join(c for c in (t or "").casefold() if unicodedata.category(c)[0] in "LN")
    rows = [(1, "A-b", "p", None, None), (2, " a B", "P!", "", None), (3, None, None, None, '{"object": null, "subject": "a\\tb", "predicate": "p"}'), (4, "Straße", "x", "y", None), (5, "STRASSE", "X", "Y.", None), (6, None, None, None, None), (7, None, None, None, "not json"), (8, None, None, None, "not json")]
    rows += [(100 + i, "hot", "p", "o", None) for i in range(2000)] + [(None, "A b", "p", None, None)]
    df = spark.createDataFrame(rows, "id int, subject string, predicate string, object string, raw string")
    got = {tuple(r) for r in formatting.copies(df, "id", "raw").collect()}
    assert got == {(1, 2), (1, 3), (4, 5), (7, 8)} | {(100, 100 + i) for i in range(1, 2000)}
    g = {r.keep_id: (r.copies, r.variants) for r in formatting.groups(df, "id", "raw").collect()}
    assert g == {1: (4, 4), 4: (2, 2), 6: (1, 1), 7: (2, 1), 100: (2000, 1)} and key("STRASSE") == key("Straße")
    assert formatting.copies(df.limit(0), "id", "raw").count() == 0


def exact(vectors, k=10, least=0.9):
    ids = sorted(i for i, v in vectors.items() if v is not None and len(v) == 64 and any(v))
    x = np.array([vectors[i] for i in ids], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = np.round(x @ x.T, 6)
    np.fill_diagonal(cos, -2)
    out = set()
    for a, row in zip(ids, cos):
        best = sorted((-c, b) for b, c in zip(ids, row) if c >= least)[:k]
        out |= {(min(a, b), max(a, b)) for _, b in best}
    return out


def test_nearest(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 64))
    vectors = {i: (centres[i % 40] + rng.standard_normal(64) * rng.uniform(0.02, 0.35)).astype(np.float32).tolist() for i in range(1200)}
    vectors |= {2000 + i: vectors[7] for i in range(400)}  # one vector held by a quarter of the rows
    vectors |= {3000: None, 3001: [0.0] * 64, 3002: [1.0] * 40, 3003: [float("nan")] * 64, 3004: (np.array(vectors[5]) * 3).tolist()}
    df = spark.createDataFrame([(i, v, 1.0) for i, v in vectors.items()], "vec_id long, vector array<float>, cos double")
    near = similar.nearest(df, "vec_id", "vector")
    got = {tuple(r) for r in similar.pairs(near, "vec_id").collect()}
    want = exact({i: v for i, v in vectors.items() if i != 3003})
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert near.groupBy("vec_id").count().filter("count > 10").count() == 0
    assert similar.nearest(df.limit(0), "vec_id", "vector").count() == 0
    r = similar.recall(near, df, "vec_id", "vector").first()
    assert r.queries > 0 and r.recall >= 0.9


def test_nearest_in_a_hot_cell(spark, monkeypatch):
    """Different vectors within a narrow cone, in cells that are cut into blocks; a key is given twice."""
    monkeypatch.setattr(similar, "BLOCK", 150)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    vectors = {i: (centre + 0.1 * rng.standard_normal(64)).astype(np.float32).tolist() for i in range(700)} | {700 + i: rng.standard_normal(64).astype(np.float32).tolist() for i in range(100)}
    df = spark.createDataFrame([*vectors.items(), (3, vectors[3])], "vec_id long, vector array<float>")
    got = {tuple(r) for r in similar.pairs(similar.nearest(df, "vec_id", "vector"), "vec_id").collect()}
    want = exact(vectors)
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
