import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import encoder, node_entity, phrases, quality, ratios

STOP = frozenset("the of and a is for to by in".split())


def test_entities():
    assert phrases.entities("The risk_register of the Deployer is kept by auditors", STOP) == ["risk register", "Deployer", "kept", "auditors"] or phrases.entities("The risk_register of the Deployer is kept by auditors", STOP)[0] == "risk register"
    assert phrases.entities("post market monitoring plan", STOP, most=4) == ["post market monitoring plan", "post market monitoring", "market monitoring plan", "post market"]
    assert phrases.entities(None, STOP) == [] and phrases.entities(" the of ", STOP) == []
    assert phrases.schema_entities("GridSearchCV for a model", STOP) == ["GridSearchCV", "model"]


def test_keyphrases_and_cascade(spark):
    found = phrases.keyphrases(["Bias audit of the model", None, "  "], STOP, top=3)
    assert len(found[0]) == 3 and found[1:] == [[], []] and found[0][0][0] == "bias audit model"
    rows = [(1, "An audit plan."), (2, "A review is due."), (3, "Nothing alike here"), (4, None), (5, "audits of audit-like audited auditing"), (6, "")]
    got = {r.id: (r.match_type, r.matched_terms) for r in phrases.keyword_cascade(spark.createDataFrame(rows, "id int, t string"), "t", "Audit", ["review", "check"], stop=STOP).collect()}
    assert got[1] == ("exact", ["audit"]) and got[2] == ("synonym", ["review"]) and got[3][0] is None and got[4] == (None, []) and got[6] == (None, [])
    assert phrases.synonyms("Fairness", {}, {"fairness": ["Equity", "equity ", "fairness"]}) == ["Equity"] and phrases.synonyms("density", {}, {}) == ["dens"]


def test_node_entities_against_brute_force(spark):
    rng = random.Random(4)
    words = "model audit plan risk register deployer provider log record review".split()
    edges = [(i, " ".join(rng.sample(words, 2)), "requires", " ".join(rng.sample(words, 2))) for i in range(60)]
    texts = [(i, " the ".join(" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(3))) for i in range(12)] + [(50, None), (51, "the of"), (52, "zzz qqq")]
    e = spark.createDataFrame(edges, "edge_id long, source string, predicate string, target string")
    q = spark.createDataFrame(texts, "id long, quality string")
    k, least = 4, 0.6
    decisions, near = node_entity.neighbours(q, "id", "quality", e, k, least, stop=STOP)
    nodes: dict = {}
    for _, s, p, t in edges:
        for n in dict.fromkeys((s, t)):
            rel = nodes.setdefault(phrases.entity_key(n), [])
            if (s, p, t) not in rel:
                rel.append((s, p, t))
    keys = sorted(nodes)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    matrix = unit(encoder.vectors(keys).astype(float))
    want, scores = {}, {}
    for i, said in texts:
        hits = []
        for pos, ent in enumerate(phrases.entities(said, STOP)):
            v = unit(encoder.vectors([phrases.entity_key(ent)]).astype(float))[0]
            cos = np.floor(matrix @ v * 1e6 + 0.5) / 1e6
            best = sorted(range(len(keys)), key=lambda j: (-cos[j], keys[j]))[:k]
            hits += [(-cos[j], pos, r, keys[j]) for r, j in enumerate(best)]
        scores[i] = max([-h[0] for h in hits], default=0.0)
        out: list = []
        for c, _, _, node in sorted(hits):
            if -c >= least:
                out += [r for r in nodes[node] if r not in out]
        if scores[i] >= least:
            want[i] = out[:k]
    got: dict = {}
    for r in near.orderBy("id", "nth").collect():
        got.setdefault(r.id, []).append((r.source, r.predicate, r.target))
    assert got == want
    assert {r.id: r.decision for r in decisions.collect()} == {i: "KEPT" if scores[i] >= least else "DROPPED" for i, _ in texts}
    assert node_entity.neighbours(q.limit(0), "id", "quality", e, stop=STOP)[1].count() == 0


def test_entity_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    names += [n[:i] + rng.choice("xy") + n[i:] for n in names[:60] for i in [rng.randrange(len(n) + 1)]] + ["Explainability", "explainability ", "Explicability", None, " "]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    keys = sorted({" ".join(n.lower().split()) for n in names if n and n.strip()})
    for least in (0.82, 0.9):
        want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if difflib.SequenceMatcher(None, a, b).ratio() >= least}
        got = {(r.a, r.b) for r in quality.similar_forms(quality.forms(df), least).collect()}
        assert got == want
    inside = {(a, b) for a in keys for b in keys if a != b and len(a) >= 4 and a in b}
    assert {(r.a, r.b) for r in quality.contained_forms(quality.forms(df)).collect()} == inside
    assert {r.form for r in quality.entity_duplicates(df).filter("canonical = 'Explicability'").collect()} in ({"Explainability", "Explicability"}, set())
    assert quality.entity_duplicates(df.limit(0)).count() == 0


def test_support_by_a_sentence(spark):
    rows = [("Grid search", "The grid-searches and grid search", True), ("policies", "a policy of it", True), ("audit plans", "the plan of an audit", True), ("audit", None, False), ("the", "the", True), ("", "x", False), ("model card", "the card", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, s string, w boolean")
    got = df.select("i", "w", quality.supported(F.col("p"), F.col("s"), ["the", "of"]).alias("g")).collect()
    assert [r.i for r in got if r.w != r.g] == []


def test_ratios_of_arrays_are_those_of_difflib():
    rng = random.Random(6)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randrange(55, 75))) for _ in range(20)] + ["x" * i for i in (62, 63, 64, 65, 199, 201)]
    keys += [f"{w} {rng.choice('xyé中-')}{rng.randrange(100):03d}" for w in ("bias audit", "bias edit") for _ in range(40)]
    keys = sorted({*keys})
    for least in (0.5, 0.82, 0.9, 1.0):
        want = {(a, b): r for i, a in enumerate(keys) for b in keys[i + 1 :] if (r := difflib.SequenceMatcher(None, a, b).ratio()) >= least}
        assert {(a, b): r for x, y, z in ratios.alike(keys, None, least) for a, b, r in zip(x.to_pylist(), y.to_pylist(), z.tolist())} == want
        assert {p for x, y, _ in ratios.alike(keys[1::2], keys[::2], least, True) for p in zip(x.to_pylist(), y.to_pylist())} == {(a, b) for a, b in want if (keys.index(a) - keys.index(b)) % 2}
    assert [*ratios.alike([], None, 0.9)] == []


def test_duplicates_of_a_dense_table_do_not_list_its_pairs(spark, monkeypatch):
    """Every name is like hundreds of others: clusters by a few comparisons of each, in one block and in several, as by all pairs."""
    names = [f"{w} Audit {i % 1000:03d}" for w in ("Periodic Bias", "Federated Risk") for i in range(0, 500, 2)] + ["Sealed Gate", "Sealed  gates", "Else"]
    keys = sorted({" ".join(n.lower().split()) for n in names})
    compared, decided = [], ratios.decided
    monkeypatch.setattr(ratios, "decided", lambda x, y, c, p, *a: (compared.append(len(p)), decided(x, y, c, p, *a))[1])
    monkeypatch.setattr(ratios, "CHUNK", 4096)
    parent, links = ratios.linked(keys, None, np.arange(len(keys)), None, 0.85)
    few = sum(compared)
    pairs = {(i, j) for a, b, _ in ratios.alike(keys, None, 0.85) for i, j in zip(map(keys.index, a.to_pylist()), map(keys.index, b.to_pylist()))}
    whole = np.arange(len(keys))
    for _ in keys:
        low = whole.copy()
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
        if (low == whole).all():
            break
        whole = low
    assert (parent == whole).all() and len(links) == len(keys) - len({*whole.tolist()}) and few < len(pairs)
    want = {frozenset(keys[i] for i in np.flatnonzero(whole == r)) for r in {*whole.tolist()} if (whole == r).sum() > 1}
    f = quality.forms(spark.createDataFrame([(n,) for n in names], "name string"))
    for block in (100, 5000):
        got: dict = {}
        for r in quality.similar_roots(f, 0.85, block).collect():
            got.setdefault(r.root, set()).add(r.key)
        assert {frozenset(g) for g in got.values()} == want
    assert {(r.a, r.b) for r in quality.similar_forms(f, 0.85, 150, True).collect()} == {(keys[i], keys[j]) for i, j in pairs}


def test_candidates_work_out_no_more_than_the_decision(spark, monkeypatch):
    asked, forms = [], quality.similar_forms
    monkeypatch.setattr(quality, "similar_forms", lambda *a, **k: (asked.append(k), forms(*a, **k))[1])
    names = spark.createDataFrame([(n,) for n in ("Risk Register", "risk registers", "Registry", "Risk", "Else", "Register")], "name string")
    got = {(r.a, r.b) for r in quality.entity_candidates(names).collect()}
    assert asked == [{"decide": True}]
    assert got == {("register", "registry"), ("risk register", "risk registers"), ("risk", "risk register"), ("risk", "risk registers"), ("register", "risk register"), ("register", "risk registers")}


def test_candidates_are_each_listed_once_and_nothing_is_broadcast(spark, tmp_path):
    rng = random.Random(8)
    words = "model audit plan risk register deployer provider log record review".split()
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)] + [f"{'audit log ' * n}end" for n in (4, 5, 6, 18, 20, 21, 24)] + [f"{'x' * n} plan" for n in (4, 190, 197, 198, 240)]
    names = spark.createDataFrame([(n,) for n in names], "name string")
    keys = sorted(r.key for r in quality.forms(names).collect())
    want = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if difflib.SequenceMatcher(None, a, b).ratio() >= 0.82 or (min(len(a), len(b)) >= 4 and (a in b or b in a))]
    assert sorted((r.a, r.b) for r in quality.entity_candidates(names).collect()) == want
    # Written forms look small to Spark, of whose characters the driver would have to hold some twenty rows for each key.
    spark.createDataFrame([(k,) for k in keys], "key string").write.parquet(str(tmp_path / "keys"))
    f = quality.contained_forms(spark.read.parquet(str(tmp_path / "keys")))
    assert "Broadcast" not in f._jdf.queryExecution().executedPlan().toString()


def _clusters(keys: list[str], least: float) -> set:
    root = list(range(len(keys)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(keys):
        for j in range(i):
            if difflib.SequenceMatcher(None, keys[j], a).real_quick_ratio() >= least and difflib.SequenceMatcher(None, keys[j], a).ratio() >= least:
                root[top(i)] = top(j)
    got: dict = {}
    for i, k in enumerate(keys):
        got.setdefault(top(i), set()).add(k)
    return {frozenset(g) for g in got.values()}


def test_keys_of_one_beginning_are_met_by_their_ends(monkeypatch):
    """Many clusters that stay apart under the same letters and marks: only keys whose ends have enough in common are compared, in one block and across two, as by all pairs."""
    rng = random.Random(7)
    keys = sorted({f"sealed risk gate {rng.choice(('aab', 'aac', 'aba'))}-{rng.randrange(10000):04d}" for _ in range(500)})
    compared, decided = [], ratios.decided
    monkeypatch.setattr(ratios, "decided", lambda x, y, c, p, *a: (compared.append(len(p)), decided(x, y, c, p, *a))[1])
    want = _clusters(keys, 0.95)
    parent, links = ratios.linked(keys, None, np.arange(len(keys)), None, 0.95)
    assert {frozenset(keys[i] for i in np.flatnonzero(parent == r)) for r in {*parent.tolist()}} == want and 50 < len(want) == len(keys) - len(links)
    assert sum(compared) < 10 * len(keys)
    compared.clear()
    left, right = keys[::2], keys[1::2]
    both = [*left, *right]
    links = ratios.linked(left, right, np.arange(len(left)), len(left) + np.arange(len(right)), 0.95)[1]
    assert links and all(any(both[i] in c and both[j] in c for c in want) for i, j in links)
    assert sum(compared) < 10 * len(keys)


def test_clusters_of_odd_keys_are_those_of_all_pairs():
    rng = random.Random(8)
    base = ["register", "audit", "aud", "a" * 70, "risk register aab-12", "Пример реестра 12-34", "模型\U0001d4b6卡片 0123456789", "x" * 31 + "0123456789", "é" * 19 + "-0001"]
    keys = {*base}
    for b in base:
        for _ in range(25):
            k = [*b]
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(k))
                k[at:at + rng.randrange(2)] = rng.choice(["", "0", "1", "aa", "-", "é", "\U0001d4b6"])
            keys.add("".join(k) or "-")
    keys = sorted(keys)
    for least in (0.82, 0.9, 0.95):
        want = _clusters(keys, least)
        parent, links = ratios.linked(keys, None, np.arange(len(keys)), None, least)
        assert {frozenset(keys[i] for i in np.flatnonzero(parent == r)) for r in {*parent.tolist()}} == want and len(links) == len(keys) - len(want)
        # In three parts: each by itself, then those that are left apart across pairs of them.
        parts = [list(range(n, len(keys), 3)) for n in range(3)]
        label = np.arange(len(keys))
        for p in parts:
            own, _ = ratios.linked([keys[i] for i in p], None, np.arange(len(p)), None, least)
            label[p] = np.array(p)[own]
        joined = []
        for a, b in ((0, 1), (0, 2), (1, 2)):
            joined += ratios.linked([keys[i] for i in parts[a]], [keys[i] for i in parts[b]], label[parts[a]], label[parts[b]], least)[1]
        for a, b in joined:
            a, b = label[a], label[b]
            label[label == max(a, b)] = min(a, b)
        assert {frozenset(keys[i] for i in np.flatnonzero(label == r)) for r in {*label.tolist()}} == want
    assert ratios.linked([], None, np.zeros(0, np.int64), None, 0.9)[1] == [] and ratios.linked([], ["a"], np.zeros(0, np.int64), np.zeros(1, np.int64), 0.9)[1] == []
