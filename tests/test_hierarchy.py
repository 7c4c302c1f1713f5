import random

from graphloom.operators.hierarchy import descendants, hierarchy, links

LINK = "node string, parent string"


def brute(rows):
    parent = {a: b for a, b in rows if a is not None and b is not None}
    names, out = set(parent) | set(parent.values()), {}
    below = dict.fromkeys(names, 0)
    for n in names:
        path, x = [n], n
        while x in parent and parent[x] not in path:
            x = parent[x]
            path.append(x)
        if x in parent:
            out[n] = ("cycle" if n in path[path.index(parent[x]) :] else "below_cycle", "", -1, [], -1)
        else:
            out[n] = ("tree", x, len(path) - 1, path[::-1])
            for a in path[1:]:
                below[a] += 1
    return {n: (*v, below[n]) if v[0] == "tree" else v for n, v in out.items()}


def run(spark, rows):
    got = hierarchy(spark.createDataFrame(rows, LINK)).collect()
    assert len({r.node for r in got}) == len(got)
    return {r.node: (r.kind, r.root, r.depth, list(r.path_names), r.n_desc) for r in got}


def test_chain_star_and_cycles(spark):
    rows = [(f"c{i}", f"c{i + 1}") for i in range(60)] + [(f"s{i}", "hub") for i in range(80)] + [("x", "y"), ("y", "z"), ("z", "x"), ("in", "x"), ("self", "self"), (None, "a"), ("b", None)]
    assert run(spark, rows) == brute(rows)


def test_random_forest_with_cycles(spark):
    rng = random.Random(5)
    rows = [(f"n{i}", f"n{rng.randrange(max(0, i - 6), i + 3)}") for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}


def test_links_and_descendants(spark):
    rows = [(" a ", "is_subclass_of", "b"), ("a", "IS SUBCLASS-OF.", "b"), ("b", "isSubclassOf", "c > d"), ("q", "requires", "r"), ("", "is_subclass_of", "r"), (None, None, None)]
    df = spark.createDataFrame(rows, "source string, predicate string, target string")
    got = links(df, "source", "target", "predicate", "IsSubclassOf")
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("b", "c > d")]
    assert sorted(map(tuple, descendants(hierarchy(got)).collect())) == [("b", "a", 1), ("c > d", "a", 2), ("c > d", "b", 1)]
