"""Schema statements and how texts and triples fit them: statements, types, templates, node matches and the status of a triple."""

from __future__ import annotations

import difflib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text
from graphloom.operators import components, phrases, quality, ratios
from graphloom.session import Scratch

#: Edges of the reports on a schema, the first by edge_id: a cap that is the feature. Matches and confidence read all edges.
SCAN = 60_000
#: Aliases and phrases of a block, and words that texts and phrases share up to which these are sent to the workers.
ALIASES, PHRASES, SHARED = 20_000, 20_000, 200_000
# Predicates that give a type, and what the object of a predicate stands for.
TYPING = ("IsA", "IsAn")
ROLES = {
    "HasParameter": "Parameter",
    "WithParameter": "Parameter",
    "HasInput": "Input",
    "HasOutput": "Output",
    "HasAttribute": "Attribute",
    "HasPackage": "Package",
    "HasPosition": "Position",
    "HasName": "Name",
    "IsOfType": "DataType",
    "WithDefault": "Default",
    "WithChoices": "ChoiceSet",
    "WithLow": "LowerBound",
    "WithHigh": "UpperBound",
    "HasThreshold": "Threshold",
    "HasDecisionFunction": "DecisionFunction",
    "MightIntroduce": "Risk",
    "MightMitigate": "Risk",
    "IsThreatTo": "Principle",
    "ChecksFor": "Risk",
    "SurfacesRisk": "Risk",
    "SensitiveFamily": "ModelFamily",
    "BelongsToFamily": "ModelFamily",
    "Evaluates": "Data Science Task",
    "Performs": "Data Science Task",
    "AndPerformsTask": "Data Science Task",
    "SuggestsPreprocessing": "Operator",
    "SuggestsReplacement": "ModelFamily",
}
# Predicates that need more than a template, and those that need none.
WEAK = ("Ensures", "ContributesTo", "Has", "Implements", "IsA", "IsAn")
FREE = ("Requires", "Recommends", "Permits", "Prohibits", "Defines")
# Words of data types and of risks, predicates whose object they are, and those that take any object.
TYPE_WORDS = ("str", "int", "float", "bool", "array", "ndarray", "tensor", "matrix", "dataframe", "dict", "list")
RISK_WORDS = ("risk", "bias", "shift", "leakage", "noise", "privacy", "toxicity", "hallucination", "injection", "fairness", "robustness", "accountability")
RISKS, ANY_OBJECT = ("MightIntroduce", "MightMitigate", "IsThreatTo", "ChecksFor", "SurfacesRisk"), ("HasParameter", "HasInput", "HasOutput", "HasAttribute")
# What words of a text hint at.
HINTS = {
    "parameter": ("HasParameter",),
    "hyperparameter": ("HasParameter",),
    "input": ("HasInput",),
    "output": ("HasOutput",),
    "return": ("HasOutput",),
    "attribute": ("HasAttribute",),
    "metric": ("IsA", "Evaluates"),
    "score": ("IsA", "Evaluates"),
    "evaluate": ("Evaluates",),
    "evaluation": ("Evaluates", "IsA"),
    "threshold": ("HasThreshold",),
    "risk": ("MightIntroduce", "SurfacesRisk"),
    "bias": ("MightIntroduce", "IsThreatTo"),
    "mitigate": ("MightMitigate",),
    "threat": ("IsThreatTo",),
    "family": ("BelongsToFamily", "SensitiveFamily"),
    "model": ("IsA", "Performs", "Implements"),
    "algorithm": ("Implements", "IsA"),
    "operator": ("IsAn",),
    "function": ("IsAn", "Implements"),
    "interface": ("IsA", "AppliesTo"),
    "matrix": ("HasOutput", "IsOfType"),
    "array": ("HasOutput", "IsOfType"),
    "ndarray": ("HasOutput", "IsOfType"),
    "tensor": ("HasOutput", "IsOfType"),
}
CLASS_WORDS = {"matrix": "DataType", "array": "DataType", "ndarray": "DataType", "tensor": "DataType", "algorithm": "Concept", "evaluation": "Evaluation Procedure"}


def _phrase(c: Column, vocabulary: list[tuple[str, str]]) -> tuple[Column, Column, Column]:
    """(predicate, before, after) of the first phrase of the vocabulary in a text, of several there the first listed; null if there is none."""
    rule = "(?<![A-Za-z0-9_])(?:" + "|".join(re.escape(p) for p, _ in vocabulary) + ")(?![A-Za-z0-9_])"
    said = F.regexp_extract(c, rule, 0)
    names = F.create_map(*(F.lit(x) for pair in dict(reversed(vocabulary)).items() for x in pair))
    before = F.get(F.split(c, rule, 2), F.lit(0))
    return F.element_at(names, said), before, F.substring(c, F.length(before) + F.length(said) + 1, F.length(c))


def _object(c: Column) -> Column:
    return F.regexp_replace(text.name(c), '^"+|"+$', "")


def parse_schema(lines: DataFrame, vocabulary: list[tuple[str, str]], line: str = "line") -> DataFrame:
    """Adds subject, predicate, object and modifiers array<struct<predicate, object>> to lines `<subject> <phrase> <object>; <phrase> <object>; ...`.

    vocabulary lists (phrase, predicate); the earliest phrase of a part decides, ties by its order. Blank lines, comments (#) and lines whose
    first part states nothing are left out, modifiers without a phrase or object too.
    """
    parts = F.filter(F.transform(F.split(F.col(line), ";"), lambda p: text.strip(p)), lambda p: p != "")
    rows = lines.filter(~text.strip(F.coalesce(F.col(line), F.lit(""))).startswith("#")).withColumn("__parts", parts).filter("size(__parts) > 0")
    predicate, before, after = _phrase(F.get("__parts", F.lit(0)), vocabulary)
    rows = rows.withColumns({"subject": text.name(before), "predicate": predicate, "object": _object(after)})

    def modifier(p: Column) -> Column:
        pred, _, rest = _phrase(p, vocabulary)
        return F.struct(pred.alias("predicate"), _object(rest).alias("object"))

    others = F.filter(F.transform(F.slice("__parts", F.lit(2), F.size("__parts")), modifier), lambda m: m["predicate"].isNotNull() & (m["object"] != ""))
    return rows.withColumn("modifiers", others).filter("predicate is not null and subject <> '' and object <> ''").drop("__parts")


def from_edges(e: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(edge_id, subject, predicate, object, raw) of the edges whose type is in the vocabulary (rel_type, canonical); raw is the triple in words."""
    v = vocabulary.select("rel_type", "canonical").dropDuplicates(["rel_type"])
    rows = e.select("edge_id", "source", "predicate", "target").join(F.broadcast(v), F.col("predicate") == F.col("rel_type"))
    return rows.select("edge_id", F.col("source").alias("subject"), F.col("canonical").alias("predicate"), F.col("target").alias("object"), F.concat_ws(" ", "source", F.replace("predicate", F.lit("_"), F.lit(" ")), "target").alias("raw"))


def node_types(statements: DataFrame, typing: tuple[str, ...] = TYPING, below: str = "IsSubclassOf") -> DataFrame:
    """(name, type): what nodes are, by their own statements and all above them."""
    own = statements.filter(F.col("predicate").isin(*typing)).select(F.col("subject").alias("name"), F.col("object").alias("type"))
    return components.inherit(own, statements.filter(F.col("predicate") == below).select(F.col("subject").alias("name"), F.col("object").alias("parent")))


def roles(types: DataFrame) -> DataFrame:
    """(name, role): the first three types of a node by name."""
    ranked = types.selectExpr("name", "type", "row_number() over (partition by name order by type) as nth").filter("nth <= 3")
    return ranked.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "type"))), lambda x: x["type"]), "/").alias("role"))


def templates(statements: DataFrame, types: DataFrame, typing: tuple[str, ...] = TYPING, most: int = 8) -> DataFrame:
    """(predicate, nth, template, n): the `most` most frequent forms `role --predicate--> role` of a predicate, ties by the first statement."""
    r = roles(types)
    s = statements.join(r.select(F.col("name").alias("subject"), F.col("role").alias("s_role")), "subject", "left").join(r.select(F.col("name").alias("object"), F.col("role").alias("o_role")), "object", "left")
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    role = F.coalesce("o_role", F.when(F.col("predicate").isin(*typing, "IsSubclassOf"), F.col("object")), F.element_at(known, F.col("predicate")), F.lit("Concept"))
    form = F.concat(F.coalesce("s_role", F.lit("Concept")), F.lit(" --"), "predicate", F.lit("--> "), role)
    g = s.groupBy("predicate", form.alias("template")).agg(F.count("*").alias("n"), F.min("edge_id").alias("first"))
    return g.selectExpr("predicate", "row_number() over (partition by predicate order by n desc, first) as nth", "template", "n").filter(f"nth <= {most}")


def examples(statements: DataFrame, most: int = 12) -> DataFrame:
    """(predicate, nth, raw): the first statements of each predicate."""
    return statements.selectExpr("predicate", "row_number() over (partition by predicate order by edge_id) as nth", "raw").filter(f"nth <= {most}")


def aliases(node: str) -> set[str]:
    """The keys by which a node is known: as it is, with dots as spaces, with changes of case apart, and each of these of its last dotted part."""
    apart = lambda x: re.sub(r"(?<!^)(?=[A-Z])", " ", x).replace("_", " ")
    said = [node, node.replace(".", " "), apart(node)]
    if "." in node:
        last = node.rsplit(".", 1)[1]
        said += [last, apart(last)]
    return {k for k in map(phrases.schema_key, said) if len(k) >= 2}


class AliasIndex:
    """The aliases of the nodes of a schema: exact, contained and close ones of a key."""

    def __init__(self, nodes: list[str], known: dict[str, str] | None = None):
        self.node: dict[str, str] = known or {}
        for n in sorted(nodes):
            for a in sorted(aliases(n)):
                self.node.setdefault(a, n)
        self.keys = sorted(self.node)
        self.by_word: dict[str, list[str]] = {}
        for k in self.keys:
            for w in {*k.split()}:
                self.by_word.setdefault(w, []).append(k)
        self._arrays: ratios.Keys | None = None  # made where they are used, not sent along
        self._found: dict[tuple, list[tuple[float, str, str]]] = {}

    def contained(self, key: str) -> set[str]:
        """Aliases within the key, or that have it within them, as whole words."""
        words = key.split()
        out = {k for i in range(len(words)) for j in range(i + 1, len(words) + 1) if (k := " ".join(words[i:j])) in self.node}
        rare = min((self.by_word.get(w, []) for w in words), key=len, default=[])
        return out | {k for k in rare if f" {key} " in f" {k} "}

    def close(self, key: str, least: float, n: int = 3) -> list[tuple[float, str]]:
        """The n closest aliases of a ratio of at least `least`."""
        return self.close_all([key], least, n)[key]

    def close_all(self, keys: list[str], least: float, n: int = 3) -> dict[str, list[tuple[float, str]]]:
        """close for many different keys at a time; only pairs whose letters allow the ratio are compared."""
        out: dict[str, list[tuple[float, str]]] = {k: [] for k in keys}
        letters = np.array(sorted(map(ord, "abcdefghijklmnopqrstuvwxyz0123456789+#.- ")), np.uint32)
        if self._arrays is None:
            self._arrays = ratios.Keys(self.keys, letters)
        x, reach = self._arrays, int(self._arrays.size.max(initial=0)) * (2 - least) / least + 1e-9
        y = ratios.Keys([k for k in keys if len(k) <= reach], letters)
        places = y.places()
        for p, q in ratios.rectangles(x, y, False, least):
            for i, j, r in zip(*(v.tolist() for v in ratios.decided(x, y, places, p, q, least, False, True))):
                out[y.keys[j]].append((r, x.keys[i]))
        return {k: sorted(v, reverse=True)[:n] for k, v in out.items()}

    def _look_up(self, keys: list[str], most: int, least: float) -> None:
        """Keeps for each key that is no alias its `most` best (score, node, match_type), ties by name: others cannot be among those of a text that has the key."""
        fresh = [k for k in dict.fromkeys(keys) if len(k) >= 3 and k not in self.node and (k, most, least) not in self._found]
        for key, near in self.close_all(fresh, least).items() if fresh else ():
            best: dict[str, tuple[float, str]] = {}

            def add(node: str, score: float, kind: str) -> None:
                if node not in best or score > best[node][0]:
                    best[node] = (score, kind)

            if len(key) >= 5:
                for a in self.contained(key):
                    if len(a) >= 5:
                        add(self.node[a], min(0.96, 0.72 + min(len(key), len(a)) / max(len(key), len(a)) * 0.24), "substring")
            for _, a in near:
                add(self.node[a], difflib.SequenceMatcher(None, key, a).ratio(), "fuzzy")
            self._found[key, most, least] = [(s, n, kind) for n, (s, kind) in heapq.nsmallest(most, best.items(), key=lambda m: (-m[1][0], m[0]))]

    def match(self, said: str | None, stop: frozenset[str], most: int = 5, least: float = 0.78) -> list[dict]:
        """The best matches of a text and its entities: alias 1.0; contained up to 0.96 by the shares of their lengths; close ones by their ratio."""
        return self.match_all([said], stop, most, least)[said]

    def match_all(self, texts: list[str | None], stop: frozenset[str], most: int = 5, least: float = 0.78) -> dict[str | None, list[dict]]:
        """match for many different texts; what is said in several of them is looked up once."""
        queries = {t: [(q, phrases.schema_key(q)) for q in (t or "", *phrases.schema_entities(t, stop))] for t in texts}
        self._look_up([k for said in queries.values() for _, k in said], most, least)
        out = {}
        for t, said in queries.items():
            best: dict[str, dict] = {}
            for query, key in said:
                if len(key) < 3:
                    continue
                if key in self.node:
                    best[self.node[key]] = {"query": query, "node": self.node[key], "score": 1.0, "match_type": "alias"}
                    continue
                for score, node, kind in self._found[key, most, least]:
                    if node not in best or score > best[node]["score"]:
                        best[node] = {"query": query, "node": node, "score": score, "match_type": kind}
            out[t] = sorted(best.values(), key=lambda m: (-m["score"], m["node"]))[:most]
        return out


def _keys(c: Column) -> Column:
    return F.pandas_udf(lambda x: x.map(phrases.schema_key), T.StringType())(c)


def _occurring(said: DataFrame, named: DataFrame, s: Scratch) -> DataFrame:
    """(key, phrase): the phrases of named that stand in the keys of said as whole words; both distinct and normal (see schema_key).

    The spans of a key are looked up among all phrases by a join. Only those are made whose words occur on both sides, if there are no more than SHARED such words.
    """
    words = lambda df, c: df.select(F.explode(F.split(c, " ")).alias("w")).distinct()
    common = s.write(words(named, "phrase").join(words(said, "key").hint("merge"), "w"))
    held = frozenset(r[0] for r in common.collect()) if common.count() <= SHARED else None
    longest = named.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            keys, spans = [], []
            for key in x["key"].to_pylist():
                w, own = key.split(), set()
                for i in range(len(w)):
                    for j in range(i, min(len(w), i + longest)):
                        if held is not None and w[j] not in held:
                            break
                        own.add(" ".join(w[i : j + 1]))
                keys += [key] * len(own)
                spans += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(spans, pa.string())], ["key", "phrase"])

    return said.select("key").mapInArrow(cut, "key string, phrase string").join(named.select("phrase").hint("merge"), "phrase").select("key", "phrase")


def _blocks(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.repartitionByRange(n, by).withColumn("own", F.spark_partition_id())


def _found(keys: DataFrame, known: DataFrame, s: Scratch, most: int, least: float) -> DataFrame:
    """(key, node, score, match_type): the `most` best nodes of each distinct key among the aliases known (alias, node), those that match_all would look up.

    Blocks of keys are met with blocks of aliases. Keys that are longer than what can be close to an alias only have aliases within them.
    """
    n, widest = known.agg(F.count("*"), F.max(F.length("alias"))).first()
    reach = (widest or 0) * (2 - least) / least + 1e-9
    near = keys.filter(F.length("key") <= reach)
    na, nk = max(1, -(-n // ALIASES)), max(1, -(-near.count() // PHRASES))
    own = s.write(_blocks(known.withColumnRenamed("alias", "key"), "key", na))
    asked = s.write(_blocks(near, "key", nk))
    each = lambda of, unit: F.explode(F.transform(F.sequence(F.lit(0), F.lit(of - 1)), unit)).alias("unit")
    left = own.select(each(nk, lambda i: F.col("own") * nk + i), F.lit(0).alias("side"), "key", "node")
    right = asked.select(each(na, lambda i: i * nk + F.col("own")), F.lit(1).alias("side"), "key", F.lit(None).cast("string").alias("node"))

    def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, side in quality._whole(parts):
            first = pa.array(side == 0)
            index = AliasIndex([], dict(zip(x["key"].filter(first).to_pylist(), x["node"].filter(first).to_pylist())))
            said = x["key"].filter(pa.array(side == 1)).to_pylist()
            rows = [(k, "alias", 1.0, 1.0, k, index.node[k]) for k in said if k in index.node]
            said = [k for k in said if k not in index.node] if index.node else []
            for key, close in index.close_all(said, least).items() if said else ():
                best: dict[str, tuple[float, str]] = {}
                for a in index.contained(key) if len(key) >= 5 else ():
                    if len(a) >= 5:
                        score = min(0.96, 0.72 + min(len(key), len(a)) / max(len(key), len(a)) * 0.24)
                        best[index.node[a]] = max(best.get(index.node[a], (0.0, "")), (score, a))
                rows += [(key, "substring", 0.0, r, a, m) for m, (r, a) in heapq.nsmallest(most, best.items(), key=lambda m: (-m[1][0], m[0]))]
                rows += [(key, "fuzzy", ratio, difflib.SequenceMatcher(None, key, a).ratio(), a, index.node[a]) for ratio, a in close]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "match_type", "ratio", "score", "alias", "node"])

    met = left.unionByName(right).repartition(na * nk, "unit").sortWithinPartitions("unit", "side").mapInArrow(look_up, "key string, match_type string, ratio double, score double, alias string, node string")
    # The closest aliases of all blocks, and no other nodes for a key that is an alias.
    met = s.write(met).selectExpr("*", "row_number() over (partition by key, match_type order by ratio desc, alias desc) as nth", "max(match_type = 'alias') over (partition by key) as exact")
    met = met.filter("match_type = 'alias' or not exact and (match_type = 'substring' or nth <= 3)").select("key", "node", "score", "match_type")
    named = known.filter("length(alias) >= 5").withColumnRenamed("alias", "phrase")
    share = F.least(F.length("key"), F.length("phrase")) / F.greatest(F.length("key"), F.length("phrase"))
    inside = _occurring(keys.filter(F.length("key") > reach), named, s).join(named.hint("merge"), "phrase").select("key", "node", F.least(F.lit(0.96), F.lit(0.72) + share * 0.24).alias("score"), F.lit("substring").alias("match_type"))
    best = met.unionByName(inside).groupBy("key", "node").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("match_type") == "fuzzy", "match_type")).alias("m"))
    best = best.select("key", "node", (-F.col("m.less")).alias("score"), "m.match_type")
    return best.selectExpr("*", "row_number() over (partition by key order by score desc, node) as nth").filter(f"nth <= {most}").drop("nth")


def match_nodes(rows: DataFrame, key: str, body: str, statements: DataFrame, most: int = 5, least: float = 0.78, stop: frozenset[str] | None = None) -> DataFrame:
    """(key, nth, query, node, score, match_type): up to `most` schema nodes for each text, the best first, ties by name, as by AliasIndex of all nodes.

    The nodes are those of all the statements; their aliases lie in blocks, and no worker holds more than one of these. A null or blank text has none.
    """
    words = phrases.stop_words() if stop is None else stop
    s = Scratch(rows.sparkSession)
    texts = s.write(rows.filter(F.col(body).isNotNull()).select(F.col(body).alias("text")).distinct().withColumn("id", F.monotonically_increasing_id()))

    def named(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            pairs = [(a, n) for n in x["n"].to_pylist() for a in sorted(aliases(n))]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["alias", "node"])

    def asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            out = [(i, n, q, k) for i, t in zip(x["id"].to_pylist(), x["text"].to_pylist()) for n, q in enumerate((t, *phrases.schema_entities(t, words))) if len(k := phrases.schema_key(q)) >= 3]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], ["id", "place", "query", "key"])

    nodes = statements.select(F.explode(F.array("subject", "object")).alias("n")).filter("n is not null").distinct()
    known = s.write(nodes.mapInArrow(named, "alias string, node string").groupBy("alias").agg(F.min("node").alias("node")))
    said = s.write(texts.mapInArrow(asked, "id long, place int, query string, key string"))
    found = s.write(_found(said.select("key").distinct(), known, s, most, least))
    # Of several phrases the last that is an alias, else the first of the best score.
    hit = said.join(found, "key").groupBy("id", "node").agg(F.min(F.struct((-F.col("score")).alias("less"), F.when(F.col("match_type") == "alias", -F.col("place")).otherwise(F.col("place")).alias("place"), "query", "match_type")).alias("m"))
    hit = hit.selectExpr("id", "cast(row_number() over (partition by id order by m.less, node) as int) as nth", "m.query as query", "node", "-m.less as score", "m.match_type as match_type").filter(f"nth <= {most}")
    out = rows.select(F.col(key).alias("__key"), F.col(body).alias("text")).join(texts, "text").join(hit, "id")
    return out.select(F.col("__key").alias(key), "nth", "query", "node", "score", "match_type")


def predicate_hints(body: Column) -> Column:
    """Predicates that the words of a text hint at, in the order of HINTS."""
    said = text.key_words(F.coalesce(body, F.lit("")))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(said.contains(w), F.array(*(F.lit(p) for p in ps))).otherwise(none) for w, ps in HINTS.items())))


def class_hints(body: Column, classes: list[str], most: int = 8) -> Column:
    """Class names that stand in a text as whole words, by name, then those of CLASS_WORDS; the first `most`.

    The spans of a text are looked up among the classes, which every worker holds; see classes_in for many.
    """
    by_key: dict[str, list[str]] = {}
    for c in sorted(classes):
        if len(k := phrases.schema_key(c)) >= 4:
            by_key.setdefault(k, []).append(c)
    longest = max((len(k.split()) for k in by_key), default=0)

    def hints(said: str | None) -> list[str]:
        key = phrases.schema_key(said or "")
        w = key.split()
        spans = {" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)}
        named = sorted(c for k in spans for c in by_key.get(k, ()))
        return [*dict.fromkeys([*named, *(c for x, c in CLASS_WORDS.items() if x in key)])][:most]

    return F.pandas_udf(lambda s: s.map(hints), T.ArrayType(T.StringType()))(body)


def classes_in(rows: DataFrame, body: str, classes: DataFrame, most: int = 8) -> DataFrame:
    """Adds classes, as class_hints has them, for any number of classes (name): the spans of the distinct texts are joined with them."""
    s = Scratch(rows.sparkSession)
    texts = s.write(rows.filter(F.col(body).isNotNull()).select(F.col(body).alias(body)).distinct().withColumn("key", _keys(F.col(body))))
    named = s.write(classes.filter("name is not null").select("name").distinct().withColumn("phrase", _keys(F.col("name"))).filter("length(phrase) >= 4"))
    inside = _occurring(texts.select("key").distinct(), named.select("phrase").distinct(), s).join(named.hint("merge"), "phrase")
    best = inside.selectExpr("key", "name", "row_number() over (partition by key order by name) as nth").filter(f"nth <= {most}").groupBy("key").agg(F.sort_array(F.collect_list("name")).alias("names"))
    none = F.array().cast("array<string>")
    fixed = [F.when(F.col("key").contains(w), F.array(F.lit(c))).otherwise(none) for w, c in CLASS_WORDS.items()]
    held = texts.join(best, "key", "left").select(body, F.slice(F.array_distinct(F.concat(F.coalesce("names", none), *fixed)), 1, most).alias("classes"))
    return rows.join(held, body, "left").withColumn("classes", F.coalesce("classes", none))


def confidence(best: Column, classes: Column, hints: Column) -> Column:
    """The best match, at least 0.72 with a class hint and 0.64 with a predicate hint."""
    return F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(classes) > 0, 0.72).otherwise(0.0), F.when(F.size(hints) > 0, 0.64).otherwise(0.0))


def _has_word(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def triple_status(triples: DataFrame, allowed: list[str], templated: list[str], classes: DataFrame, nodes: DataFrame, stop: list[str]) -> DataFrame:
    """Adds schema_status to triples (subject, predicate, object, sentence).

    NON_STANDARD_PREDICATE outside the allowed ones; else by a ladder: NO_SCHEMA_FIT if the sentence does not hold the subject; for an object that it does not hold
    NEEDS_SCHEMA_REVIEW if that is a type, else NO_SCHEMA_FIT; SCHEMA_VALID for normative predicates; review for weak ones, valid for others with a template, each
    by whether the object fits, is a type or the sentence hints at the predicate; NO_SCHEMA_FIT without a template. classes and nodes have (name).
    """
    key = lambda c: text.key_words(F.regexp_replace(c, "(?<!^)(?=[A-Z])", " "))
    known = classes.select("name").unionByName(nodes.select("name")).distinct().withColumn("known", F.lit(True))
    class_keys = classes.select(key(F.col("name")).alias("k")).unionByName(triples.sparkSession.createDataFrame([(r,) for r in sorted({*ROLES.values()})], "k string").select(key(F.col("k")).alias("k"))).distinct().withColumn("is_class", F.lit(True))
    t = triples.withColumns({"subject": text.name(F.col("subject")), "object": text.name(F.col("object"))})
    t = t.withColumns({"__k": key(F.col("object")), "__o": text.key_words(F.col("object"))})
    t = t.join(known.withColumnRenamed("name", "object"), "object", "left").join(class_keys.withColumnRenamed("k", "__k"), "__k", "left")
    p, o = F.col("predicate"), F.col("__o")
    subject, obj = quality.supported(F.col("subject"), F.col("sentence"), stop), quality.supported(F.col("object"), F.col("sentence"), stop)
    typed = (p.isin(*TYPING) & F.coalesce("is_class", F.lit(False))) | ((p == "IsOfType") & _has_word(F.col("__k"), TYPE_WORDS))
    role = F.element_at(F.create_map(*(F.lit(x) for a, b in ROLES.items() for x in (a, phrases.schema_key(b)))), p)
    fits = (o != "") & (F.coalesce("known", F.lit(False)) | F.coalesce(o.contains(role), F.lit(False)) | (p.isin(*ANY_OBJECT) & (F.length(o) >= 2)) | ((p == "IsOfType") & _has_word(o, TYPE_WORDS)) | (p.isin(*RISKS) & _has_word(o, RISK_WORDS)))
    some = fits | typed | F.array_contains(predicate_hints(F.col("sentence")), p)
    status = (
        F.when(~p.isin(*allowed), "NON_STANDARD_PREDICATE")
        .when(~subject, "NO_SCHEMA_FIT")
        .when(~obj, F.when(typed, "NEEDS_SCHEMA_REVIEW").otherwise("NO_SCHEMA_FIT"))
        .when(p.isin(*FREE), "SCHEMA_VALID")
        .when(p.isin(*WEAK) & ~some, "NEEDS_SCHEMA_REVIEW")
        .when(p.isin(*templated), F.when(some, "SCHEMA_VALID").otherwise("NEEDS_SCHEMA_REVIEW"))
        .otherwise("NO_SCHEMA_FIT")
    )
    return t.withColumn("schema_status", status).drop("__k", "__o", "known", "is_class")


def sentence_status(triples: DataFrame, key: str) -> DataFrame:
    """(key, schema_status): of the triples of a sentence: valid or no fit if all are, else to be reviewed."""
    g = triples.groupBy(key).agg(F.min("schema_status").alias("lo"), F.max("schema_status").alias("hi"))
    return g.select(key, F.when((F.col("lo") == F.col("hi")) & F.col("lo").isin("SCHEMA_VALID", "NO_SCHEMA_FIT"), F.col("lo")).otherwise("NEEDS_SCHEMA_REVIEW").alias("schema_status"))
