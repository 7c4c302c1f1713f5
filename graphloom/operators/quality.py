"""Checks of extracted triples: entities that are one under two spellings, duplicate relations, support by their sentence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import components, ratios
from graphloom.session import Scratch

#: Least ratio of a candidate pair, and of a pair that is confirmed without a judge.
LEXICAL, CONFIRMED = 0.82, 0.9
#: Keys of a block, the most that it may have where there are many blocks, and the blocks that are no reason for wider ones, of listed pairs and of clusters.
KEYS, WIDEST = 2000, 50_000
LISTED, CLUSTERED = 16, 12


def forms(names: DataFrame, name: str = "name") -> DataFrame:
    """(key, form): the distinct names by their normal form, the smallest spelling of each; blank and null ones are left out."""
    return names.select(text.normal(F.col(name)).alias("key"), text.strip(F.col(name)).alias("form")).filter("key <> ''").groupBy("key").agg(F.min("form").alias("form"))


def _blocks(f: DataFrame, keys: int, blocks: int) -> tuple[DataFrame, int]:
    """(key, own): the keys in blocks of neighbours by spelling, each of which is a partition, and the number of blocks."""
    n = max(1, -(-f.count() // keys))
    n = max(min(n, blocks), -(-n * keys // WIDEST))
    return f.select("key").repartitionByRange(n, "key").withColumn("own", F.spark_partition_id()), n


def _units(k: DataFrame, n: int, own: bool) -> DataFrame:
    """Adds (unit, side) to rows of n blocks: each pair of blocks is a unit in which rows of the first have side 0, of the second 1; if wanted a block alone too. Units lie whole and in order in a partition."""
    met = k.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter("own <> met" if not own else "true")
    unit = F.least("own", "met") * F.lit(n) + F.greatest("own", "met")
    return met.select(unit.alias("unit"), (F.col("own") > F.col("met")).cast("int").alias("side"), *k.columns).repartition(n * (n + 1) // 2, "unit").sortWithinPartitions("unit", "side")


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """(unit, rows, side) of each unit, of which the batches have pieces."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[int, pa.Table, np.ndarray]:
        x = pa.Table.from_batches(held)
        return x["unit"][0].as_py(), x, x["side"].to_numpy()

    for x in parts:
        units = x.column("unit").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(units)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                if held and held[0].column("unit")[0].as_py() != units[lo]:
                    yield whole()
                    held = []
                held.append(x.slice(lo, hi - lo))
    if held:
        yield whole()


def similar_forms(f: DataFrame, least: float = LEXICAL, keys: int = KEYS, decide: bool = False) -> DataFrame:
    """(a, b, ratio), a < b: the pairs of keys whose ratio is at least `least`, all of them; decide: the ratio given may be lower than theirs, but not than `least`.

    Keys lie in blocks of about `keys`, or more if that were many blocks, and each pair of blocks is compared in one go (see ratios). The work grows
    with the square of the distinct bags of letters, and with the pairs of keys whose letters allow the ratio.
    """
    k, n = _blocks(f, keys, LISTED)
    k = Scratch(f.sparkSession).write(k)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, x, side in _whole(parts):
            left, right = (x["key"].filter(pa.array(side == i)).to_pylist() for i in (0, 1))
            for found in ratios.alike(left, None if unit // n == unit % n else right, least, decide):
                yield pa.RecordBatch.from_arrays([*found[:2], pa.array(found[2])], ["a", "b", "ratio"])

    return _units(k, n, True).mapInArrow(run, "a string, b string, ratio double")


def similar_roots(f: DataFrame, least: float = CONFIRMED, keys: int = KEYS) -> DataFrame:
    """(key, root): the keys in clusters of two or more that pairs of a ratio of at least `least` connect; root is one of the cluster.

    First what each block connects by itself, then each pair of blocks, where only what is not connected so far is compared: the pairs are
    not listed, of which dense clusters have as many as the square of their keys.
    """
    s = Scratch(f.sparkSession)
    k, n = _blocks(f, keys, CLUSTERED)

    def inside(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [*parts]:
            x = pa.Table.from_batches(held)
            parent, _ = ratios.linked(x["key"].to_pylist(), None, np.arange(len(x)), None, least)
            yield from x.append_column("root", x["key"].take(pa.array(parent))).to_batches()

    def across(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, side in _whole(parts):
            first = pa.array(side == 0)
            lab = x["root"].combine_chunks().dictionary_encode()
            of, keys = lab.indices.to_numpy(), x["key"]
            _, links = ratios.linked(keys.filter(first).to_pylist(), keys.filter(pa.array(side == 1)).to_pylist(), of[side == 0], of[side == 1], least)
            if links:
                yield pa.RecordBatch.from_arrays([lab.dictionary.take(pa.array(c)) for c in zip(*links)], ["a", "b"])

    own = s.write(k.mapInArrow(inside, "key string, own int, root string"))
    if n > 1:
        more = components.components(_units(own, n, False).mapInArrow(across, "a string, b string"))
        own = own.join(more.select(F.col("name").alias("root"), F.col("root").alias("above")), "root", "left").select("key", F.coalesce("above", "root").alias("root"))
    found = s.write(own.select("key", "root"))
    return found.join(found.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root"), "root").select("key", "root")


def contained_forms(f: DataFrame, shortest: int = 4) -> DataFrame:
    """(a, b): the pairs of different keys of which a, of `shortest` characters or more, lies within b. Only keys that have the rarest four characters of a are looked at.

    Spark takes the exploded characters to be as large as the keys, of which they have some twenty rows each: no side is left to be a broadcast.
    """
    four = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substring(c, i, F.lit(4))))
    g = f.filter(F.length("key") >= 4).select("key", F.explode(four(F.col("key"))).alias("gram"))
    count = g.groupBy("gram").agg(F.count("*").alias("df"))
    rare = g.filter(F.length("key") >= shortest).join(count.hint("merge"), "gram").groupBy("key").agg(F.min(F.struct("df", "gram")).alias("r")).select(F.col("key").alias("a"), F.col("r.gram").alias("gram"))
    return rare.join(g.withColumnRenamed("key", "b").hint("merge"), "gram").filter("a <> b and contains(b, a)").select("a", "b")


def entity_candidates(names: DataFrame, name: str = "name", least: float = LEXICAL) -> DataFrame:
    """(a, b), a < b: keys that may be one entity: alike by their ratio, or one within the other. Neither part has a pair twice, and those of both are left out of the second."""
    f = Scratch(names.sparkSession).write(forms(names, name))

    def others(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            yield x.filter(pa.array(~ratios.contained_alike(x["a"], x["b"], least)))

    inside = contained_forms(f).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return similar_forms(f, least, decide=True).select("a", "b").unionByName(inside.mapInArrow(others, "a string, b string"))


def entity_duplicates(names: DataFrame, name: str = "name", least: float = CONFIRMED) -> DataFrame:
    """(form, canonical): the members of each cluster of spellings of one entity; the canonical one is the shortest, then the smallest.

    Without a judge a pair is confirmed by its ratio alone.
    """
    f = Scratch(names.sparkSession).write(forms(names, name))
    c = similar_roots(f, least).join(f, "key")
    best = c.groupBy("root").agg(F.min(F.struct(F.length("form").alias("n"), "form")).alias("m"))
    return c.join(best.select("root", F.col("m.form").alias("canonical")), "root").select("form", "canonical")


def supported(phrase: Column, sentence: Column, stop: list[str]) -> Column:
    """Whether a sentence holds a phrase: as it is, else each of its words that is no stop word, in the singular or plural; null texts hold nothing."""
    split = lambda c: text.key_words(F.regexp_replace(c, "(?<!^)(?=[A-Z])", " "))
    p, q = split(phrase), split(sentence)
    said = F.split(q, " ")
    words = F.filter(F.split(p, " "), lambda w: (w != "") & ~w.isin(*stop))
    plural = lambda w: F.when(F.length(w) <= 3, w).when(w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(F.concat(w, F.lit("s")))
    each = F.forall(words, lambda w: F.array_contains(said, w) | F.array_contains(said, plural(w)))
    return F.coalesce((p != "") & (q != "") & (F.concat(F.lit(" "), q, F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" "))) | ((F.size(words) > 0) & each)), F.lit(False))


def quality_summary(triples: DataFrame, stop: list[str]) -> DataFrame:
    """One row: (total, hallucinated, unverified, entity_clusters, relation_duplicates) of the complete triples (subject, predicate, object, sentence).

    A triple is hallucinated if its sentence does not hold its subject and object, unverified if it has no sentence: a rule in place of a judge.
    """
    from graphloom.operators import preview

    t = triples.filter("subject <> '' and predicate <> '' and object <> ''")
    held = supported(F.col("subject"), F.col("sentence"), stop) & supported(F.col("object"), F.col("sentence"), stop)
    blank = F.coalesce(text.strip(F.col("sentence")), F.lit("")) == ""
    counts = t.agg(F.count("*").alias("total"), F.count_if(~blank & ~held).alias("hallucinated"), F.count_if(blank).alias("unverified"))
    clusters = entity_duplicates(t.select(F.explode(F.array("subject", "object")).alias("name"))).agg(F.countDistinct("canonical").alias("entity_clusters"))
    again = preview.relation_duplicates(t).agg(F.count("*").alias("relation_duplicates"))
    return counts.crossJoin(clusters).crossJoin(again)
