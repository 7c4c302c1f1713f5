"""What a review of extracted knowledge needs: relations from triples, cleaned provenance, alignment of answers, orders of its sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import retrieval
from graphloom.session import Scratch, unique_join

# Known strengths of an obligation, and the order of the preview's categories.
MODALITIES = ("MANDATORY", "RECOMMENDED", "OPTIONAL", "PROHIBITED")
CATEGORIES = ("CONFLICT", "TENSION", "RELATED", "NEW", "EXISTING")
#: Characters of an excerpt that are kept.
EXCERPT = 500


def nonblank(rows: DataFrame, body: str, required: bool = False) -> DataFrame:
    """Rows whose text is not null or blank; if required, an error where there is none."""
    out = rows.filter(F.coalesce(text.strip(F.col(body)), F.lit("")) != "")
    if required and out.isEmpty():
        raise ValueError(f"no row has a {body}")
    return out


def raise_if_all_failed(rows: DataFrame, failed: str) -> None:
    """An error if there are rows and all of them failed: that is a fault of the service and no empty result."""
    n, bad = rows.agg(F.count("*"), F.count_if(F.coalesce(F.col(failed), F.lit(True)))).first()
    if n and n == bad:
        raise RuntimeError(f"all {n} batches failed")


def relations(triples: DataFrame, key: str, knowledge_type: str | None = None) -> DataFrame:
    """(key, chunk_index, source, predicate, target, sentence, knowledge_type) of complete triples with a safe predicate; chunk_index counts them by key from 0."""
    t = triples.select(key, text.name(F.col("subject")).alias("source"), text.relationship_type(F.col("predicate")).alias("predicate"), text.name(F.col("object")).alias("target"), "sentence")
    t = Scratch(triples.sparkSession).write(t.filter("source <> '' and target <> '' and predicate is not null"))
    nth = retrieval.batches(t, key, 1).withColumnRenamed("batch", "chunk_index")
    return t.join(nth, key).select(key, "chunk_index", "source", "predicate", "target", "sentence", F.lit(knowledge_type).cast("string").alias("knowledge_type"))


def upsert_summary(rows: DataFrame) -> DataFrame:
    """One row: (attempted, succeeded, failed) of edges (source, predicate, target): those with both names and a safe predicate are stored."""
    ok = (text.name(F.coalesce("source", F.lit(""))) != "") & (text.name(F.coalesce("target", F.lit(""))) != "") & text.relationship_type(F.col("predicate")).isNotNull()
    return rows.agg(F.count("*").alias("attempted"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def request_check(triples: DataFrame, request: str) -> DataFrame:
    """(request, n_triples, n_malformed, rejected): malformed triples are dropped, but one whole triple without a safe predicate rejects its request."""
    whole = F.lit(True)
    for c in ("subject", "predicate", "object"):
        whole &= F.coalesce(text.strip(F.col(c)), F.lit("")) != ""
    unsafe = whole & text.relationship_type(F.col("predicate")).isNull()
    return triples.groupBy(request).agg(F.count("*").alias("n_triples"), F.count_if(~whole).alias("n_malformed"), (F.count_if(unsafe) > 0).alias("rejected"))


def clean_provenance(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc, quality, chunk_index, chunk_excerpt, modality) of records: trimmed, the excerpt cut, unknown modalities ''; records that say nothing are left out."""
    blank = lambda c: F.coalesce(text.strip(F.col(c)), F.lit(""))
    m = F.upper(blank("modality"))
    out = rows.select(*keys, blank("doc").alias("doc"), blank("quality").alias("quality"), "chunk_index", F.substring(blank("chunk_excerpt"), 1, EXCERPT).alias("chunk_excerpt"), F.when(m.isin(*MODALITIES), m).otherwise("").alias("modality"))
    return out.filter("doc <> '' or quality <> '' or chunk_index is not null or chunk_excerpt <> '' or modality <> ''")


def containing(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows of which any column contains the needle, case aside; a null contains nothing."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return rows.filter(hit)


def first_context(qualities: DataFrame, quality: str, contexts: DataFrame, context: str, order: str, *cols: str) -> DataFrame:
    """The qualities with the columns of the first context of the same trimmed text, nulls where there is none; blank texts have none."""
    key = text.text_or_null(F.col(context))
    first = contexts.select(key.alias("__t"), F.struct(order, *cols).alias("c")).filter("__t is not null").groupBy("__t").agg(F.min("c").alias("c")).select("__t", *(F.col(f"c.{c}").alias(c) for c in cols))
    return unique_join(qualities.withColumn("__t", text.text_or_null(F.col(quality))), first, "__t", "left").drop("__t")


def align(inputs: DataFrame, key: str, answers: DataFrame, answer_key: str, order: str, value: str) -> DataFrame:
    """(key, value, reason): the first answer to each input by id; an input without one has a reason instead."""
    first = answers.filter(F.col(answer_key).isNotNull()).groupBy(F.col(answer_key).alias(key)).agg(F.min(F.struct(order, value)).alias("a"))
    j = inputs.select(key).join(first, key, "left")
    return j.select(key, F.col(f"a.{value}").alias(value), F.when(F.col("a").isNull(), "Missing in the answer.").alias("reason"))


def verdicts(found: DataFrame) -> DataFrame:
    """(conflict_id, verdict): a rule in place of a judge. A prohibition against a duty or a permission contradicts; other strengths are a tension; the rest is UNJUDGED."""
    duty = lambda c: F.col(c).isin("MANDATORY", "OPTIONAL")
    modal = F.col("type") == "MODALITY_CONFLICT"
    known = F.col("side_a").isin(*MODALITIES) & F.col("side_b").isin(*MODALITIES)
    against = ((F.col("side_a") == "PROHIBITED") & duty("side_b")) | ((F.col("side_b") == "PROHIBITED") & duty("side_a"))
    return found.select("conflict_id", F.when(modal & against, "CONTRADICT").when(modal & known, "TENSION").otherwise("UNJUDGED").alias("verdict"))


def novelty_band(score: Column) -> Column:
    """A rule in place of a judge: EXISTING from 0.9 on, PARTIALLY_NEW from 0.6 on, else NEW; a missing score is NEW."""
    return F.when(score >= 0.9, "EXISTING").when(score >= 0.6, "PARTIALLY_NEW").otherwise("NEW")


def decompose(c: Column) -> Column:
    """A rule in place of a model: the sentences of a text, cut after `.`, `!` or `?` before white space, as an array; none for a null or blank text."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"([.!?])[ \t\r\n]+", "$1\x1f"), "\x1f")
    return F.filter(F.transform(parts, lambda p: text.name(p)), lambda p: p != "")


def extend(relevance: DataFrame, done: DataFrame, threshold: float, bodies: DataFrame, existing: DataFrame) -> DataFrame:
    """(doc_id, para_index, quality): what a lowered threshold adds: the qualities of the paragraphs newly included that are not yet known.

    bodies has (doc_id, para_index, paragraph), existing (quality). A quality counts once, at its first paragraph; doing it again with the result among
    the existing ones gives nothing.
    """
    from graphloom.operators import ingest

    new = ingest.newly_included(relevance, done, threshold).select("doc_id", "para_index")
    said = bodies.join(new, ["doc_id", "para_index"], "left_semi").select("doc_id", "para_index", F.explode(decompose(F.col("paragraph"))).alias("quality"))
    first = said.groupBy("quality").agg(F.min(F.struct("doc_id", "para_index")).alias("f"))
    known = existing.select(text.name(F.col("quality")).alias("quality")).filter("quality <> ''").distinct()
    return first.join(known, "quality", "left_anti").select("f.doc_id", "f.para_index", "quality")


def distinct_reviews(results: DataFrame) -> DataFrame:
    """(result_id, decision, quality) to be reviewed: the first by result_id of each decision, quality, document and neighbour, case aside; decisions off the list and blank qualities are left out."""
    d = F.upper(text.strip(F.coalesce("decision", F.lit(""))))
    q = text.strip(F.coalesce("quality", F.lit("")))
    rows = results.select("result_id", d.alias("decision"), q.alias("quality"), F.coalesce("doc", F.lit("")).alias("doc"), F.lower(text.strip(F.coalesce("matched_neighbor_sentence", F.lit("")))).alias("near"))
    rows = rows.filter(F.col("decision").isin(*text.DECISIONS) & (F.col("quality") != ""))
    first = rows.groupBy("decision", F.lower("quality").alias("low"), "doc", "near").agg(F.min(F.struct("result_id", "quality")).alias("f"))
    return first.select("f.result_id", "decision", "f.quality")


def flagged(checks: list[tuple[str, DataFrame]], most: int = 50) -> DataFrame:
    """(check, label, reason, flagged_total): the first `most` findings of each check by label and reason, and how many there are; each of the frames has (label, reason)."""
    out = None
    for name, found in checks:
        total = found.agg(F.count("*").alias("flagged_total"))
        part = found.orderBy("label", "reason").limit(most).crossJoin(F.broadcast(total)).select(F.lit(name).alias("check"), "label", "reason", "flagged_total")
        out = part if out is None else out.unionByName(part)
    return out


def guarded(checks: dict) -> DataFrame:
    """The rows of the checks, each called on its own: one that raises an error gives a failed row with the error, and the others go on."""
    from graphloom.operators import verify

    rows, errors = [], []
    for name, check in checks.items():
        try:
            rows.append((name, *check().first()[1:], None))
        except Exception as e:  # noqa: BLE001 - a failed check must not end the others
            errors.append((name, None, None, None, False, f"{type(e).__name__}: {e}"[:200]))
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    out = spark.createDataFrame([*rows, *errors], "check string, bad long, total long, score double, passed boolean, error string")
    assert set(checks) <= set(verify.THRESHOLDS)
    return out


def predicate_options(vocabulary: DataFrame, families: list[str], custom: list[str], excluded: list[str]) -> DataFrame:
    """(nth, predicate): the predicates of the families in their order, then the custom ones, each once, without the excluded ones, whose case does not matter."""
    v = vocabulary.select(F.array_position(F.array(*(F.lit(f) for f in families)), F.lower("family")).alias("f"), "pred_id", F.col("canonical").alias("predicate")).filter("f > 0")
    extra = vocabulary.sparkSession.createDataFrame([(len(families) + 1, i, c.strip()) for i, c in enumerate(custom) if c.strip()], "f long, pred_id int, predicate string")
    rows = v.unionByName(extra).groupBy("predicate").agg(F.min(F.struct("f", "pred_id")).alias("at"))
    rows = rows.filter(~F.lower("predicate").isin(*(x.strip().lower() for x in excluded)))
    return rows.selectExpr("row_number() over (order by at) as nth", "predicate")  # as many rows as the vocabulary has


def mmr(top: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 4, weight: float = 0.5) -> DataFrame:
    """(query_id, nth, row_id): of each query's candidates (query_id, row_id, cos), one after the other the one of the highest weight * cos - (1 - weight) * its highest cosine with those taken.

    Ties go to the smaller row. vectors has the rows' own; a group holds no more than the candidates of one query.
    """
    import numpy as np
    import pandas as pd

    v = vectors.select(F.col(key).alias("row_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = unique_join(top.select("query_id", "row_id", "cos"), v, "row_id")
    kinds = {c: t for c, t in rows.dtypes}

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_id").reset_index(drop=True)
        x = np.stack(g["v"].to_list())
        x = x / np.linalg.norm(x, axis=1)[:, None]
        own, taken = g["cos"].to_numpy(), []
        while len(taken) < min(k, len(g)):
            near = (x @ x[taken].T).max(1) if taken else np.zeros(len(g))
            score = np.round(weight * own - (1 - weight) * near, 9)
            score[taken] = -np.inf
            taken.append(int(score.argmax()))
        return pd.DataFrame({"query_id": g["query_id"].iloc[0], "nth": np.arange(1, len(taken) + 1), "row_id": g["row_id"].iloc[taken].to_numpy()})

    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, nth int, row_id {kinds['row_id']}")
