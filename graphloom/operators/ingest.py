"""Operators that lead from texts to triples: paragraphs, keyword gate, chunk cleaning, coercions, increments."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text

# Headings that open a list of references.
REFERENCE_HEADINGS = (
    "references",
    "reference",
    "bibliography",
    "works cited",
    "literature cited",
    "cited literature",
    "references and notes",
    "notes and references",
    "reference list",
    "bibliographical references",
)
# What may number a heading.
SECTION_PREFIX = r"(?i)^\s*(?:(?:section|chapter)\s+)?(?:(?:\d+(?:\.\d+)*)|(?:[ivxlcdm]+)|(?:[a-z]))(?:[.):\-])?\s+"


def paragraphs(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, idx, paragraph): the texts cut at blank lines, blank parts left out, idx from 0; a null text has none."""
    parts = F.filter(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n[ \t]*\n+"), lambda p: text.strip(p) != "")
    return docs.select(key, F.posexplode(parts).alias("idx", "paragraph"))


def lines(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, idx, line): the lines that are not blank, trimmed, numbered from 0."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n"), lambda p: text.strip(p)), lambda p: p != "")
    return docs.select(key, F.posexplode(parts).alias("idx", "line"))


def heading_key(c):
    """A heading in lower case without markers, section number and marks at its ends, `&` as and."""
    c = text.strip(F.regexp_replace(text.strip(c), "^[#*•\\-–— ]+", ""))
    c = F.regexp_replace(text.strip(F.regexp_replace(c, SECTION_PREFIX, "")), r"^[ .:;,\-–—()\[\]{}]+|[ .:;,\-–—()\[\]{}]+$", "")
    return F.lower(text.name(F.replace(c, F.lit("&"), F.lit(" and "))))


def cut_references(parts: DataFrame, key: str = "doc_id", idx: str = "idx", body: str = "paragraph") -> DataFrame:
    """Paragraphs before the first whose short first line is a reference heading, at index max(5, 45 % of the paragraphs) or later."""
    first = F.split(F.trim(F.col(body)), "\n")[0]
    head = F.when((F.length(first) <= 90) & heading_key(first).isin(*REFERENCE_HEADINGS), F.col(idx))
    # The size and the trigger of a document are small aggregates; the paragraphs themselves are not gathered.
    n = parts.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(head)).alias("heads"))
    cut = n.select(key, F.expr("get(filter(heads, h -> h >= greatest(5, cast(ceil(0.45 * n) as int))), 0)").alias("cut"))
    return parts.join(cut, key).filter(f"cut is null or {idx} < cut").select(key, idx, body)


# Lines that are no text: identifiers, numbered lines, addresses and bare numbers.
NOISE = (r"(?i)doi:\s*\d+\.\d+/\S+", r"^\d+[:.]", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"^\s*\d+\s*$")


def clean_chunk(c):
    """A chunk without the lines of NOISE, its lines collapsed and joined by one space; null gives an empty text."""
    kept = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: ~reduce(lambda a, b: a | b, (x.rlike(rule) for rule in NOISE)))
    return F.array_join(F.filter(F.transform(kept, text.name), lambda x: x != ""), " ")


#: Where a chunk may end, the strongest first: between paragraphs, lines, words.
SEPARATORS = ("\n\n", "\n", " ")


def cut_points(said: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most `size` characters: each ends at the last strongest separator in its latter half, else anywhere; the next begins `overlap` characters before, after a white space if one is there."""
    out, start = [], 0
    while start < len(said):
        end = min(len(said), start + size)
        if end < len(said):
            for sep in SEPARATORS:
                at = said.rfind(sep, start + size // 2, end)
                if at > 0:
                    end = at + len(sep)
                    break
        out.append((start, end))
        if end == len(said):
            break
        back = max(start + 1, end - overlap)
        space = said.find(" ", back, end)
        start = space + 1 if 0 <= space < end - 1 else max(back, start + 1)
    return out


def chunks(docs: DataFrame, key: str = "doc_id", body: str = "text", size: int = 700, overlap: int = 70) -> DataFrame:
    """(key, nth, start_index, chunk) of the texts: overlapping chunks that cover all of them, those of white space alone left out; a null text has none."""
    kind = T.ArrayType(T.StructType([T.StructField("start_index", T.IntegerType()), T.StructField("chunk", T.StringType())]))

    def run(said: pd.Series) -> pd.Series:
        return said.map(lambda x: [{"start_index": a, "chunk": x[a:b]} for a, b in cut_points(x, size, overlap) if x[a:b].strip()] if x else [])

    return docs.select(key, F.posexplode(F.pandas_udf(run, kind)(F.col(body))).alias("nth", "c")).select(key, "nth", "c.*")


def keyword_gate(parts: DataFrame, body: str, keyword: str, synonyms: list[str], score: str, at_least: float = 0.45) -> DataFrame:
    """Adds match: exact (the keyword as whole words), synonym, near_paragraph_global (score at least `at_least`), else unmatched."""
    syn = F.lit(False)
    for s in synonyms:
        syn = syn | text.has_word(F.col(body), s)
    return parts.withColumn("match", F.when(text.has_word(F.col(body), keyword), "exact").when(syn, "synonym").when(F.col(score) >= at_least, "near_paragraph_global").otherwise("unmatched"))


def paragraph_relevance(matches: DataFrame) -> DataFrame:
    """(doc_id, para_index, max_score, literal, terms): best score, whether any match was literal, and the distinct terms of each paragraph."""
    g = matches.groupBy("doc_id", "para_index").agg(F.max("cosine_sim_score").alias("max_score"), F.max(F.coalesce(F.col("match_type").isin("exact", "synonym"), F.lit(False))).alias("literal"))
    t = matches.select("doc_id", "para_index", F.explode("matched_terms").alias("term")).filter("term is not null").distinct().groupBy("doc_id", "para_index").agg(F.array_join(F.array_sort(F.collect_list("term")), "|").alias("terms"))
    return g.join(t, ["doc_id", "para_index"], "left").select("doc_id", "para_index", "max_score", "literal", F.coalesce("terms", F.lit("")).alias("terms"))


def newly_included(relevance: DataFrame, done: DataFrame, threshold: float) -> DataFrame:
    """Paragraphs not yet processed, not literal, with a score of at least the threshold."""
    return relevance.filter(~F.col("literal") & (F.col("max_score") >= threshold)).join(done.select("doc_id", "para_index").distinct(), ["doc_id", "para_index"], "left_anti")


def coerce_novelty(results: DataFrame) -> DataFrame:
    """(result_id, decision, confidence, n_spans): the decision of a model's answer in its domain.

    Case, spacing and separators are undone; anything off the list is PARTIALLY_NEW; EXISTING with a span is PARTIALLY_NEW; a missing
    confidence is 0.5 and others are held within 0 and 1; null and blank spans don't count.
    """
    d = F.regexp_replace(F.upper(text.strip(F.col("decision"))), "[ -]+", "_")
    spans = F.coalesce(F.size(F.filter("novel_spans", lambda s: s.isNotNull() & (text.strip(s) != ""))), F.lit(0))
    known = F.when(d.isin(*text.DECISIONS), d).otherwise("PARTIALLY_NEW")
    spans = F.greatest(spans, F.lit(0))
    return results.select("result_id", F.when((known == "EXISTING") & (spans > 0), "PARTIALLY_NEW").otherwise(known).alias("decision"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))).alias("confidence"), spans.alias("n_spans"))


def coerce_triples(triples: DataFrame, vocabulary: DataFrame, relaxed: bool = True) -> DataFrame:
    """(triple_id, subject, predicate, object, non_standard, modality): trimmed complete triples.

    A predicate outside the vocabulary (one column, canonical), whatever its case, is kept and marked if relaxed, else its triple is dropped.
    """
    t = triples.select("triple_id", *(text.strip(F.col(c)).alias(c) for c in ("subject", "predicate", "object"))).filter("subject <> '' and predicate <> '' and object <> ''")
    v = vocabulary.select(F.lower("canonical").alias("low")).distinct().withColumn("std", F.lit(True))
    t = t.withColumn("low", F.lower("predicate")).join(v, "low", "left" if relaxed else "inner")
    mod = F.coalesce(*(F.when(F.col("low") == k, m) for k, m in text.MODALITY_OF.items()))
    return t.select("triple_id", "subject", "predicate", "object", F.col("std").isNull().alias("non_standard"), mod.alias("modality"))


def first_by(rows: DataFrame, key, order: str, *cols: str) -> DataFrame:
    """The first row by `order` for each value of the key expression; null keys are left out."""
    return rows.withColumn("__k", key).filter("__k is not null").groupBy("__k").agg(F.min(F.struct(order, *cols)).alias("f")).select("f.*")


def flatten_graph(triples: DataFrame) -> DataFrame:
    """(kind, value): distinct entities, predicates and relations in lower case."""
    t = triples.filter("subject rlike '(?U)\\\\S' and predicate rlike '(?U)\\\\S' and object rlike '(?U)\\\\S'").select(*(F.lower(text.strip(F.col(c))).alias(c) for c in ("subject", "predicate", "object")))
    rows = t.select(F.explode(F.array(F.struct(F.lit("entity").alias("kind"), F.col("subject").alias("value")), *(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("entity", F.col("object")), ("edge", F.col("predicate")), ("relation", F.concat_ws(" | ", "subject", "predicate", "object")))))).alias("x"))
    return rows.select("x.*").distinct()
