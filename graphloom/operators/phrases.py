"""Phrases of texts: entities by stop words, keyphrases by their nearness to the text, and the keyword cascade over them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text
from graphloom.operators import encoder

# What a word of an entity and of a schema key is.
ENTITY_WORD, KEY_WORD = r"[A-Za-z][A-Za-z0-9_+#.-]*", r"[a-z0-9+#.-]+"
_ENTITY_WORD, _KEY_WORD, _TERM = re.compile(ENTITY_WORD), re.compile(KEY_WORD), re.compile(r"\b\w\w+\b")
TRIM = " .,:;()[]{}\"'"


def stop_words() -> frozenset[str]:
    """Spark's English stop words; every function takes another list."""
    return frozenset(StopWordsRemover.loadDefaultStopWords("english"))


def schema_key(said: str) -> str:
    return " ".join(_KEY_WORD.findall(said.replace("_", " ").lower()))


def entity_key(said: str) -> str:
    return " ".join(said.replace("_", " ").lower().split())


def runs(said: str, stop: frozenset[str], key=entity_key) -> list[list[str]]:
    """The words between stop words."""
    out: list[list[str]] = [[]]
    for word in (w.replace("_", " ") for w in _ENTITY_WORD.findall(said)):
        if key(word) in stop:
            out.append([])
        else:
            out[-1].append(word)
    return [r for r in out if r]


def _spans(run: list[str], sizes: tuple[int, ...]) -> Iterator[str]:
    """The whole run if it is short, then its spans of each size."""
    if 1 < len(run) <= 5:
        yield " ".join(run)
    for n in sizes:
        for at in range(len(run) - n + 1):
            yield " ".join(run[at : at + n])


def distinct_phrases(phrases: Iterator[str], stop: frozenset[str], most: int, least: int, key=entity_key, numbers: bool = False) -> list[str]:
    """The first `most` phrases that differ in their key, which has `least` characters or more and is no stop word; numbers only if wanted."""
    out: dict[str, str] = {}
    for p in phrases:
        p = " ".join(p.replace("_", " ").strip(TRIM).split())
        k = key(p)
        if len(k) >= least and k not in stop and k not in out and (numbers or not k.replace(".", "").isdigit()):
            out[k] = p
            if len(out) >= most:
                break
    return [*out.values()]


def entities(said: str | None, stop: frozenset[str], most: int = 8, least: int = 3) -> list[str]:
    """Candidate entities: of each run the whole, trigrams, bigrams and words, in this order; none for a null or blank text."""
    return distinct_phrases((p for r in runs(said or "", stop) for p in _spans(r, (3, 2, 1))), stop, most, least)


def schema_entities(said: str | None, stop: frozenset[str], most: int = 10) -> list[str]:
    """As entities, by the key of a schema, numbers included."""
    return distinct_phrases((p for r in runs(said or "", stop, schema_key) for p in _spans(r, (3, 2, 1))), stop, most, 3, schema_key, True)


def keyphrases(texts: list[str | None], stop: frozenset[str], top: int = 5, longest: int = 3) -> list[list[tuple[str, float]]]:
    """For each text its `top` phrases of one to `longest` terms without stop words, by the cosine of their vectors with the text's, ties by phrase."""
    out = []
    for said in texts:
        terms = [t for t in _TERM.findall((said or "").lower()) if t not in stop]
        found = sorted({" ".join(terms[i : i + n]) for n in range(1, longest + 1) for i in range(len(terms) - n + 1)})
        if not found:
            out.append([])
            continue
        v = encoder.vectors([entity_key(said or ""), *found]).astype(np.float64)
        size = np.linalg.norm(v, axis=1)
        cos = np.round(v[1:] @ v[0] / np.where(size[1:] * size[0] > 0, size[1:] * size[0], 1), 6)
        best = np.lexsort((np.arange(len(found)), -cos))[:top]
        out.append([(found[i], float(cos[i])) for i in best])
    return out


def entity_lists(c: Column, most: int = 8, stop: frozenset[str] | None = None) -> Column:
    """array<string> of entities(c)."""
    words = stop_words() if stop is None else stop
    return F.pandas_udf(lambda s: s.map(lambda x: entities(x, words, most)), T.ArrayType(T.StringType()))(c)


def keyphrase_lists(c: Column, top: int = 5, stop: frozenset[str] | None = None) -> Column:
    """array<struct<phrase, score>> of keyphrases(c)."""
    words = stop_words() if stop is None else stop
    kind = T.ArrayType(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("score", T.DoubleType())]))
    return F.pandas_udf(lambda s: pd.Series([[{"phrase": p, "score": v} for p, v in x] for x in keyphrases([*s], words, top)], index=s.index), kind)(c)


#: Least cosine of a text and of a keyphrase with the keyword.
NEAR_TEXT, NEAR_PHRASE = 0.45, 0.65


def keyword_cascade(rows: DataFrame, body: str, keyword: str, synonyms: list[str], top: int = 5, stop: frozenset[str] | None = None) -> DataFrame:
    """Adds keywords, match_type, matched_terms and score to the rows, by the first of five steps that fits, else a null match_type.

    exact and synonym: the keyword, else synonyms, as whole words of the text; exact and synonym again: as a keyphrase of the
    text; near_paragraph_global: the text's vector; near_paragraph_keywords: that of a keyphrase. Keyphrases are worked out only for rows
    that the first two steps leave. The score of every row is the cosine of its text. A null or blank text matches nothing.
    """
    words = stop_words() if stop is None else stop
    low = [" ".join(t.lower().split()) for t in (keyword, *synonyms)]
    literal = F.array_compact(F.array(*(F.when(text.has_word(F.col(body), t), F.lit(t)) for t in low[1:]))) if synonyms else F.array().cast("array<string>")
    rows = rows.withColumns({"__own": text.has_word(F.col(body), low[0]), "__syn": literal})
    kind = T.StructType([T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType()), T.StructField("best", T.DoubleType())])

    def near(said: pd.Series, settled: pd.Series) -> pd.DataFrame:
        target = encoder.vectors([entity_key(keyword)])[0].astype(np.float64)
        target /= np.linalg.norm(target) or 1

        def cosines(keys: list[str]) -> np.ndarray:
            v = encoder.vectors(keys).astype(np.float64)
            size = np.linalg.norm(v, axis=1)
            return np.round(v @ target / np.where(size > 0, size, 1), 6)

        found = iter(keyphrases([x for x, s in zip(said, settled) if not s], words, top))
        lists = [[] if s else [p for p, _ in next(found)] for s in settled]
        best = [float(cosines([entity_key(p) for p in x]).max()) if x else None for x in lists]
        return pd.DataFrame({"keywords": lists, "score": cosines([entity_key(x or "") for x in said]), "best": best}, index=said.index)

    rows = rows.withColumn("__near", F.pandas_udf(near, kind)(F.col(body), F.col("__own") | (F.size("__syn") > 0)))
    as_phrase = F.array_sort(F.array_intersect(F.array(*(F.lit(t) for t in low[1:])) if synonyms else F.array().cast("array<string>"), F.col("__near.keywords")))
    own_phrase = F.array_contains("__near.keywords", low[0])
    none = F.array().cast("array<string>")
    match = F.when(F.col("__own") | ((F.size("__syn") == 0) & own_phrase), "exact").when((F.size("__syn") > 0) | (F.size(as_phrase) > 0), "synonym").when(F.col("__near.score") >= NEAR_TEXT, "near_paragraph_global").when(F.col("__near.best") >= NEAR_PHRASE, "near_paragraph_keywords")
    terms = F.when(match == "exact", F.array(F.lit(low[0]))).when(F.size("__syn") > 0, F.col("__syn")).when(match == "synonym", as_phrase).otherwise(none)
    out = rows.withColumns({"keywords": F.col("__near.keywords"), "match_type": F.when(~text.strip(F.coalesce(F.col(body), F.lit(""))).eqNullSafe(""), match), "matched_terms": terms, "score": F.col("__near.score")})
    return out.drop("__own", "__syn", "__near")


def synonyms(word: str, cached: dict[str, list[str]], curated: dict[str, list[str]], limit: int = 10) -> list[str]:
    """Up to `limit` other forms of a keyword: cached ones, else curated ones, else by its ending; distinct, without the word itself."""
    key = " ".join(word.lower().split())
    for found in (cached.get(key), curated.get(key), by_ending(key)):
        kept = distinct_terms(found or [], key, limit)
        if kept:
            return kept
    return []


def by_ending(word: str) -> list[str]:
    for ending, others in text.SUFFIXES.items():
        if word.endswith(ending):
            return [word[: len(word) - len(ending)] + o for o in others]
    return []


def distinct_terms(terms: list, word: str, limit: int) -> list[str]:
    out: dict[str, str] = {}
    for t in terms:
        t = " ".join(str(t or "").split())
        if t and t.lower() != word and t.lower() not in out and len(out) < limit:
            out[t.lower()] = t
    return [*out.values()]
