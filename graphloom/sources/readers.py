"""Sources and sinks of triples and documents."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text

# Phrases of the statement grammar, with the predicate that each states.
PHRASES = {
    "is subclass of": "IsSubclassOf",
    "is dimension of": "IsDimensionOf",
    "is threat to": "IsThreatTo",
    "contributes to": "ContributesTo",
    "applies to": "AppliesTo",
    "implements": "Implements",
    "is an": "IsAn",
    "is a": "IsA",
}


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): the lines that are not blank, without white space and end punctuation, numbered within their file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    parts = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: text.strip(x)), lambda x: x != "")
    return whole.select("path", F.posexplode(parts).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), F.regexp_replace("line", r"\p{Punct}+$", "").alias("line"))


def first_phrase(c: Column, phrases: dict[str, str], ignore_case: bool = True) -> Column:
    """struct(at, n, predicate) of the phrase that stands first as whole words, of several there the longest; null if there is none. at counts from 0."""
    found = []
    for k, (phrase, predicate) in enumerate(phrases.items()):
        rule = rf"{'(?i)' if ignore_case else ''}(?U)(?<!\w){re.escape(phrase)}(?!\w)"
        before = F.length(F.split(c, rule, 2)[0])
        found.append(F.struct(F.when(c.rlike(rule), before).alias("at"), F.lit(-len(phrase)).alias("n"), F.lit(k).alias("k"), F.lit(predicate).alias("predicate")))
    return F.array_min(F.filter(F.array(*found), lambda x: x["at"].isNotNull()))


def parse_statements(rows: DataFrame, line: str = "line", order: str | None = None) -> DataFrame:
    """(subject, predicate, object, sentence) of lines `<subject> <phrase> <object>`.

    The earliest phrase decides, of those the longest, whatever its case; blank lines, comments (#) and lines without a phrase or a name on
    either side give nothing; a triple given twice, case of its names aside, counts once (the first by `order`, else the smallest sentence).
    """
    c = text.strip(F.col(line))
    at = F.col(order) if order else F.lit(0)
    rows = rows.select(c.alias("sentence"), at.alias("nth")).filter("sentence <> '' and not startswith(sentence, '#')")
    rows = rows.withColumn("b", first_phrase(F.col("sentence"), PHRASES)).filter("b is not null")
    subject, obj = text.name(F.expr("substring(sentence, 1, b.at)")), text.name(F.expr("substring(sentence, b.at - b.n + 1)"))
    rows = rows.select(subject.alias("subject"), F.col("b.predicate").alias("predicate"), obj.alias("object"), "sentence", "nth").filter("subject <> '' and object <> ''")
    first = rows.groupBy(F.lower("subject").alias("ls"), "predicate", F.lower("object").alias("lo")).agg(F.min(F.struct("nth", "sentence", "subject", "object")).alias("f"))
    return first.select("f.subject", "predicate", "f.object", "f.sentence")


def csv_triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, sentence) of a `;` file with the header source;relationship;destination; incomplete rows are left out."""
    rows = spark.read.csv(path, sep=";", header=True, schema="source string, relationship string, destination string")
    t = rows.select(text.name(F.col("source")).alias("subject"), text.name(F.col("relationship")).alias("predicate"), text.name(F.col("destination")).alias("object")).filter("subject <> '' and predicate <> '' and object <> ''")
    return t.withColumn("sentence", F.concat_ws(" ", "subject", "predicate", "object"))


def json_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("subject string, predicate string, object string, sentence string").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def first_json_object(said: str | None) -> str | None:
    """The first balanced JSON object in a model's answer, code fences apart; null if there is none."""
    if said is None:
        return None
    said = re.sub(r"^\s*```\w*|```\s*$", "", said)
    start = said.find("{")
    while start >= 0:
        depth, quoted, k = 0, False, start
        while k < len(said):
            c = said[k]
            if quoted:
                k += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return said[start : k + 1]
            k += 1
        start = said.find("{", start + 1)
    return None


def read_source(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Rows of a source by its kind: TEXT (path, line_no, line), CHUNKS (path, nth, start_index, chunk) or PARAGRAPHS (path, idx, paragraph) of text files.

    PDF files need a parser, which this library does not have: they raise an error, as any other kind does.
    """
    from graphloom.operators import ingest

    if kind == "TEXT":
        return text_lines(spark, path)
    if kind in ("CHUNKS", "PARAGRAPHS"):
        whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
        return ingest.chunks(whole, "path", "text", **options) if kind == "CHUNKS" else ingest.paragraphs(whole, "path", "text")
    raise ValueError(f"no reader for {kind}")


def synonym_file(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """(keyword, synonyms) of a JSON object {keyword: [synonym, ...]}: keywords in normal form, synonyms distinct without case and without the keyword, at most `limit`; a malformed or missing file gives none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    empty = spark.createDataFrame([], "keyword string, synonyms array<string>")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    said = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("k", "v")).filter("v is not null")
    said = said.select(text.normal(F.col("k")).alias("keyword"), F.posexplode("v").alias("at", "s")).withColumn("s", text.name(F.col("s"))).filter("keyword <> '' and s <> '' and lower(s) <> keyword")
    first = said.groupBy("keyword", F.lower("s").alias("low")).agg(F.min(F.struct("at", "s")).alias("f"))
    return first.groupBy("keyword").agg(F.slice(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["s"]), 1, limit).alias("synonyms"))


def write_synonyms(df: DataFrame, path: str) -> None:
    """The small table (keyword, synonyms) as one JSON object with sorted keys, written aside and renamed."""
    spark = df.sparkSession
    rows = {r.keyword: [*r.synonyms] for r in df.orderBy("keyword").collect()}
    Path = spark._jvm.org.apache.hadoop.fs.Path
    at, aside = Path(path), Path(f"{path}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray((json.dumps(rows, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(aside, at)


def keyword_lines(spark: SparkSession, path: str) -> DataFrame:
    """(keyword) of a list of one keyword a line: trimmed, blank lines left out."""
    return spark.read.text(path).select(text.strip(F.col("value")).alias("keyword")).filter("keyword <> ''")


def articles(spark: SparkSession, path: str, fields: tuple[str, ...] = ("id", "topic", "essay", "facts", "source")) -> DataFrame:
    """(ordinal, fields) of a cached data set of articles in JSON lines, numbered in the order of their first field from 0; missing fields are null."""
    from graphloom.operators.retrieval import batches

    rows = spark.read.schema(", ".join(f"`{f}` string" for f in fields)).json(path)
    return rows.join(batches(rows, fields[0], 1).withColumnRenamed("batch", "ordinal"), fields[0]).select("ordinal", *fields)


def write_stage(df: DataFrame, folder: str, stage: str) -> str:
    """The payload of a stage as JSON lines under folder/stage; the path."""
    at = f"{folder}/{stage}"
    df.write.mode("overwrite").json(at)
    return at


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report for download, as CSV with a header or as JSON lines."""
    writer = df.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)
