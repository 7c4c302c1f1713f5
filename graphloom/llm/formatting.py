"""Records that differ only in white space, case, punctuation or field order, collapsed with their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import Scratch, hot_keys, unique_join

FIELDS = ("subject", "predicate", "object")


def canonical(c: Column) -> Column:
    """Only letters and digits, case folded; null counts as empty."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", "")
    # Letters whose case forms differ in number or place in a word.
    return F.replace(F.replace(F.lower(F.upper(kept)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def read_fields(df: DataFrame, raw: str | None, fields: tuple[str, ...]) -> DataFrame:
    """The fields, read from the JSON object in `raw` where they are all null; a raw text that is no object counts as the first field."""
    if raw is None:
        return df
    said = F.from_json(F.col(raw), ", ".join(f"`{f}` string" for f in fields))
    unset = F.lit(True)
    for f in fields:
        unset &= F.col(f).isNull()
    use = unset & F.col(raw).isNotNull()
    lost = F.get_json_object(F.col(raw), "$").isNull() | ~F.ltrim(raw).startswith("{")
    return df.withColumns({f: F.when(use & lost, F.col(raw) if k == 0 else F.lit(None).cast("string")).when(use, said[f]).otherwise(F.col(f)) for k, f in enumerate(fields)})


def spellings(df: DataFrame, key: str, raw: str | None, fields: tuple[str, ...]) -> DataFrame:
    """One row for each byte-identical raw row, with its smallest key, its count and its canonical fields; only these survivors are parsed."""
    said = [*fields, *([raw] if raw else [])]
    rows = df.select(F.col(key).alias("__id"), *said).groupBy(*said).agg(F.min("__id").alias("first"), F.count("*").alias("n"))
    return read_fields(rows.withColumn("spelt", _spelt(said)), raw, fields).select("spelt", "first", "n", *(canonical(F.col(f)).alias(f) for f in fields))


def _spelt(said: list[str]) -> Column:
    """128 bits of a raw row; lengths come first, so that no two rows are written alike."""
    return F.unhex(F.md5(F.concat_ws("|", *(F.coalesce(F.length(c), F.lit(-1)).cast("string") for c in said), *said)))


def groups(df: DataFrame, key: str, raw: str | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row for each distinct record: (canon_key, keep_id, copies, variants, field_1, field_2, ...).

    Byte-identical raw rows are collapsed first, with counts; only the distinct survivors are parsed and
    canonicalised, and grouped again on their whole canonical text with the counts summed. Both steps
    combine before they shuffle, so that a record with very many copies is no hot group. keep_id is the
    smallest key, copies the number of rows, variants that of byte-different spellings. Null fields count as
    empty, a record of nulls only is a record like any other; null keys are never the smallest unless
    all are null. Repeated rows count. An empty table gives an empty result; other columns play no part.
    """
    return _collapse(spellings(df, key, raw, fields), fields)


def _collapse(survivors: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    out = survivors.groupBy(*fields).agg(F.min("first").alias("keep_id"), F.sum("n").alias("copies"), F.count("*").alias("variants"))
    return out.select(_key(fields).alias("canon_key"), "keep_id", "copies", "variants", *fields)


def _key(fields: tuple[str, ...]) -> Column:
    """The canonical fields as one text; the separator is no letter or digit, so different records differ."""
    return F.concat_ws("|", *(F.col(f) for f in fields))


def copies(df: DataFrame, key: str, raw: str | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(keep_id, copy_id) for each row that is not the first of its group; see groups.

    A row finds its byte-identical spelling, and this the canonical group: no row is parsed but the survivors. Spellings and groups
    that hold a large share of the rows are joined by broadcast of these few keys.
    """
    s = Scratch(df.sparkSession)
    survivors = s.write(spellings(df, key, raw, fields).select("spelt", "first", "n", _key(fields).alias("canon_key")))
    many = survivors.groupBy("canon_key").agg(F.min("first").alias("keep_id"), F.sum("n").alias("copies"), F.count("*").alias("variants"))
    many = s.write(many.filter("copies > 1"))
    member = unique_join(survivors.select("spelt", "n", "canon_key"), many.select("canon_key", "keep_id"), "canon_key", hot=hot_keys(many, "canon_key", "variants"))
    said = [*fields, *([raw] if raw else [])]
    rows = df.select(F.col(key).alias("copy_id"), _spelt(said).alias("spelt"))
    out = unique_join(rows, member.select("spelt", "keep_id"), "spelt", hot=hot_keys(survivors, "spelt", "n"))
    return out.filter("copy_id > keep_id").select("keep_id", "copy_id").distinct()
