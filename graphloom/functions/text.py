"""Scalar functions on names, predicates and texts, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that stand for a missing node.
PLACEHOLDER_NAMES = ("", "n/a", "na", "none", "null", "nil", "unknown", "?", "-", "—", "…", "⌀", "tbd")
# Wording that leaves an obligation vague.
VAGUE_TERMS = (
    "appropriate",
    "adequate",
    "sufficient",
    "reasonable",
    "as far as possible",
    "where applicable",
    "where appropriate",
    "if necessary",
    "as needed",
    "state of the art",
    "best effort",
    "in a timely manner",
    "to the extent possible",
    "suitable",
    "acceptable",
    "relevant",
)
# Obligation strength by predicate, the strongest first in PRIORITY.
MODALITY_OF = {"requires": "MANDATORY", "recommends": "RECOMMENDED", "permits": "OPTIONAL", "prohibits": "PROHIBITED"}
PRIORITY = ("PROHIBITED", "MANDATORY", "RECOMMENDED", "OPTIONAL")
NORMATIVE = ("requires", "recommends", "permits", "prohibits")
DEFINING = ("defines", "with_description", "with_long_description")
POSITIVE, NEGATIVE = ("requires", "recommends", "permits"), ("prohibits",)
PREVIEW_POSITIVE = (*POSITIVE, "ensures", "should_ensure")
DECISIONS = ("EXISTING", "PARTIALLY_NEW", "NEW")
# Names that stand for a dimension, in lower case.
DIMENSION_ALIASES = {
    "interpretability": "Explainability",
    "explicability": "Explainability",
    "explainable ai": "Explainability",
    "explainability": "Explainability",
    "transparency": "Transparency",
    "traceability": "Transparency",
    "non-discrimination": "Fairness",
    "non discrimination": "Fairness",
    "nondiscrimination": "Fairness",
    "bias mitigation": "Fairness",
    "fairness": "Fairness",
    "robustness": "Robustness",
    "reliability": "Robustness",
    "resilience": "Robustness",
    "technical robustness": "Robustness",
    "safety": "Safety",
    "privacy": "Privacy",
    "data governance": "Privacy",
    "data protection": "Privacy",
    "privacy and data governance": "Privacy",
    "accountability": "Accountability",
    "auditability": "Accountability",
    "human oversight": "Human oversight",
    "human agency": "Human oversight",
    "human agency and oversight": "Human oversight",
    "human-in-the-loop": "Human oversight",
}
# Forms of times in file names, logs and reports.
DATES = {"compact": "yyyyMMdd_HHmmss'Z'", "iso": "yyyy-MM-dd'T'HH:mm:ss", "human": "MMM dd, yyyy, HH:mm 'UTC'"}
# Predicates of taxonomies and of values.
TAXONOMY = ("is_subclass_of", "is_dimension_of")
VALUED = ("with_low", "with_high", "has_threshold", "with_default")
# Endings of keywords, and the endings that stand in their place, the first that fits deciding.
SUFFIXES = {"ability": ("able", "ation", ""), "ibility": ("ible", "ion", ""), "ness": ("",), "ity": ("",), "tion": ("te",), "ment": ("",)}


def strip(c: Column | str) -> Column:
    """White space of any kind trimmed at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def name(c: Column) -> Column:
    """White space trimmed and collapsed, case kept; null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normal(c: Column) -> Column:
    """The search key of a name: collapsed and in lower case."""
    return F.lower(name(c))


def text_or_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def relationship_type(predicate: Column) -> Column:
    """Snake case of a predicate; null if nothing safe (a letter, then letters, digits, `_`) is left."""
    snake = F.lower(F.regexp_replace(strip(predicate), "([A-Z])", "_$1"))
    snake = F.regexp_replace(F.regexp_replace(snake, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(snake.rlike("^[a-z][a-z0-9_]*$"), snake)


def key_words(c: Column) -> Column:
    """`_` to space, lower case, and only runs of a-z, 0-9 and + # . - kept."""
    return F.array_join(F.regexp_extract_all(F.lower(F.replace(c, F.lit("_"), F.lit(" "))), F.lit("([a-z0-9+#.-]+)"), F.lit(1)), " ")


def is_placeholder(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*PLACEHOLDER_NAMES)


def has_term(c: Column, term: str) -> Column:
    """Whether the term occurs and no ASCII letter touches it, in any case."""
    return F.coalesce(c.rlike(rf"(?i)(?<![A-Za-z]){re.escape(term)}(?![A-Za-z])"), F.lit(False))


def has_word(c: Column, term: str) -> Column:
    """Whether the term occurs as whole words in the text in lower case."""
    return F.coalesce(F.lower(c).rlike(rf"(?U)(?<!\w){re.escape(term.lower())}(?!\w)"), F.lit(False))


def relation_text(source: Column, predicate: Column, target: Column, sentence: Column) -> Column:
    """The sentence, else the triple in words, with a capital first letter."""
    said = F.coalesce(text_or_null(sentence), F.concat_ws(" ", source, F.replace(predicate, F.lit("_"), F.lit(" ")), target))
    said = F.replace(said, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, 2, 2**31 - 1))


def strongest(modalities: Column) -> Column:
    """The strongest of an array of modalities, null if none is known."""
    ranks = reduce(lambda acc, m: acc.when(F.array_contains(modalities, m), m), PRIORITY[1:], F.when(F.array_contains(modalities, PRIORITY[0]), PRIORITY[0]))
    return ranks


def short_id(*parts: Column) -> Column:
    """The first 12 hexadecimal digits of a SHA-1 over the parts, which are set apart by a unit separator."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *(F.coalesce(p, F.lit("")) for p in parts))), 1, 12)


def synonyms_by_suffix(word: Column) -> Column:
    """Other forms of a keyword by its ending, without itself and blank ones."""
    out = F.array().cast("array<string>")
    for ending, others in reversed(SUFFIXES.items()):
        stem = F.substring(word, F.lit(1), F.length(word) - len(ending))
        out = F.when(word.endswith(ending), F.array_distinct(F.array(*(F.concat(stem, F.lit(o)) for o in others)))).otherwise(out)
    return F.filter(out, lambda x: (F.trim(x) != "") & (x != word))


def dimension(name: Column) -> Column:
    """The dimension that a name stands for, null if none or if it is that name already."""
    known = F.create_map(*(F.lit(x) for pair in DIMENSION_ALIASES.items() for x in pair))
    return F.nullif(F.element_at(known, F.lower(strip(name))), name)


def display_label(c: Column) -> Column:
    """A predicate in words: `_` and changes of case become spaces, the first letter a capital."""
    spaced = F.regexp_replace(F.replace(strip(c), F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2")
    spaced = name(F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2"))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 2**31 - 1))


def entity_key(c: Column) -> Column:
    """The key of an entity: `_` as space, collapsed, in lower case."""
    return normal(F.replace(c, F.lit("_"), F.lit(" ")))


def wording_modality(sentence: Column) -> Column:
    """The strongest obligation that the wording of a sentence states, else NONE; a null sentence says none.

    A rule of this library that stands in for a model's answer: shall not, must not; shall, must; should; may, can.
    """
    low = F.coalesce(F.lower(sentence), F.lit(""))
    return (
        F.when(low.rlike(r"\b(?:shall|must|may)\s+not\b|\bcannot\b|\bcan\s+not\b"), "PROHIBITED")
        .when(low.rlike(r"\b(?:shall|must)\b"), "MANDATORY")
        .when(low.rlike(r"\bshould\b"), "RECOMMENDED")
        .when(low.rlike(r"\b(?:may|can)\b"), "OPTIONAL")
        .otherwise("NONE")
    )


def duration(seconds: Column) -> Column:
    """A duration in words: 12.40s, 1m 15.20s, 1h 2m 3.00s."""
    rest = seconds - F.floor(seconds / 60) * 60
    minutes = F.floor(seconds / 60).cast("long")
    return F.when(seconds < 60, F.format_string("%.2fs", seconds)).when(minutes < 60, F.format_string("%dm %.2fs", minutes, rest)).otherwise(F.format_string("%dh %dm %.2fs", F.floor(minutes / 60).cast("long"), minutes % 60, rest))
