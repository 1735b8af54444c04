"""Column builders for text: each takes and returns a Column, and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
ENTITY = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
NUMBER = r"\b\d[\d,.]*\b"
RULE_NUMBER = r"\b\d+(?:\.\d+)?(?:%|°[CF]?)?\b"
#: Letters outside ASCII become underscores, so that word boundaries mean the same in every engine.
NON_ASCII_LETTER = r"[^\x00-\x7F\P{L}]"


def word_array(values: Iterable[str]) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values])


def find_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """The set of Unicode words, lower-cased."""
    return F.array_distinct(find_all(F.lower(text), WORD))


def spaced_words(text: Column) -> Column:
    """The set of lower-cased pieces between white space; punctuation stays attached."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def entities(text: Column) -> Column:
    """The set of maximal runs of capitalised words."""
    return F.array_distinct(find_all(F.regexp_replace(text, NON_ASCII_LETTER, "_"), ENTITY))


def numbers(text: Column, pattern: str = NUMBER) -> Column:
    """The set of numbers, as written."""
    return F.array_distinct(find_all(text, pattern))


def shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two sets."""
    return F.size(F.array_intersect(a, b))


def union_size(a: Column, b: Column) -> Column:
    """Size of the union of two sets."""
    return F.size(a) + F.size(b) - shared(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if both sets are empty."""
    return F.when(union_size(a, b) == 0, 0.0).otherwise(shared(a, b) / union_size(a, b))


def has_any(a: Column, values: Iterable[str]) -> Column:
    """Whether a set holds any of the values."""
    return F.arrays_overlap(a, word_array(values))


def sentences(text: Column, least_words: int = 3) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` and white space that have at least ``least_words`` words."""
    pieces = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(" \t\n\r")))
    return F.filter(pieces, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least_words)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Limit to [low, high]; NaN becomes ``low``."""
    return F.when(F.isnan(x), low).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))
