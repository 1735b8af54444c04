"""DuckDB forms of the text expressions, to check the Column builders against."""

from __future__ import annotations

from collections.abc import Iterable


def lit(values: Iterable[str]) -> str:
    """A list literal."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def rx(pattern: str) -> str:
    """A pattern as a string literal."""
    return "'" + pattern.replace("'", "''") + "'"


def words(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"


def spaced(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> ''))"


def entities(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(regexp_replace({x}, '[^\x00-\x7F\P{{L}}]', '_', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'))"


def numbers(x: str, pattern: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, {rx(pattern)}))"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def union_size(a: str, b: str) -> str:
    return f"(len({a}) + len({b}) - {shared(a, b)})"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN {union_size(a, b)} = 0 THEN 0.0 ELSE {shared(a, b)} / {union_size(a, b)} END)"


def without(a: str, values: Iterable[str]) -> str:
    return f"list_filter({a}, lambda w: NOT list_contains({lit(values)}, w))"


def has_any(a: str, values: Iterable[str]) -> str:
    return f"list_has_any({a}, {lit(values)})"


def wilson(k: str, n: str) -> str:
    p, z = f"({k} / {n})", "1.96"
    spread = f"({z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {n})) / {n}) / (1 + {z} * {z} / {n}))"
    centre = f"(({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))"
    return f"(CASE WHEN {n} = 0 THEN 1.0 ELSE least({spread}, {centre}, 1 - {centre}) END)"
