"""Tags, disguised attacks, structured text: what needs bytes, parsers or hashes that Spark has no function for.

Null texts count as empty. Python runs only in ``code_report``, ``json_leaves`` and ``hash_bag``, a batch at a time.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import safety

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Disguises by name; each is a Column function of the text.
DISGUISES = {
    "plain": lambda t: t,
    "upper": lambda t: F.upper(t),
    "zero_width": lambda t: F.regexp_replace(t, r"([A-Za-z])", "$1​"),
    "homoglyph": lambda t: F.translate(t, "aeo", "аео"),
    "leet": lambda t: F.translate(t, "aeios", "43105"),
    "rot13": lambda t: F.translate(t, LETTERS + LETTERS.upper(), LETTERS[13:] + LETTERS[:13] + LETTERS[13:].upper() + LETTERS[:13].upper()),
    "base64": lambda t: F.base64(F.encode(t, "UTF-8")),
    "reversed": lambda t: F.reverse(t),
    "spaced": lambda t: F.regexp_replace(t, " ", "   "),
}


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of an HMAC key of at most 64 bytes."""
    if len(key) > 64:
        raise ValueError("hash keys over 64 bytes first")
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text's UTF-8 as lowercase hex, inside the JVM. Keep keys out of plans that others can read."""
    inner, outer = pads(key)
    message = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def disguise_report(texts: DataFrame, column: str = "text") -> DataFrame:
    """``disguise, n, blocked``: how many texts the injection patterns still block under each disguise."""
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("disguise"), f(F.col(column)).alias("text")) for k, f in DISGUISES.items()]))
    hidden = texts.select(forms.alias("x")).select("x.disguise", "x.text")
    return safety.injection_score(hidden).groupBy("disguise").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked"))


def code_report(df: DataFrame, known: Iterable[str], column: str = "code", manifest: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Adds ``parses``, ``unknown_imports`` (sorted top-level module names outside ``known``) and ``unknown_calls`` of Python source.

    Unknown calls (sorted, as written) are those of a name in ``manifest`` whose attribute is not among its names. Source is
    parsed, never run; null is empty source, which parses.
    """
    allowed, named = frozenset(known), {k: frozenset(v) for k, v in (manifest or {}).items()}

    def dotted(node: ast.expr) -> str | None:
        """``a.b.c`` for such an expression."""
        parts: list[str] = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None

    def check(code: pd.Series) -> pd.DataFrame:
        out = []
        for text in code.fillna(""):
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                out.append((False, [], []))
                continue
            names = {a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
            names |= {n.module.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module and not n.level}
            calls = {c for n in ast.walk(tree) if isinstance(n, ast.Call) and (c := dotted(n.func)) and "." in c}
            odd = [c for c in calls if (head := c.split(".")[0]) in named and c.split(".")[1] not in named[head]]
            out.append((True, sorted(names - allowed), sorted(odd)))
        return pd.DataFrame(out, columns=["parses", "unknown_imports", "unknown_calls"])

    check.__annotations__ = {"code": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(check, "parses boolean, unknown_imports array<string>, unknown_calls array<string>")
    return df.withColumn("r", udf(F.col(column))).select(*df.columns, "r.parses", "r.unknown_imports", "r.unknown_calls")


def leaves(value: object, path: str = "") -> list[tuple[str, str]]:
    """Paths and leaves of a JSON value in document order; leaves as JSON, empty containers as leaves."""
    found, todo = [], [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict) and v:
            todo += [(f"{at}.{k}" if at else str(k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list) and v:
            todo += [(f"{at}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            found.append((at, json.dumps(v, ensure_ascii=False)))
    return found


def json_leaves(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, path, leaf``: one row per leaf of each JSON text; null and malformed texts have none."""

    def flatten(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append([] if t is None else [{"path": p, "leaf": v} for p, v in leaves(json.loads(t))])
            except (ValueError, RecursionError):
                out.append([])
        return pd.Series(out)

    flatten.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(flatten, "array<struct<path:string,leaf:string>>")
    return df.select(key, F.explode(udf(F.col(column))).alias("x")).select(key, "x.path", "x.leaf")


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hash_bag(df: DataFrame, dim: int = 64, column: str = "text") -> DataFrame:
    """``bag``: word counts by FNV-1a modulo ``dim``, scaled to length 1; all zeros without words."""

    def embed(texts: pd.Series) -> pd.Series:
        slots: dict[str, int] = {}
        out = []
        for t in texts.fillna(""):
            v = np.zeros(dim)
            for w in t.lower().split():
                if w not in slots:
                    if len(slots) >= 100_000:
                        slots.clear()  # bounds the memory, not the result
                    slots[w] = fnv1a(w.encode()) % dim
                v[slots[w]] += 1
            size = np.sqrt(v @ v)
            out.append(v / size if size else v)
        return pd.Series(out)

    embed.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return df.withColumn("bag", F.pandas_udf(embed, "array<double>")(F.col(column)))
