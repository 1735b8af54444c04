"""Policies read from documents and applied to texts; Unicode hygiene; effective intents.

Null texts count as empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrasings of policy rules, by the kind of rule that they make.
RULES = {
    "forbidden": r"(?i)(?:must not|shall not|may not|do not|never)\s+([^.\n]{3,120})",
    "max_length": r"(?i)(?:maximum|at most|no more than|up to)(?:\s+of)?\s+(\d{2,6})\s+characters?",
    "required_citations": r"(?i)(?:at least|minimum of|must cite)\s+(\d{1,3})\s+(?:sources?|citations?|references?)",
    "pattern": r"(?i)block\s+(?:the\s+)?pattern\s+`([^`]+)`",
}
#: The default mark of a citation, and the share of odd characters that makes a text suspicious.
CITATION, ODD_SHARE = r"\[\d+\]", 0.15
ODD = r"[\p{Cf}\p{Co}\p{Cn}\p{Me}]"


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def compiled_rules(documents: DataFrame, key: str = "doc_id", column: str = "text", source: str = "regex") -> DataFrame:
    """``key, i, id, kind, value``: the rules that a compliance text states, each once, by kind and then in order.

    ``id`` is the head of the SHA-256 of kind, value and source, the same whenever a text is read again.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    found = []
    for kind, pattern in RULES.items():
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if kind == "forbidden":
            values = F.filter(F.transform(values, lambda v: F.rtrim(F.btrim(v, F.lit(" \t\n\r\f\u000b")), F.lit(",;:."))), lambda v: v != "")
        found.append(F.transform(values, _of_kind(kind)))
    rules = documents.select(key, F.posexplode(F.array_distinct(F.concat(*found))).alias("i", "r"))
    digest = F.substring(F.sha2(F.concat(F.col("r.kind"), F.lit("|"), F.col("r.value"), F.lit(f"|{source}")), 256), 1, 16)
    return rules.select(key, "i", digest.alias("id"), "r.kind", "r.value")


def enforced(texts: DataFrame, rules: DataFrame, key: str = "doc_id", column: str = "text", citation: str = CITATION) -> DataFrame:
    """``key, id, kind, detail``: violations of the rules (``id, kind, value``) by every text.

    A forbidden phrase occurs, whatever its case; a text is longer than allowed; it has too few citations; a pattern
    matches. Rules are few and go out to the texts; their number is checked.
    """
    few = rules.select("id", "kind", "value").distinct()
    if few.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 rules; apply them in parts")
    text = F.coalesce(F.col(column), F.lit(""))
    read = texts.select(key, text.alias("text"), F.lower(text).alias("low"), F.char_length(text).alias("n"), F.regexp_count(text, F.lit(citation)).alias("cited"))
    met = read.join(F.broadcast(few))
    kind, value = F.col("kind"), F.col("value")
    number = F.when(kind.isin("max_length", "required_citations"), value).cast("int")
    broken = (
        F.when(kind == "forbidden", F.contains("low", F.lower(value)))
        .when(kind == "max_length", F.col("n") > number)
        .when(kind == "required_citations", F.col("cited") < number)
        .otherwise(F.regexp_like("text", F.concat(F.lit("(?i)"), value)))
    )
    detail = F.when(kind == "max_length", F.col("n").cast("string")).when(kind == "required_citations", F.col("cited").cast("string")).otherwise(value)
    return met.where(broken).select(key, "id", "kind", detail.alias("detail"))


def odd_share(text: Column) -> Column:
    """The share of format, private, unassigned and enclosing characters; 0 for an empty text."""
    return F.regexp_count(text, F.lit(ODD)) / F.greatest(F.char_length(text), F.lit(1))


def scrubbed(text: Column) -> Column:
    """NFKC without control and other unprintable characters, but line ends and tabs.

    Texts that are all ASCII stay in the JVM; the others need Unicode's normal forms, a batch at a time.
    """

    def clean(texts: pd.Series) -> pd.Series:
        keep = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t.replace("\0", "")) if c in "\n\r\t" or not unicodedata.category(c).startswith("C"))
        return texts.map(keep, na_action="ignore")

    clean.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")).otherwise(F.pandas_udf(clean, "string")(text))


def effective_intent(system: Column, query: Column, intent: Column) -> Column:
    """System prompt and query joined; else the one that is there; else the stated intent."""
    s, q = F.coalesce(system, F.lit("")), F.coalesce(query, F.lit(""))
    return F.when((s != "") & (q != ""), F.concat(s, F.lit("\n\n"), q)).when(s != "", s).when(q != "", q).otherwise(intent)


def federated_counts(submissions: DataFrame, categories: tuple[str, ...], epsilon: float, sensitivity: float = 1.0, seed: int = 0) -> DataFrame:
    """``category, raw, scale, noisy``: a histogram over a closed set of categories with Laplace noise.

    ``submissions`` has ``tenant, category, count``. The privacy budget is shared evenly among the categories; categories
    without a submission are released too, and unknown ones raise.
    """
    from tidemark.operators.provenance import laplace

    known = submissions.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    sums = submissions.groupBy("category").agg(F.sum("count").alias("raw"))
    unknown = sums.join(known, "category", "left_anti").limit(1).collect()
    if unknown:
        raise KeyError(f"category {unknown[0]['category']!r} is not in the histogram's set")
    share = epsilon / len(categories)
    out = known.join(sums, "category", "left").select("category", F.coalesce("raw", F.lit(0)).alias("raw"), F.lit(sensitivity / share).alias("scale"))
    return out.withColumn("noisy", laplace(F.col("raw").cast("double"), sensitivity, share, seed))


def composed_epsilon(releases: DataFrame, most_delta: float | None = None) -> DataFrame:
    """``tenant, releases, basic, advanced``: what the releases (``tenant, epsilon``) of a tenant cost together.

    Advanced composition needs one epsilon throughout; otherwise, and below no release, it is the basic sum. Half of
    ``most_delta`` (or 1e-9) is its own share of delta.
    """
    delta = most_delta / 2 if most_delta else 1e-9
    g = releases.groupBy("tenant").agg(F.count(F.lit(1)).alias("releases"), F.sum("epsilon").alias("basic"), F.min("epsilon").alias("e"), F.max("epsilon").alias("top"))
    k, e = F.col("releases"), F.col("e")
    advanced = F.sqrt(2.0 * k * F.log(F.lit(1.0 / delta))) * e + k * e * (F.exp(e) - 1)
    return g.select("tenant", "releases", "basic", F.when(e != F.col("top"), F.col("basic")).when(e == 0, 0.0).otherwise(advanced).alias("advanced"))
