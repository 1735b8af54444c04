"""Document parsing, summaries, health and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

DROPPED_TAGS = ("script", "style", "nav", "footer", "header")


def html_text(html: Column) -> Column:
    """Visible text of a page: dropped elements and tags removed, white space collapsed."""
    out = html
    for tag in DROPPED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.btrim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def title(text: Column) -> Column:
    """The first line if longer than 10 characters, else the first sentence; at most 200 characters."""
    line = F.btrim(F.get(F.split(text, "\n"), 0), F.lit(" \t\r"))
    sentence = F.get(F.split(text, r"(?<=[.!?])\s+"), 0)
    return F.substring(F.when(F.char_length(line) > 10, line).otherwise(sentence), 1, 200)


def kb_health(docs: DataFrame) -> DataFrame:
    """Documents, empty and short ones, distinct texts by hash, and mean length."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(n == 0).alias("empty"), F.count_if(n < 50).alias("short"), F.count_distinct(F.md5("text")).alias("distinct_texts"), F.sum(n).alias("characters"))


def validate_labels(rows: DataFrame) -> DataFrame:
    """By label: rows, rows whose first 200 characters repeat, and token estimates (characters div 4, plus 1)."""
    marked = rows.withColumns({"key": F.md5(F.substring("text", 1, 200)), "tokens": F.floor(F.char_length("text") / 4) + 1})
    per_key = marked.groupBy("label", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))
    return per_key.groupBy("label").agg(F.sum("n").alias("n"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"), F.sum("tokens").cast("bigint").alias("tokens"), F.max("most").cast("bigint").alias("most_tokens"))


def latest_versions(rows: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """The value of the highest version of each key; partial aggregation leaves one row per key and task."""
    return rows.groupBy(key).agg(F.max(version).alias("version"), F.max_by(value, version).alias("value"), F.count(F.lit(1)).alias("versions"))


def feedback_loops(turns: DataFrame, within: int = 1000, least: float = 0.5, shortest: int = 20) -> DataFrame:
    """Inputs that repeat earlier outputs of their conversation: best character-trigram Jaccard of at least ``least``."""
    text = F.lower(F.btrim(F.coalesce("text", F.lit(""))))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3))))
    t = turns.select("conv_id", "turn", "role", text.alias("t")).where(F.char_length("t") >= shortest).withColumn("g", grams)
    a, b = t.where("role = 'user'").alias("a"), t.where("role = 'assistant'").alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") < F.col("a.turn")) & (F.col("b.turn") >= F.col("a.turn") - within))
    scored = pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.col("b.turn").alias("output"), F.round(T.jaccard(F.col("a.g"), F.col("b.g")), 9).alias("likeness"))
    best = scored.groupBy("conv_id", "turn").agg(F.max("likeness").alias("likeness"), F.max_by("output", F.struct("likeness", -F.col("output"))).alias("output"))
    return best.where(F.col("likeness") >= least).withColumn("severity", F.when(F.col("likeness") > 0.8, "high").when(F.col("likeness") > 0.6, "medium").otherwise("low"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties; ranks come from counts by value, not from a sort of all rows."""

    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(F.col(c).alias(f"v_{c}")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select(f"v_{c}", (F.sum("n").over(Window.orderBy(f"v_{c}")) - (F.col("n") - 1) / 2).alias(f"r_{c}"))

    counts = rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(ranks(x), F.col(x) == F.col(f"v_{x}")).join(ranks(y), F.col(y) == F.col(f"v_{y}"))
    a, b, n = F.col(f"r_{x}"), F.col(f"r_{y}"), F.col("n")
    s = joined.agg(F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"))
    return s.select("n", ((F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt((F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * (F.col("n") * F.col("bb") - F.col("b") * F.col("b")))).alias("rho"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class of ``label`` against ``predicted``."""
    both = rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    named = both.select(F.explode(F.array_distinct(F.array("label", "predicted"))).alias("k"), "label", "predicted", "n")
    hit = (F.col("label") == F.col("k")) & (F.col("predicted") == F.col("k"))
    s = named.groupBy("k").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("predicted") == F.col("k"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == F.col("k"), F.col("n")).otherwise(0)).alias("t"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return s.select("k", "tp", ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("t")).alias("recall"), ratio(2 * F.col("tp"), F.col("p") + F.col("t")).alias("f1"))
