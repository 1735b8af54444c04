"""The inputs of the operators, built from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, premise, hypothesis``: each user turn with the assistant turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "hypothesis": F.lead("text").over(w)})
    return turns.where("role = 'user' AND next_role = 'assistant'").select((F.col("conv_id") * 10000 + F.col("turn")).alias("pair_id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("premise"), F.coalesce("hypothesis", F.lit("")).alias("hypothesis"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored interactions: ``event_id, ts, tenant, model, approved, score, latency_ms, tokens``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), (F.col("user_id") % 5).alias("tenant"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), "user_id",
        (F.col("event_type") != "error").alias("approved"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"), F.col("value").alias("latency_ms"), F.floor("value").cast("bigint").alias("tokens"), "event_type", "props",
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scores: ``doc_id, milli`` (score in thousandths) and ``label``."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id")
    return joined.select("doc_id", (F.col("n_chars") * 37 % 1000).alias("milli"), F.col("quality").alias("label"), F.col("toxic"))


#: The same views for DuckDB.
SQL = {
    "pairs": """pairs AS (SELECT conv_id * 10000 + turn AS pair_id, conv_id, turn, coalesce(text, '') AS premise, coalesce(hyp, '') AS hypothesis
        FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS hyp FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND next_role = 'assistant')""",
    "audit": """audit AS (SELECT event_id, epoch_us(ts) AS micros, user_id % 5 AS tenant, 'm' || (user_id % 3) AS model, user_id, event_type <> 'error' AS approved,
        least(1.0, value / 100) AS score, value AS latency_ms, floor(value)::BIGINT AS tokens, event_type, props FROM events)""",
    "corrections": """corrections AS (SELECT doc_id, n_chars * 37 % 1000 AS milli, quality AS label, toxic FROM documents JOIN labels USING (doc_id))""",
}
