"""Claim-by-claim verification: sentences of a response against their best source sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.pairs import claim_signals


def best_sources(df: DataFrame) -> DataFrame:
    """``pair_id, claim_index, hypothesis, source_index, premise``: each claim with its nearest source sentence.

    Nearest is the largest word Jaccard, the first of equals. Both sides are sentences of at least three words of one
    pair, so the pairing stays within a row's two texts. Pairs without claims or sources have no row.
    """
    listed = df.select("pair_id", T.sentences(F.col("hypothesis")).alias("claims"), T.sentences(F.col("premise")).alias("sources"))
    claims = listed.select("pair_id", "sources", F.posexplode("claims").alias("claim_index", "claim"))
    claims = claims.select("pair_id", "claim_index", "claim", T.words(F.col("claim")).alias("cw"), "sources").select("pair_id", "claim_index", "claim", "cw", F.posexplode("sources").alias("source_index", "source"))
    scored = claims.withColumn("likeness", F.round(T.jaccard(F.col("cw"), T.words(F.col("source"))), 9))
    best = scored.groupBy("pair_id", "claim_index").agg(F.max_by(F.struct("claim", "source", "source_index"), F.struct("likeness", -F.col("source_index"))).alias("b"))
    return best.select("pair_id", "claim_index", F.col("b.claim").alias("hypothesis"), F.col("b.source_index").alias("source_index"), F.col("b.source").alias("premise"))


def roll_up(verdicts: DataFrame) -> DataFrame:
    """Verdict counts, coverage, approval (no contradiction or fabrication with confidence 0.6 or more) and overall score."""
    v, c = F.col("verdict"), F.round("verdict_confidence", 9)
    bad = v.isin("contradicted", "fabricated")
    score = F.when(v == "supported", c).when(bad, 0.0).otherwise(0.5)
    counts = [F.count_if(v == k).alias(k) for k in ("supported", "contradicted", "fabricated", "unverifiable")]
    out = verdicts.groupBy("pair_id").agg(F.count(F.lit(1)).alias("claims"), *counts, (F.count_if(bad & (c >= 0.6)) == 0).alias("approved"), F.avg(score).alias("overall"))
    return out.withColumn("coverage", F.col("supported") / F.col("claims"))


def verified_claims(df: DataFrame) -> DataFrame:
    """The roll-up of all claims of each pair."""
    return roll_up(claim_signals(best_sources(df)))


def compressed(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``compressed``: sentences of ``hypothesis`` with keyword overlap of at least ``threshold`` with ``premise``, or the best one."""
    listed = df.withColumn("s", F.split("hypothesis", r"(?<=[.!?])\s+")).withColumn("q", T.spaced_words(F.col("premise")))
    over = F.transform("s", lambda x: F.struct(F.round(T.jaccard(F.col("q"), T.spaced_words(x)), 9).alias("o"), x.alias("s")))
    listed = listed.withColumn("over", over)
    kept = F.transform(F.filter("over", lambda x: x["o"] >= threshold), lambda x: x["s"])
    best = F.array_max(F.transform("over", lambda x: x["o"]))
    first = F.element_at(F.filter("over", lambda x: x["o"] == best), 1)["s"]
    return listed.withColumn("compressed", F.when(F.size("s") <= 1, F.col("hypothesis")).when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(first))
