"""Halting and monitoring of ordered streams, as windows over (session, index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def halt_kernel(tokens: DataFrame, hard: int = 200, mean_window: int = 10, mean_limit: int = 350, trend_window: int = 5, trend_limit: int = 500) -> DataFrame:
    """The first halt of each session and its reason; scores are integers in thousandths.

    Tests in order at each token: score below ``hard``; mean of the last ``mean_window`` (once there are that many)
    below ``mean_limit``; drop over the last ``trend_window`` by least squares, -slope (n - 1), above ``trend_limit``.
    Returns ``session, n_tokens, n_emitted, reason, min_emitted``: no emitted token lies below ``hard``.
    """
    w = Window.partitionBy("session").orderBy("idx")
    recent = w.rowsBetween(-(mean_window - 1), 0)
    middle = (trend_window - 1) / 2
    slope_by = sum((i - middle) ** 2 for i in range(trend_window))
    lags = [F.lag("milli", trend_window - 1 - i).over(w) * (i - middle) for i in range(trend_window - 1)] + [F.col("milli") * middle]
    drop = -sum(lags[1:], lags[0]) / slope_by * (trend_window - 1)
    t = tokens.withColumns({"total": F.sum("milli").over(recent), "held": F.count(F.lit(1)).over(recent), "drop": drop, "pos": F.row_number().over(w)})
    reason = F.when(F.col("milli") < hard, "hard_limit").when((F.col("held") == mean_window) & (F.col("total") < mean_limit * mean_window), "window_avg").when(F.col("drop") > trend_limit, "trend")
    t = t.withColumn("reason", reason)
    first = t.withColumn("halt", F.min(F.when(F.col("reason").isNotNull(), F.col("pos"))).over(Window.partitionBy("session")))
    emitted = F.col("halt").isNull() | (F.col("pos") < F.col("halt"))
    return first.groupBy("session").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(emitted).alias("n_emitted"), F.max(F.when(F.col("pos") == F.col("halt"), F.col("reason"))).alias("reason"), F.min(F.when(emitted, F.col("milli"))).alias("min_emitted"))


def fixed_cadence(tokens: DataFrame, every: int = 4) -> DataFrame:
    """The score in force at each token when only every ``every``-th is scored."""
    w = Window.partitionBy("session").orderBy("idx")
    t = tokens.withColumn("pos", F.row_number().over(w) - 1)
    return t.withColumn("in_force", F.last(F.when(F.col("pos") % every == 0, F.col("milli")), ignorenulls=True).over(w)).select("session", "idx", "milli", "in_force")


def contradictions(turns: DataFrame, most: int = 20) -> DataFrame:
    """``conv_id, n_pairs, contradiction_index, worst_a, worst_b, trend`` over the last ``most`` turns of a conversation.

    A pair's divergence is 1 - word Jaccard. The worst pair (positions from 0 among those turns) is the first with the
    largest divergence, null where none is above 0. The trend is the mean of the later half of the pairs, in the order of their first and
    second turn, minus that of the earlier half; 0 below three pairs. Conversations of one turn have no pairs.
    """
    w = Window.partitionBy("conv_id")
    t = turns.select("conv_id", "turn", "text").withColumn("back", F.row_number().over(w.orderBy(F.desc("turn")))).where(F.col("back") <= most)
    t = t.withColumn("pos", F.row_number().over(w.orderBy("turn")) - 1).select("conv_id", "pos", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    a, b = t.alias("a"), t.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.pos") < F.col("b.pos")))
    pairs = pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), F.round(1 - T.jaccard(F.col("a.w"), F.col("b.w")), 9).alias("d"))
    pairs = pairs.withColumns({"nth": F.row_number().over(w.orderBy("i", "j")), "half": F.floor(F.count(F.lit(1)).over(w) / 2)})
    early = F.col("nth") <= F.col("half")
    found = pairs.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.max("d").alias("contradiction_index"), F.max(F.when(F.col("d") > 0, F.struct("d", (-F.col("i")).alias("i"), (-F.col("j")).alias("j")))).alias("top"),
        (F.avg(F.when(~early, F.col("d"))) - F.avg(F.when(early, F.col("d")))).alias("trend"),
    )
    alone = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("conv_id", F.lit(0).cast("bigint").alias("n_pairs"), F.lit(0.0).alias("contradiction_index"), F.lit(None).cast("int").alias("worst_a"), F.lit(None).cast("int").alias("worst_b"), F.lit(0.0).alias("trend"))
    trend = F.when(F.col("n_pairs") >= 3, F.col("trend")).otherwise(0.0)
    return found.select("conv_id", "n_pairs", "contradiction_index", (-F.col("top.i")).alias("worst_a"), (-F.col("top.j")).alias("worst_b"), trend.alias("trend")).unionByName(alone)


def cross_turn(turns: DataFrame, back: int = 3) -> DataFrame:
    """Divergence of each turn from the joined text of up to ``back`` turns before it; null for a first turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, -1)
    t = turns.withColumn("before", F.array_join(F.collect_list("text").over(w), " ")).withColumn("n_before", F.count(F.lit(1)).over(w))
    return t.select("conv_id", "turn", F.when(F.col("n_before") > 0, 1 - T.jaccard(T.words(F.col("before")), T.words(F.coalesce("text", F.lit(""))))).alias("divergence"))


def loop_monitor(steps: DataFrame, most_steps: int = 50, most_tokens: int = 5000, repeats: int = 3) -> DataFrame:
    """Verdict of each agent step: ``continue``, ``warn`` or ``halt``, from running counts per session.

    Halts: more steps or tokens than allowed, or an action repeated ``2 * repeats`` times. Warnings: under a tenth of
    the token budget left, or ``repeats`` repetitions.
    """
    w = Window.partitionBy("session").orderBy("idx")
    per_action = Window.partitionBy("session", "action").orderBy("idx")
    s = steps.withColumns({"step": F.row_number().over(w), "used": F.sum("tokens").over(w), "seen": F.row_number().over(per_action)})
    halt = (F.col("step") > most_steps) | (F.col("used") > most_tokens) | (F.col("seen") >= 2 * repeats)
    warn = (F.col("used") * 10 > 9 * most_tokens) | (F.col("seen") >= repeats)
    return s.select("session", "idx", "step", "used", "seen", F.when(halt, "halt").when(warn, "warn").otherwise("continue").alias("verdict"))


def decision_window(decisions: DataFrame, last: int = 10) -> DataFrame:
    """Mean score over the last ``last`` decisions of each tenant."""
    w = Window.partitionBy("tenant").orderBy(F.desc("event_id"))
    return decisions.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= last).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))
