"""What services build of the operators: profiles, verdicts of containment and citations, guards, gates, voice, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import claims, evidence, pairs

# What an agent of each role may do unless told otherwise.
ROLES = {
    "researcher": (0.65, 100, 500_000, 600.0, "warn"), "summariser": (0.72, 30, 200_000, 120.0, "halt"), "coder": (0.55, 200, 1_000_000, 900.0, "warn"), "reviewer": (0.80, 50, 300_000, 300.0, "halt"),
    "planner": (0.60, 40, 250_000, 180.0, "warn"), "executor": (0.70, 150, 800_000, 600.0, "halt"),
}
GENERAL = (0.60, 50, 500_000, 300.0, "warn")
# How grave a finding of containment is.
SEVERITY = {"anti_anchor_injection": "high", "production_target": "high", "scope_mismatch": "medium"}
#: Scopes that may act on the world.
REAL = ("production", "shadow")
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def agent_profiles(agents: DataFrame) -> DataFrame:
    """``agent_id, role, coherence_threshold, max_steps, max_tokens, max_wall_seconds, escalation``: own values, else the role's, else the general ones.

    ``agents``: ``agent_id, role`` and the same columns, null where nothing is stated. Roles are a dozen rows and go out.
    """
    rows = [(k, *v) for k, v in ROLES.items()]
    columns = ("coherence_threshold", "max_steps", "max_tokens", "max_wall_seconds", "escalation")
    roles = agents.sparkSession.createDataFrame(rows, "r string, r_coherence_threshold double, r_max_steps int, r_max_tokens int, r_max_wall_seconds double, r_escalation string")
    out = agents.join(F.broadcast(roles), agents["role"] == roles["r"], "left")
    return out.select("agent_id", F.coalesce("role", F.lit("general")).alias("role"), *[F.coalesce(F.col(c), F.col(f"r_{c}"), F.lit(g)).alias(c) for c, g in zip(columns, GENERAL, strict=True)])


def containment_verdicts(events: DataFrame) -> DataFrame:
    """``event_id, scope, findings, verdict`` (allow, warn, block) of each event (``event_id, text, url, scope, claimed_scope``).

    Hosts of production are no finding for scopes with real effects; a claim of another scope is one.
    """
    low = evidence.breakouts(events, True).select("event_id", "category")
    other = events.where(F.col("claimed_scope").isNotNull() & (F.col("claimed_scope") != F.col("scope"))).select("event_id", F.lit("scope_mismatch").alias("category"))
    found = low.unionByName(other).join(events.select("event_id", "scope"), "event_id")
    found = found.where(~((F.col("category") == "production_target") & F.col("scope").isin(*REAL)))
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("category")]
    worst = found.groupBy("event_id").agg(F.count(F.lit(1)).alias("findings"), F.max(F.when(severity == "high", 2).otherwise(1)).alias("worst"))
    out = events.select("event_id", "scope").join(worst, "event_id", "left")
    return out.select("event_id", "scope", F.coalesce("findings", F.lit(0)).alias("findings"), F.when(F.col("worst") == 2, "block").when(F.col("worst") == 1, "warn").otherwise("allow").alias("verdict"))


def fact_hash(source: Column, content: Column) -> Column:
    """SHA-256 of source and content, told apart by a unit separator."""
    return F.sha2(F.concat(source, F.lit("\u001f"), content), 256)


def citation_verdicts(facts: DataFrame, scores: DataFrame, least: float = 0.2) -> DataFrame:
    """``response, facts, broken, doubtful, failures, trust``: citations of each response checked.

    ``facts``: ``response, source, content, content_hash``; ``scores``: ``source, score`` (unknown sources score 0.5). Broken facts
    do not have their hash, doubtful ones a source below ``least``; trust is the mean score.
    """
    known = scores.groupBy("source").agg(F.max("score").alias("score"))
    rows = facts.join(known, "source", "left").withColumn("s", F.coalesce("score", F.lit(0.5)))
    bad, weak = ~fact_hash(F.col("source"), F.col("content")).eqNullSafe(F.col("content_hash")), F.col("s") < least
    whole = F.round(F.col("s") * 1e9).cast("bigint")
    out = rows.groupBy("response").agg(F.count(F.lit(1)).alias("facts"), F.count_if(bad).alias("broken"), F.count_if(weak).alias("doubtful"), F.count_if(bad | weak).alias("failures"), F.sum(whole).alias("total"))
    return out.select("response", "facts", "broken", "doubtful", "failures", (F.col("total") / 1e9 / F.col("facts")).alias("trust"))


def source_matches(df: DataFrame, k: int = 3) -> DataFrame:
    """``pair_id, claim_index, source_index, divergence, rank``: the ``k`` source sentences nearest to each claim, the first of equals first."""
    listed = df.select("pair_id", T.sentences(F.col("hypothesis")).alias("claims"), T.sentences(F.col("premise")).alias("sources"))
    rows = listed.select("pair_id", "sources", F.posexplode("claims").alias("claim_index", "claim"))
    rows = rows.select("pair_id", "claim_index", T.words(F.col("claim")).alias("cw"), F.posexplode("sources").alias("source_index", "source"))
    scored = rows.select("pair_id", "claim_index", "source_index", F.round(1 - T.jaccard(F.col("cw"), T.words(F.col("source"))), 9).alias("divergence"))
    w = Window.partitionBy("pair_id", "claim_index").orderBy("divergence", "source_index")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def verified_bands(df: DataFrame) -> DataFrame:
    """``pair_id, claims, band``: how sure the verdicts of a pair's claims are on average: high from 0.7, medium from 0.4, else low."""
    verdicts = pairs.claim_signals(claims.best_sources(df))
    whole = F.round(F.col("verdict_confidence") * 1e9).cast("bigint")
    out = verdicts.groupBy("pair_id").agg(F.count(F.lit(1)).alias("claims"), F.sum(whole).alias("s"))
    mean = F.round(F.col("s") / 1e9 / F.col("claims"), 9)
    return out.select("pair_id", "claims", F.when(mean >= 0.7, "high").when(mean >= 0.4, "medium").otherwise("low").alias("band"))


def guard_reports(df: DataFrame, threshold: float = 0.6, conformal: float = 0.2) -> DataFrame:
    """``pair_id, score, approved, low, high, injected, verified``: every guard's word on a pair.

    The composite review with an interval of ``conformal`` around the score, injection by drift of claims, and the roll-up of
    verified claims; null where a pair has no claims.
    """
    reviewed = pairs.composite(df, threshold=threshold).select("pair_id", F.round("score", 9).alias("score"))
    injected = evidence.intent_drift(df).select("pair_id", F.col("detected").alias("injected"))
    verified = claims.verified_claims(df).select("pair_id", F.col("approved").alias("verified"))
    out = reviewed.join(injected, "pair_id", "left").join(verified, "pair_id", "left")
    s = F.col("score")
    return out.select("pair_id", "score", (s >= threshold).alias("approved"), F.greatest(F.lit(0.0), s - conformal).alias("low"), F.least(F.lit(1.0), s + conformal).alias("high"), "injected", "verified")


def end_to_end(rows: DataFrame, by: str) -> DataFrame:
    """``by, n, catch_rate, false_positives, precision, f1, p95``: flagged rows (``flagged, bad`` booleans, ``latency`` whole) by group.

    ``p95`` is the order statistic at 0.95 (n - 1), rounded down, from counts by value.
    """
    one = lambda c: F.count_if(c)
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), one(F.col("flagged") & F.col("bad")).alias("tp"), one(F.col("flagged") & ~F.col("bad")).alias("fp"), one(F.col("bad")).alias("p"), one(~F.col("bad")).alias("q"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"catch_rate": share(F.col("tp"), F.col("p")), "false_positives": share(F.col("fp"), F.col("q")), "precision": share(F.col("tp"), F.col("tp") + F.col("fp"))})
    out = out.withColumn("f1", share(2 * F.col("precision") * F.col("catch_rate"), F.col("precision") + F.col("catch_rate")))
    return out.join(order_statistics(rows, by, "latency", {"p95": 0.95}), by).select(by, "n", "catch_rate", "false_positives", "precision", "f1", "p95")


def order_statistics(rows: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """``by`` and for each name the value at place int(q (n - 1)) of the sorted values, exact, from counts by value."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by)
    counted = counted.withColumns({"upto": F.sum("c").over(w.orderBy("v")), "all": F.sum("c").over(w)})
    return counted.groupBy(by).agg(*[F.min(F.when(F.col("upto") > F.floor(F.round(q * (F.col("all") - 1), 6)), F.col("v"))).alias(k) for k, q in quantiles.items()])


def handoff_gate(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Adds ``blocked``: a handoff whose divergence is over 1 - ``threshold``."""
    return scores.withColumn("blocked", F.round("score", 9) > 1 - threshold)


def has_cycle(edges: DataFrame) -> bool:
    """Whether the directed edges ``src, dst`` hold a cycle: what has no way in goes, round by round, until nothing does."""
    from tidemark.sources.shared import store

    left = store(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "cycle")
    size = left.count()
    while size:
        kept = store(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "cycle")
        now = kept.count()
        if now == size:
            return True
        left, size = kept, now
    return False


def guarded_loops(steps: DataFrame, most_steps: int = 50, most_tokens: int = 5000, most_micros: int = 300_000_000, repeats: int = 3, drift: float = 0.6, severe: float = 0.9) -> DataFrame:
    """Adds ``step, used, seen, drift`` and ``verdict`` to agents' steps (``session, idx, micros, action, arguments, tokens, goal``).

    Halts: too many steps, tokens or microseconds since the first step, ``2 * repeats`` of one action, drift over ``severe``.
    Warnings: ``repeats`` of one action, drift over ``drift``. Drift is 1 - Jaccard of the goal's and the action's words.
    """
    w = Window.partitionBy("session").orderBy("idx")
    key = F.substring(F.md5(F.concat_ws("::", "action", F.coalesce("arguments", F.lit("")))), 1, 12)
    s = steps.withColumn("key", key)
    per = Window.partitionBy("session", "key").orderBy("idx")
    said = F.concat_ws(" ", "action", F.coalesce("arguments", F.lit("")))
    away = F.when((F.size(T.words(F.coalesce("goal", F.lit("")))) == 0) | (F.size(T.words(said)) == 0), 0.0).otherwise(F.round(1 - T.jaccard(T.words(F.col("goal")), T.words(said)), 9))
    s = s.withColumns({"step": F.row_number().over(w), "used": F.sum("tokens").over(w), "seen": F.row_number().over(per), "took": F.col("micros") - F.first("micros").over(w), "drift": away})
    halt = (F.col("step") > most_steps) | (F.col("used") > most_tokens) | (F.col("took") > most_micros) | (F.col("seen") >= 2 * repeats) | (F.col("drift") > severe)
    warn = (F.col("seen") >= repeats) | (F.col("drift") > drift)
    return s.withColumn("verdict", F.when(halt, "halt").when(warn, "warn").otherwise("continue")).drop("key", "took")


def voice_sessions(tokens: DataFrame, every: int = 4, window: int = 8, hard: int = 250, floor: int = 300) -> DataFrame:
    """``session, spoken, reason``: tokens (``session, idx, milli, ends``) that reach the voice before a session halts.

    Every ``every``-th token is scored, in thousandths. Below ``hard`` the session halts before that token. When the mean of the last ``window``
    scores is below ``floor`` it halts after the next token that ends a sentence. Whether a token is scored depends on
    what is pending, so a session is a fold, one Arrow pass over sorted rows.
    """

    def run(batches):
        session, state = None, None
        for batch in batches:
            out = []
            for name, _, milli, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != session:
                    if state:
                        out.append((session, state["spoken"], state["reason"]))
                    session, state = name, {"fed": 0, "spoken": 0, "scores": [], "pending": False, "reason": None}
                if state["reason"]:
                    continue
                state["fed"] += 1
                if not state["pending"] and state["fed"] % every == 0:
                    state["scores"] = [*state["scores"], milli][-window:]
                    if milli < hard:
                        state["reason"] = "hard_limit"
                        continue
                    state["spoken"] += 1
                    state["pending"] = len(state["scores"]) == window and sum(state["scores"]) < floor * window
                    continue
                state["spoken"] += 1
                if state["pending"] and ends:
                    state["reason"] = "soft_halt_sentence_end"
            if out:
                yield rows(out)
        if state:
            yield rows([(session, state["spoken"], state["reason"])])

    def rows(out):
        return pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["session", "spoken", "reason"])

    sorted_rows = tokens.select(F.col("session").cast("bigint").alias("session"), "idx", "milli", "ends").repartition("session").sortWithinPartitions("session", "idx")
    return sorted_rows.mapInArrow(run, "session bigint, spoken bigint, reason string")


def byte_bag(data: Column, dim: int = 512, chunk: int = 64) -> Column:
    """A unit vector of a binary's pieces of ``chunk`` bytes, counted by FNV-1a modulo ``dim``; all zeros for no bytes."""

    def encode(blobs: pd.Series) -> pd.Series:
        return blobs.map(bag)

    def bag(blob: bytes | None) -> list[float]:
        raw = np.frombuffer(blob or b"", np.uint8)
        out = np.zeros(dim)
        full = len(raw) // chunk * chunk
        for part in (raw[:full].reshape(-1, chunk), raw[full:].reshape(1, -1) if len(raw) > full else None):
            if part is not None and part.size:
                h = np.full(len(part), FNV_OFFSET, np.uint64)
                for k in range(part.shape[1]):
                    h = (h ^ part[:, k]) * np.uint64(FNV_PRIME)
                np.add.at(out, (h % np.uint64(dim)).astype(np.int64), 1.0)
        size = np.sqrt(out @ out)
        return (out / size if size else out).tolist()

    encode.__annotations__ = {"blobs": pd.Series, "return": pd.Series}
    return F.pandas_udf(encode, "array<double>")(data)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, limited to [0, 1]; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, T.clamp(dot(a, b) / size)).otherwise(0.0)


def approximate_report(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """``by, n_distinct, median, p95``, approximate: HyperLogLog++ and quantile sketches that merge on the map side."""
    return rows.groupBy(by).agg(F.approx_count_distinct(key, 0.02).alias("n_distinct"), F.percentile_approx(value, 0.5, 10_000).alias("median"), F.percentile_approx(value, 0.95, 10_000).alias("p95"))
