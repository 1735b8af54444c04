"""Records of agents and sessions, changed texts, learned guards."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import guards, pairs, service, streams
from tidemark.operators.chunks import trimmed
from tidemark.operators.sequential import folded

#: Labelled rows that a learned guard reads at most, and the slots of its bag of words.
SAMPLE_ROWS, SLOTS = 5000, 256
SMALL = "abcdefghijklmnopqrstuvwxyz"


def behaviour_records(obs: DataFrame, least: int = 16, threshold: float = 3.0) -> DataFrame:
    """``tenant, event_id, z, anomaly``: each observation (``tenant, micros, event_id, points``) against the agent's record.

    z is 0 until the record has ``least`` observations, and where it does not vary. Anomalies (|z| over ``threshold``) do not
    join the record, so who is one depends on all before: a fold, with exact whole sums.
    """

    def start() -> Callable[..., tuple]:
        n = s = q = 0

        def step(v: int) -> tuple[float, bool]:
            nonlocal n, s, q
            spread = n * q - s * s
            z = (n * v - s) / math.sqrt(spread) if n >= least and spread > 0 else 0.0
            odd = abs(z) > threshold
            if not odd:
                n, s, q = n + 1, s + v, q + v * v
            return z, odd

        return step

    return folded(obs, ["points"], start, {"z": ("double", pa.float64()), "anomaly": ("boolean", pa.bool_())})


def adaptive_cadence(tokens: DataFrame, first: int = 1, most: int = 8, soft: int = 600, window: int = 10) -> DataFrame:
    """``tenant, event_id, scored, in_force``: which tokens (``points``, thousandths) are scored, and the score in force.

    A token is scored where its place divides by the cadence. While the mean of the last ``window`` scores in force is over ``soft`` the cadence
    grows by one up to ``most``; a score below ``soft`` brings it back to one.
    """

    def start() -> Callable[..., tuple]:
        place, cadence, score, recent = 0, first, 500, deque(maxlen=window)

        def step(points: int) -> tuple[bool, int]:
            nonlocal place, cadence, score
            scored = place % cadence == 0
            if scored:
                score = points
                mean = sum(recent) / len(recent) if recent else score
                if mean > soft and cadence < most:
                    cadence += 1
                elif score < soft:
                    cadence = 1
            recent.append(score)
            place += 1
            return scored, score

        return step

    return folded(tokens, ["points"], start, {"scored": ("boolean", pa.bool_()), "in_force": ("bigint", pa.int64())})


def session_rollup(tokens: DataFrame, hard: int = 200) -> DataFrame:
    """``session, output, n_tokens, mean, least, warnings``: the text that a session put out before it halted, and its scores.

    ``tokens``: ``session, idx, token, milli``. A warning is an emitted score in the tenth above the limit that halts.
    """
    halts = streams.halt_kernel(tokens.select("session", "idx", "milli"), hard=hard).select("session", "n_emitted")
    w = Window.partitionBy("session").orderBy("idx")
    out = tokens.withColumn("pos", F.row_number().over(w)).join(halts, "session").where(F.col("pos") <= F.col("n_emitted"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return out.groupBy("session").agg(F.array_join(F.transform(listed, lambda x: x["token"]), "").alias("output"), F.count(F.lit(1)).alias("n_tokens"), (F.sum("milli") / F.count(F.lit(1))).alias("mean"), F.min("milli").alias("least"), F.count_if(F.col("milli") < hard + 100).alias("warnings"))


def blended_logic(df: DataFrame, turns: DataFrame, weight: float = 0.7) -> DataFrame:
    """``pair_id, h_logical, cross, blended``: logical divergence of a pair, mixed with that of the answer from the turns before.

    ``df`` has ``pair_id, conv_id, turn``; the answer is the turn after ``turn``. Without turns before the pair's own counts alone.
    """
    logical = pairs.heuristic_logical(df).select("pair_id", "conv_id", (F.col("turn") + 1).alias("turn"), "h_logical")
    out = logical.join(streams.cross_turn(turns), ["conv_id", "turn"], "left")
    return out.select("pair_id", "h_logical", F.col("divergence").alias("cross"), F.coalesce(weight * F.col("h_logical") + (1 - weight) * F.col("divergence"), F.col("h_logical")).alias("blended"))


def embed_scores(df: DataFrame, dim: int = 64) -> DataFrame:
    """``pair_id, embed_score``: cosine of both sides' hashed bags of words, limited to [0, 1]."""
    both = guards.hash_bag(df.select("pair_id", "premise", "hypothesis"), dim, "premise").withColumnRenamed("bag", "p")
    both = guards.hash_bag(both, dim, "hypothesis")
    return both.select("pair_id", service.cosine(F.col("p"), F.col("bag")).alias("embed_score"))


def ensemble(scores: DataFrame, weights: dict[str, float]) -> Column:
    """The weighted mean of score columns; null ones leave their weight to the others, all null give null."""
    total = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return F.when(total > 0, value / total)


def perturbations(text: Column) -> dict[str, Column]:
    """A text with every third word left out, every fourth twice, the first two letters of longer words swapped, cases alternating, letters as digits, hidden characters between words."""
    words = F.filter(F.split(trimmed(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    swap = lambda w: F.when(F.char_length(w) > 3, F.concat(F.substring(w, 2, 1), F.substring(w, 1, 1), F.substring(w, 3, 2**31 - 1))).otherwise(w)
    flat = lambda parts: F.array_join(parts, " ")
    return {
        "token_drop": flat(F.filter(words, lambda w, i: (i + 1) % 3 != 0)),
        "token_repeat": flat(F.flatten(F.transform(words, lambda w, i: F.when((i + 1) % 4 == 0, F.array(w, w)).otherwise(F.array(w))))),
        "char_swap": flat(F.transform(words, swap)),
        "casing": flat(F.transform(words, lambda w, i: F.when(i % 2 == 0, F.translate(w, SMALL, SMALL.upper())).otherwise(F.translate(w, SMALL.upper(), SMALL)))),
        "digits": F.translate(flat(words), "aeiost", "431057"),
        "hidden": F.array_join(words, " ​"),
    }


def learned_guard(rows: DataFrame, epochs: int = 6, rate: float = 0.5, most: int = SAMPLE_ROWS, seed: int = 7) -> tuple[list[float], float]:
    """Weights and bias of a logistic unit over hashed bags of words, by stochastic gradients in a fixed order.

    ``rows``: ``key, text, label`` (0 or 1). At most ``most`` rows are read, drawn by a hash of their key.
    """
    drawn = rows.where(F.col("label").isin(0, 1) & F.col("text").isNotNull()).orderBy(F.xxhash64("key", F.lit(seed)), "key", F.xxhash64("text")).limit(most)
    sample = guards.hash_bag(drawn, SLOTS).select("key", "label", "bag").collect()
    sample.sort(key=lambda r: (str(r["key"]), r["label"], r["bag"]))
    x, y = np.array([r["bag"] for r in sample], float).reshape(-1, SLOTS), np.array([r["label"] for r in sample], float)
    weights, bias = np.zeros(SLOTS), 0.0
    share = y.mean() if len(y) else 0.5
    pull = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in order.permutation(len(y)):
            slope = (y[i] - 1 / (1 + math.exp(-float(np.clip(x[i] @ weights + bias, -30, 30))))) * pull[i] * rate / (1 + epoch)
            weights += slope * x[i] * 4
            bias += slope
    return weights.tolist(), float(bias)


def guard_score(bag: Column, weights: Sequence[float], bias: float) -> Column:
    """The learned unit's probability for a bag."""
    z = F.aggregate(F.zip_with(bag, F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(float(bias)), lambda s, v: s + v)
    return 1 / (1 + F.exp(-z))
