"""Hash chains, Merkle roots and private counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import running_sums


def chained(rows: DataFrame, chain: str, idx: str, payload: str) -> DataFrame:
    """Add ``event_hash`` (SHA-256 of the payload) and ``parent_hash`` (the one before it; empty for the first)."""
    w = Window.partitionBy(chain).orderBy(idx)
    hashed = rows.withColumn("event_hash", F.sha2(F.coalesce(payload, F.lit("")), 256))
    return hashed.withColumn("parent_hash", F.coalesce(F.lag("event_hash").over(w), F.lit("")))


def verify_chain(rows: DataFrame, chain: str, idx: str, payload: str) -> DataFrame:
    """By chain: events, bad ones, and the first index whose hash or parent does not fit (null if all do)."""
    w = Window.partitionBy(chain).orderBy(idx)
    bad = (F.col("event_hash") != F.sha2(F.coalesce(payload, F.lit("")), 256)) | (F.col("parent_hash") != F.coalesce(F.lag("event_hash").over(w), F.lit("")))
    marked = rows.withColumn("bad", bad)
    return marked.groupBy(chain).agg(F.count(F.lit(1)).alias("events"), F.count_if("bad").alias("n_bad"), F.min(F.when(F.col("bad"), F.col(idx))).alias("first_bad"))


def merkle_roots(rows: DataFrame, group: str, idx: str, leaf: str) -> DataFrame:
    """``group, leaves, root``: Merkle root over the hex hashes of each group, in order of ``idx``.

    Neighbours are hashed together as text; a last one without a neighbour is hashed with itself. Levels are joins of
    positions, written between rounds, so a group may have any number of leaves.
    """
    from tidemark.sources.shared import store

    w = Window.partitionBy(group).orderBy(idx)
    level = store(rows.select(group, (F.row_number().over(w) - 1).alias("i"), F.col(leaf).alias("h")), "merkle")
    counts = level.groupBy(group).agg(F.count(F.lit(1)).alias("leaves"))
    while level.where("i > 0").limit(1).count():
        pairs = level.groupBy(group, F.floor(F.col("i") / 2).cast("int").alias("j")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("h"))).alias("l"), F.max(F.when(F.col("i") % 2 == 1, F.col("h"))).alias("r"))
        last = level.groupBy(group).agg(F.max("i").alias("n"))
        nxt = pairs.join(last, group).select(group, F.col("j").alias("i"), F.when(F.col("n") == 0, F.col("l")).otherwise(F.sha2(F.concat("l", F.coalesce("r", "l")), 256)).alias("h"))
        level = store(nxt, "merkle")
    return level.join(counts, group).select(group, "leaves", F.col("h").alias("root"))


def laplace(value: Column, sensitivity: float, epsilon: float, seed: int) -> Column:
    """The value with Laplace noise of scale sensitivity / epsilon."""
    u = F.rand(seed) - 0.5
    return value - sensitivity / epsilon * F.signum(u) * F.log1p(-2 * F.abs(u))


def gaussian(value: Column, sensitivity: float, epsilon: float, delta: float, seed: int) -> Column:
    """The value with Gaussian noise of sigma sensitivity * sqrt(2 ln(1.25 / delta)) / epsilon."""
    return value + sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon * F.randn(seed)


def spent_budget(releases: DataFrame, budget_milli: int) -> DataFrame:
    """Basic composition: running sum of ``epsilon_milli`` per tenant and whether it stays within the budget."""
    spent = running_sums(releases, "tenant", "event_id", {"spent": F.col("epsilon_milli")}, 1 << 20)
    return spent.withColumn("within", F.col("spent") <= budget_milli)


def merkle_proofs(rows: DataFrame, group: str, idx: str, leaf: str) -> DataFrame:
    """``group, idx, leaf, path``: for each leaf the hashes beside its way up to the group's root, lowest first.

    A step is ``<hash`` where the hash stands to the left, ``>hash`` to the right; a node without a neighbour meets itself.
    """
    from tidemark.sources.shared import store

    w = Window.partitionBy(group).orderBy(idx)
    numbered = rows.select(group, F.col(idx).alias("idx"), F.col(leaf).alias("leaf"), (F.row_number().over(w) - 1).alias("i"))
    ways = store(numbered.withColumns({"at": F.col("i"), "path": F.array().cast("array<string>")}), "proofs")
    level = store(numbered.select(group, "i", F.col("leaf").alias("h")), "merkle")
    while level.where("i > 0").limit(1).count():
        beside = level.select(F.col(group).alias("beside group"), F.col("i").alias("beside place"), F.col("h").alias("other"))
        last = level.groupBy(F.col(group).alias("last group")).agg(F.max("i").alias("top"))
        met = ways.join(last, ways[group] == last["last group"]).withColumn("mate", F.when(F.col("at") % 2 == 1, F.col("at") - 1).otherwise(F.least(F.col("at") + 1, F.col("top"))))
        met = met.join(beside, (met[group] == beside["beside group"]) & (met["mate"] == beside["beside place"]))
        step = F.concat(F.when(F.col("at") % 2 == 1, "<").otherwise(">"), F.col("other"))
        ways = store(met.select(group, "idx", "leaf", "i", F.when(F.col("top") > 0, F.floor(F.col("at") / 2).cast("int")).otherwise(0).alias("at"), F.when(F.col("top") > 0, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path")), "proofs")
        pairs = level.groupBy(group, F.floor(F.col("i") / 2).cast("int").alias("j")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("h"))).alias("l"), F.max(F.when(F.col("i") % 2 == 1, F.col("h"))).alias("r"))
        level = store(pairs.join(last, pairs[group] == last["last group"]).select(group, F.col("j").alias("i"), F.when(F.col("top") == 0, F.col("l")).otherwise(F.sha2(F.concat("l", F.coalesce("r", "l")), 256)).alias("h")), "merkle")
    return ways.select(group, "idx", "leaf", "path")


def proven_root(leaf: Column, path: Column) -> Column:
    """The root that a proof leads to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.when(F.left(s, F.lit(1)) == "<", F.concat(F.substring(s, 2, 64), h)).otherwise(F.concat(h, F.substring(s, 2, 64))), 256))
