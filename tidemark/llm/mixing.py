"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source has the same expected multiplicity, target over source size. Its whole part is taken for
sure; the rest is an inclusion probability, moved to 0 or 1 by the cube method so that the source's token total and
document total stay where they are. The flight phase keeps a window of three fractional units: two balancing rows
leave a one-dimensional null space, a random step along it keeps both totals and settles at least one unit. Blocks of
a source fly on their own, and their unsettled units fly on together. A dozen units of all sizes wait out the flight;
they and the last two land on the vertex whose totals are nearest. Randomness is a hash of ids and a seed, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import id_type, marked
from tidemark.sources.shared import store

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a source that fly in one task.
BLOCK_DOCS = 20_000
#: Sources whose totals may be gathered to set the targets.
MAX_SOURCES = 200_000
EPS = 1e-9
#: Units of a block that wait for the landing.
RESERVE = 12


def source_targets(sizes: Sequence[float], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Targets that share ``share`` of all sizes by weight, none above ``most`` times its source's size.

    The excess of sources at their limit is shared again by weight among the others until none is above.
    """
    caps = [most * s for s in sizes]
    left, open_ = share * float(sum(sizes)), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > caps[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def reserve(sizes: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Up to RESERVE fractional units, spread evenly over the ranks of positive sizes, that wait for the landing."""
    open_ = np.flatnonzero((probs > EPS) & (probs < 1 - EPS) & (sizes > 0))
    by_size = open_[np.argsort(sizes[open_], kind="stable")]
    return by_size[np.unique(np.linspace(0, len(by_size) - 1, min(RESERVE, len(by_size))).round().astype(int))] if len(by_size) else by_size


def flight(sizes: np.ndarray, probs: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move probabilities to 0 or 1 along null vectors of (size, count).

    Both totals are kept. At most two units and the landing's reserve stay fractional.
    """
    p = probs.astype(float).tolist()
    size, u = sizes.astype(float).tolist(), draws.tolist()
    waits = set(reserve(sizes, probs).tolist())
    window: list[int] = []
    for unit in range(len(p)):
        if EPS < p[unit] < 1 - EPS and unit not in waits:
            window.append(unit)
        while len(window) >= 3:
            i, j, k = window
            # The cross product of the rows (size) and (1, 1, 1) spans the null space.
            d = (size[j] - size[k], size[k] - size[i], size[i] - size[j])
            if d == (0.0, 0.0, 0.0):
                d = (1.0, -1.0, 0.0)
            up = down = math.inf
            for v, x in zip(window, d, strict=True):
                if x > 0:
                    up, down = min(up, (1 - p[v]) / x), min(down, p[v] / x)
                elif x < 0:
                    up, down = min(up, -p[v] / x), min(down, (p[v] - 1) / x)
            step = up if u[k] * (up + down) < down else -down
            for v, x in zip(window, d, strict=True):
                p[v] += step * x
                if p[v] < EPS:
                    p[v] = 0.0
                elif p[v] > 1 - EPS:
                    p[v] = 1.0
            window = [v for v in window if 0.0 < p[v] < 1.0]
    return np.array(p)


def landing(sizes: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Settle the units that the flight left, RESERVE + 2 at most: the vertex whose totals are nearest.

    A missing document weighs as much as a fiftieth of a mean unit's tokens.
    """
    open_ = np.flatnonzero((probs > EPS) & (probs < 1 - EPS))
    on = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    miss = np.abs(on @ sizes[open_] - sizes[open_] @ probs[open_]) + 0.02 * (sizes[open_].mean() if len(open_) else 0) * np.abs(on.sum(axis=1) - probs[open_].sum())
    out = np.round(probs)
    out[open_] = on[int(miss.argmin())]
    return out


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, row_col: str | None = None) -> DataFrame:
    """How often each document enters a mix that gives each source its target number of words.

    Returns one row per input row: ``doc_id, size, source_size, target, taken, times``; ``taken`` is ``times * size``
    and ``times`` never exceeds ``most`` (rounded up to a whole number). Sources in code-point order (null last) weigh
    ``weights``, repeating; they share ``share`` of all sizes, capped at ``most`` times their own. Null texts have size
    0; documents of size 0 take no words. A repeated id is a unit for each of its rows. A source without words has
    target 0. An empty table gives an empty result; other columns are ignored. ``row_col`` names a long that tells rows
    apart; it is returned as a last column.
    """
    spark, kind = docs.sparkSession, id_type(docs, id_col)
    units = marked(docs, row_col, [(id_col, "doc_id"), (text_col, "text"), (source_col, "source")])
    units = units.select("doc_id", "source", word_count(F.col("text")).alias("size"), "mark", F.monotonically_increasing_id().alias("unit"))
    units = store(units, "mix-units")
    totals = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: the targets are set on the driver from one row per source")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    wanted = source_targets([r.source_size for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
    plan = [(r.source, i, int(r.source_size), float(t), float(t / r.source_size) if r.source_size else 0.0, max(1, math.ceil(r.n_docs / BLOCK_DOCS))) for i, (r, t) in enumerate(zip(totals, wanted, strict=True))]
    planned = spark.createDataFrame(plan, "source string, source_no int, source_size bigint, target double, rate double, blocks int")
    # One row per source, at most MAX_SOURCES of them.
    known = units.join(F.broadcast(planned) if len(plan) <= 10_000 else planned, units["source"].eqNullSafe(planned["source"])).drop("source")
    # Rows without an id have no draw of their own but by their place; they would all share a block.
    known = known.withColumn("draw", F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.col("unit"), F.col("size"))).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))))
    known = known.withColumn("block", F.pmod(F.col("draw"), F.col("blocks")))
    known = known.withColumn("whole", F.floor("rate")).withColumn("prob", F.col("rate") - F.floor("rate"))

    shape = f"doc_id {kind}, source_no int, size bigint, source_size bigint, target double, whole bigint, prob double, draw bigint, block bigint, mark bigint"

    def fly(last: bool):
        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("draw", "ascending"), ("size", "ascending"), ("mark", "ascending")])
            draw, size, prob = (rows[c].to_numpy() for c in ("draw", "size", "prob"))
            u = (draw.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / float(1 << 53)
            prob = flight(size, prob, u)
            return rows.set_column(rows.column_names.index("prob"), "prob", pa.array(landing(size, prob) if last else prob, pa.float64()))

        return run

    flown = store(known.select(*[c.split()[0] for c in shape.split(", ")]).groupBy("source_no", "block").applyInArrow(fly(False), shape), "mix-flown")
    fractional = (F.col("prob") > EPS) & (F.col("prob") < 1 - EPS)
    settled, rest = flown.where(~fractional), flown.where(fractional)
    # A block leaves RESERVE + 2 units at most, so the blocks of the largest source shrink more than thousandfold a round.
    left = RESERVE + 2
    most_blocks = max((p[5] for p in plan), default=1)
    while left * most_blocks > BLOCK_DOCS:
        most_blocks = math.ceil(left * most_blocks / BLOCK_DOCS)
        again = store(rest.withColumn("block", F.pmod(F.col("draw"), F.lit(most_blocks))).groupBy("source_no", "block").applyInArrow(fly(False), shape), "mix-flown")
        settled, rest = settled.unionByName(again.where(~fractional)), again.where(fractional)
    done = settled.unionByName(rest.groupBy("source_no").applyInArrow(fly(True), shape))
    times = (F.col("whole") + F.round("prob")).cast("bigint")
    return done.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), *([F.col("mark").alias(row_col)] if row_col else []))
