"""Agents in groups: fingerprints, credibility, claims and ontologies, games, shared resources, spaces, random walks.

Sums that are compared are sums of whole numbers, so results do not depend on the order of rows. Empty inputs give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import store

HALF_LIFE = 7 * 86400 * 1_000_000


def fingerprints(obs: DataFrame, least: int = 16, threshold: float = 3.0) -> DataFrame:
    """``z`` of each observation (``agent, idx, value`` whole numbers) against the agent's earlier ones, and ``anomaly``.

    z is 0 until there are ``least`` earlier observations, and where they do not vary. Every observation joins the
    record, anomalies too.
    """
    w = Window.partitionBy("agent").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("value")
    o = obs.withColumns({"n": F.count("value").over(w), "s": F.sum("value").over(w), "q": F.sum(v * v).over(w)})
    spread = F.col("n") * F.col("q") - F.col("s") * F.col("s")  # n^2 times the population variance, exact
    z = F.when((F.col("n") < least) | (spread <= 0), 0.0).otherwise((F.col("n") * v - F.col("s")) / F.sqrt(spread.cast("double")))
    return o.withColumn("z", z).withColumn("anomaly", F.abs("z") > threshold).drop("n", "s", "q")


def credibility(obs: DataFrame, half_life: int = HALF_LIFE, prior: float = 0.5) -> DataFrame:
    """``source, n, score``: the last value of a time-decayed average of signals (``source, micros, idx, milli``).

    The first observation counts as (prior + signal) / 2; a later one takes the weight 1 - 0.5^(gap / half-life) and
    leaves the rest to the score before it. The weights of all that follow telescope to one decay up to the last
    observation, so the fold is a sum.
    """
    by = Window.partitionBy("source")
    o = obs.withColumns({"before": F.lag("micros").over(by.orderBy("micros", "idx")), "last": F.max("micros").over(by)})
    decay = lambda gap: F.pow(F.lit(0.5), gap / half_life)
    signal = F.col("milli") / 1000
    own = F.when(F.col("before").isNull(), (prior + signal) / 2).otherwise((1 - decay(F.col("micros") - F.col("before"))) * signal)
    part = F.round(own * decay(F.col("last") - F.col("micros")) * 1e12).cast("bigint")
    return o.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.sum(part) / 1e12).alias("score"))


def attested(log: DataFrame, coherence: int = 500, halt_rate: float = 0.3, hours: float = 1.0, samples: int = 32) -> DataFrame:
    """Four statements about each agent's record (``agent, milli, halted, seconds, breakout``), each with its least sample count."""
    n = F.count(F.lit(1))
    a = log.groupBy("agent").agg(n.alias("samples"), F.sum("milli").alias("s"), F.count_if("halted").alias("h"), F.sum(F.greatest("seconds", F.lit(0))).alias("t"), F.count_if("breakout").alias("b"))
    enough = F.col("samples") >= samples
    return a.select("agent", "samples", (enough & (F.col("s") >= coherence * F.col("samples"))).alias("coherent"), (enough & (F.col("h") / F.col("samples") <= halt_rate)).alias("continuous"), (F.col("t") >= hours * 3600).alias("experienced"), (enough & (F.col("b") == 0)).alias("contained"))


def preflight(draws: DataFrame, halt: float = 0.5, warn: float = 0.25, level: float = 0.95) -> DataFrame:
    """By prompt, over simulated runs (``prompt, milli, approved``): halt rate, mean, sample deviation, interval, action.

    Runs are counted by score first, so a hot prompt is at most 1001 rows after the map side. The interval holds the
    order statistics floor(lo n) and ceil(hi n) - 1, counted from 0.
    """
    c = draws.groupBy("prompt", "milli").agg(F.count(F.lit(1)).alias("c"), F.count_if(~F.col("approved")).alias("bad"))
    w = Window.partitionBy("prompt")
    c = c.withColumns({"upto": F.sum("c").over(w.orderBy("milli")), "n": F.sum("c").over(w)})
    lo = (1 - level) / 2
    low = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(lo * F.col("n"))))
    high = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.ceil((1 - lo) * F.col("n")) - 1))
    out = c.groupBy("prompt").agg(F.sum("c").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("milli") * F.col("c")).alias("s"), F.sum(F.col("milli") * F.col("milli") * F.col("c")).alias("q"), F.min(F.when(F.col("upto") > low, F.col("milli"))).alias("low"), F.min(F.when(F.col("upto") > high, F.col("milli"))).alias("high"))
    n, rate = F.col("n"), F.col("bad") / F.col("n")
    deviation = F.when(n < 2, 0.0).otherwise(F.sqrt((n * F.col("q") - F.col("s") * F.col("s")) / (n * (n - 1)))) / 1000
    return out.select("prompt", "n", rate.alias("halt_rate"), (F.col("s") / n / 1000).alias("mean"), deviation.alias("deviation"), "low", "high", F.when(rate >= halt, "halt").when(rate >= warn, "warn").otherwise("proceed").alias("action"))


def claim_conflicts(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """``source, target, reason``: claims asserted both ways, direct contradictions, and those one implication away.

    ``claims`` has ``id, negated``; ``relations`` has ``source, target, kind`` (implies or contradicts).
    """
    both = claims.groupBy("id").agg(F.min("negated").alias("lo"), F.max("negated").alias("hi")).where("lo <> hi").select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit("polarity conflict").alias("reason"))
    no = relations.where("kind = 'contradicts'").select("source", "target")
    yes = relations.where("kind = 'implies'").select("source", F.col("target").alias("via")).distinct()
    direct = no.withColumn("reason", F.lit("direct contradicts"))
    steps = yes.join(no.distinct().select(F.col("source").alias("via"), "target"), "via").select("source", "target", F.concat(F.lit("transitive via "), F.col("via").cast("string")).alias("reason"))
    return both.unionByName(direct).unionByName(steps)


def ancestors(edges: DataFrame) -> DataFrame:
    """``node, ancestor``: the transitive closure of ``child, parent`` edges; paths double each round."""
    closure = store(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "closure")
    size = closure.count()
    while True:
        longer = closure.join(closure.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("higher")), "ancestor").select("node", F.col("higher").alias("ancestor"))
        closure = store(closure.unionByName(longer).distinct(), "closure")
        grown = closure.count()
        if grown == size:
            return closure
        size = grown


def ontology_conflicts(assertions: DataFrame, classes: DataFrame, edges: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``individual, kind, class_a, class_b``: unknown classes, and pairs of classes with disjoint ancestors (or selves).

    Class pairs in conflict are worked out once, over the classes; individuals then meet them by an equi-join.
    """
    unknown = assertions.join(classes, "class", "left_anti").select("individual", F.lit("unknown_class").alias("kind"), F.col("class").alias("class_a"), F.lit(None).cast("string").alias("class_b"))
    up = ancestors(edges).unionByName(classes.select(F.col("class").alias("node"), F.col("class").alias("ancestor"))).distinct()
    ways = disjoint.select("a", "b").unionByName(disjoint.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    clash = up.select(F.col("node").alias("class_a"), F.col("ancestor").alias("a")).join(ways, "a").join(up.select(F.col("node").alias("class_b"), F.col("ancestor").alias("b")), "b").select("class_a", "class_b").where("class_a < class_b").distinct()
    held = assertions.join(classes, "class", "left_semi").distinct()
    first = held.select("individual", F.col("class").alias("class_a")).join(clash, "class_a")
    pairs = first.join(held.select("individual", F.col("class").alias("class_b")), ["individual", "class_b"])
    return unknown.unionByName(pairs.select("individual", F.lit("disjoint_conflict").alias("kind"), "class_a", "class_b"))


def shortest_paths(edges: DataFrame, start: int) -> DataFrame:
    """``node, cost``: least cost from ``start`` along ``src, dst, cost`` edges of non-negative whole costs.

    Only nodes whose cost fell in a round pass it on in the next; each round's costs are a written table.
    """
    best = store(edges.sparkSession.createDataFrame([(start, 0)], "node bigint, cost bigint"), "paths")
    changed = best
    hops = edges.groupBy("src", "dst").agg(F.min("cost").alias("step"))
    while True:
        offers = changed.join(hops, changed["node"] == hops["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("offer"))
        merged = store(best.join(offers, "node", "full").select("node", F.least("cost", "offer").alias("cost"), (F.col("cost").isNull() | (F.col("offer") < F.col("cost"))).alias("fell")), "paths")
        best, changed = merged.select("node", "cost"), merged.where("fell").select("node", "cost")
        if changed.isEmpty():
            return best


def equilibria(payoffs: DataFrame) -> DataFrame:
    """Profiles of two-player games (``game, r, c, u0, u1``): pure equilibria, gain from deviating, leader's optimum.

    The leader is player 0; of the follower's best answers the leader's favourite counts, ties go to the smallest r, c.
    """
    best0, best1 = F.max("u0").over(Window.partitionBy("game", "c")), F.max("u1").over(Window.partitionBy("game", "r"))
    p = payoffs.withColumns({"b0": best0, "b1": best1})
    p = p.withColumns({"nash": (F.col("u0") == F.col("b0")) & (F.col("u1") == F.col("b1")), "gain": F.greatest(F.col("b0") - F.col("u0"), F.col("b1") - F.col("u1"))})
    order = Window.partitionBy("game").orderBy(F.desc(F.when(F.col("u1") == F.col("b1"), F.col("u0"))), "r", "c")
    return p.withColumn("leader_choice", F.row_number().over(order) == 1).drop("b0", "b1")


def mixed_equilibria(payoffs: DataFrame) -> DataFrame:
    """``game, p, q``: the mixed equilibrium of 2x2 games (strategies 0 and 1) inside the simplex; other games have no row."""
    cell = lambda u, r, c: F.max(F.when((F.col("r") == r) & (F.col("c") == c), F.col(u)))
    g = payoffs.groupBy("game").agg(*[cell(u, r, c).alias(f"{u}{r}{c}") for u in ("u0", "u1") for r in (0, 1) for c in (0, 1)], F.max(F.greatest("r", "c")).alias("size")).where("size = 1")
    p = (F.col("u111") - F.col("u110")) / F.nullif(F.col("u100") - F.col("u110") - F.col("u101") + F.col("u111"), F.lit(0))
    q = (F.col("u011") - F.col("u001")) / F.nullif(F.col("u000") - F.col("u001") - F.col("u010") + F.col("u011"), F.lit(0))
    return g.select("game", p.alias("p"), q.alias("q")).where("p > 0 AND p < 1 AND q > 0 AND q < 1")


def bargain(agents: DataFrame, units: int) -> DataFrame:
    """Split of ``units`` between two agents (``pool, v0, v1, d0, d1``) of largest Nash product of surpluses over the disagreement.

    A surplus is at least one millionth; the smallest share of agent 0 wins ties.
    """
    grid = agents.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(units))))
    surplus = lambda v, x, d: F.greatest(F.lit(1e-6), (F.col(v) * x - F.col(d)).cast("double"))
    grid = grid.withColumn("product", surplus("v0", F.col("x"), "d0") * surplus("v1", units - F.col("x"), "d1"))
    best = grid.groupBy("pool").agg(F.max(F.struct("product", (-F.col("x")).alias("back"))).alias("b"))
    return best.select("pool", (-F.col("b.back")).alias("share0"), (units + F.col("b.back")).alias("share1"), F.col("b.product").alias("product"))


def overdraws(draws: DataFrame, sustainable: float, window: int, grace: int, factor: float = 1.25) -> DataFrame:
    """Draws (``pool, idx, micros, amount``) with the rate of the trailing window, its pressure and ``firing``.

    The rate is over budget above ``sustainable * factor`` (amounts a second); an alarm fires once it has been so for
    ``grace`` microseconds without a break.
    """
    w = Window.partitionBy("pool").orderBy("micros")
    d = draws.withColumn("rate", F.sum("amount").over(w.rangeBetween(-window + 1, 0)) / (window / 1e6))
    limit = sustainable * factor
    r = F.col("rate")
    pressure = F.when(r <= sustainable, 0.0).when(r <= limit, 0.5 * (r - sustainable) / (limit - sustainable)).otherwise(0.5 + 0.5 * F.least(F.lit(1.0), (r - limit) / limit))
    ordered = Window.partitionBy("pool").orderBy("micros", "idx")
    d = d.withColumns({"pressure": pressure, "over": r > limit})
    d = d.withColumn("calm", F.count_if(~F.col("over")).over(ordered))
    since = F.min(F.when(F.col("over"), F.col("micros"))).over(Window.partitionBy("pool", "calm"))
    return d.withColumn("firing", F.col("over") & (F.col("micros") - since >= grace)).drop("calm")


def alignment(actions: DataFrame, scales: dict[str, dict[str, float]], steepness: float = 4.0, allow: float = 0.4, conflict: float = 0.5) -> DataFrame:
    """A score for each scale (logistic of weighted impacts), the composite, failing scales and scales that disagree.

    Impacts are columns; a null impact counts as 0. Scales weigh the same.
    """
    made = {k: 1 / (1 + F.exp(-steepness * sum((w * F.coalesce(F.col(v), F.lit(0.0)) for v, w in ws.items()), F.lit(0.0)))) for k, ws in scales.items()}
    df, names = actions.withColumns(made), list(scales)
    failing = F.array_join(F.array_compact(F.array(*[F.when(F.round(k, 9) < allow, F.lit(k)) for k in names])), ",")
    apart = sum((F.when(F.round(F.abs(F.col(a) - F.col(b)), 9) > conflict, 1).otherwise(0) for i, a in enumerate(names) for b in names[i + 1 :]), F.lit(0))
    return df.withColumns({"composite": sum((F.col(k) for k in names), F.lit(0.0)) / len(names), "failing": failing, "conflicts": apart})


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """``point_id, box_id`` for points (``x, y, z``) in closed boxes (``x0, x1, y0, y1, z0, z1``).

    Boxes are listed under every cell of width ``cell`` along x that they touch, and meet points of the cell by an
    equi-join; choose the cell near a box's usual width.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    b = boxes.where("x0 <= x1").withColumn("cell", F.explode(F.sequence(at("x0"), at("x1"))))
    hit = (F.col("x").between(F.col("x0"), F.col("x1"))) & (F.col("y").between(F.col("y0"), F.col("y1"))) & (F.col("z").between(F.col("z0"), F.col("z1")))
    return points.withColumn("cell", at("x")).join(b, "cell").where(hit).select("point_id", "box_id")


def reach_two_links(x: Column, y: Column, l1: float, l2: float) -> Column:
    """Whether a planar arm of two links reaches a point."""
    d = F.sqrt(x * x + y * y)
    return (d <= l1 + l2) & (d >= abs(l1 - l2))


def order_parameter(phases: DataFrame) -> DataFrame:
    """``group, n, r``: how far phases (radians) agree, |mean exp(i phase)|; parts are summed as whole billionths."""
    part = lambda f: F.sum(F.round(f("phase") * 1e9).cast("bigint")) / 1e9 / F.count("phase")
    g = phases.groupBy("group").agg(F.count("phase").alias("n"), part(F.cos).alias("c"), part(F.sin).alias("s"))
    return g.select("group", "n", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("r"))


def stationary(edges: DataFrame, laziness: float = 0.5, tolerance: float = 1e-6, most_steps: int = 256, between: int = 8) -> DataFrame:
    """``node, p``: stationary distribution of a lazy random walk over ``src, dst, weight``; nodes without ways out go anywhere.

    Mass moves by a join and a sum. The vector is written every ``between`` steps (every step where mass of nodes
    without ways out must be shared, since a step then reads the vector twice), and the last step's change is
    compared with ``tolerance``.
    """
    nodes = store(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "walk")
    n = nodes.count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    follow = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(out, "src").select("src", "dst", ((1 - laziness) * F.col("weight") / F.col("total")).alias("share"))
    stay = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(laziness).alias("share"))
    moves = store(follow.unionByName(stay), "walk")
    ends = store(nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti"), "walk")
    loose = not ends.isEmpty()

    def step(p: DataFrame) -> DataFrame:
        got = p.join(moves, p["node"] == moves["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("share")).alias("p"))
        if not loose:
            return got
        lost = p.join(ends, "node").agg((F.coalesce(F.sum("p"), F.lit(0.0)) * (1 - laziness) / n).alias("lost"))  # one row
        return store(got.crossJoin(F.broadcast(lost)).select("node", (F.col("p") + F.col("lost")).alias("p")), "walk")

    p = nodes.withColumn("p", F.lit(1.0 / max(n, 1)))
    for _ in range(0, most_steps, between):
        for _ in range(between - 1):
            p = step(p)
        was = store(p, "walk")
        p = store(step(was), "walk")
        change = p.join(was.withColumnRenamed("p", "was"), "node").agg(F.sum(F.abs(F.col("p") - F.col("was"))).alias("d")).first()["d"]
        if (change or 0.0) < tolerance:
            break
    return p


def threshold_posterior(counts: DataFrame, right: float = 0.99) -> DataFrame:
    """``t, posterior`` over a grid of thresholds in thousandths, from right and wrong decisions at each (``t, good, bad``).

    Beta(2, 2) prior; a label follows the threshold with probability ``right``. Exact on the grid, no sampling.
    """
    t = F.col("t") / 1000
    c = counts.withColumn("l", F.log(t * (1 - t)) + F.col("good") * F.log(F.lit(right)) + F.col("bad") * F.log(F.lit(1 - right)))
    everything = Window.partitionBy()  # one row per threshold of the grid
    c = c.withColumn("e", F.exp(F.col("l") - F.max("l").over(everything)))
    return c.select("t", (F.col("e") / F.sum("e").over(everything)).alias("posterior"))


def action_divergence(decisions: DataFrame) -> DataFrame:
    """``tenant, n, chi2``: squared distance of each tenant's action shares from all tenants', relative to the latter."""
    c = decisions.groupBy("tenant", "action").agg(F.count(F.lit(1)).alias("k"))
    everyone = c.groupBy("action").agg(F.sum("k").alias("a"))
    whole = everyone.agg(F.sum("a").alias("total"))  # one row
    n = c.groupBy("tenant").agg(F.sum("k").alias("n"))
    shares = everyone.crossJoin(F.broadcast(whole)).select("action", (F.col("a") / F.col("total")).alias("q"))
    # An action that a tenant never took adds q; all q together are 1, so only the taken ones need rows.
    p, q = F.col("k") / F.col("n"), F.col("q")
    part = F.round(((p - q) * (p - q) / q - q) * 1e12).cast("bigint")
    return c.join(n, "tenant").join(shares, "action").groupBy("tenant", "n").agg((1 + F.sum(part) / 1e12).alias("chi2"))


def similarity_bands(pairs: DataFrame, low: float = 0.15, high: float = 0.45) -> DataFrame:
    """``similarity`` of two vectors (0 if one has no length) clamped to [0, 1], and its ``band``."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b"))
    cos = F.when(size > 0, F.round(dot("a", "b") / size, 9)).otherwise(0.0)
    df = pairs.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)))
    return df.withColumn("band", F.when(F.col("similarity") < low, "hallucinated").when(F.col("similarity") < high, "uncertain").otherwise("consistent"))
