"""Queries on agents in groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import agents as A
from tidemark.operators import graphs
from tidemark.plans.catalog import EDGES
from tidemark.plans.registry import query, r6
from tidemark.sources import views
from tidemark.sources.tables import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with scores in thousandths: ``event_id, user_id, micros, event_type, milli``."""
    audit = views.audit(spark, sf_dir)
    return audit.select("event_id", "user_id", "tenant", "micros", "event_type", "approved", F.rint(F.least("latency_ms", F.lit(100)) * 10).cast("bigint").alias("milli"))


SCORED = f"{views.SQL['audit']}, scored AS (SELECT event_id, user_id, tenant, micros, event_type, approved, (least(latency_ms, 100) * 10)::BIGINT AS milli FROM audit)"


@query(f"""WITH {SCORED}, w AS (SELECT user_id AS agent, event_id AS idx, milli AS v, count(*) OVER o AS n, coalesce(sum(milli) OVER o, 0)::BIGINT AS s, coalesce(sum(milli * milli) OVER o, 0)::BIGINT AS q FROM scored WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT agent, idx, CASE WHEN n < 16 OR n * q - s * s <= 0 THEN 0.0 ELSE (n * v - s) / sqrt((n * q - s * s)::DOUBLE) END AS z FROM w) SELECT agent, idx, round(z, 6) AS z, abs(z) > 2 AS anomaly FROM z""")
def behaviour_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's scores against the user's earlier ones (two deviations, so that these tables have some)."""
    obs = scored(spark, sf_dir).select(F.col("user_id").alias("agent"), F.col("event_id").alias("idx"), F.col("milli").alias("value"))
    return A.fingerprints(obs, threshold=2.0).select("agent", "idx", *r6("z"), "anomaly")


@query(f"""WITH {SCORED}, o AS (SELECT user_id AS source, milli / 1000 AS x, micros, lag(micros) OVER (PARTITION BY user_id ORDER BY micros, event_id) AS before, max(micros) OVER (PARTITION BY user_id) AS last FROM scored),
    p AS (SELECT source, round(CASE WHEN before IS NULL THEN (0.5 + x) / 2 ELSE (1 - pow(0.5, (micros - before) / {A.HALF_LIFE})) * x END * pow(0.5, (last - micros) / {A.HALF_LIFE}) * 1e12)::BIGINT AS part FROM o)
    SELECT source, count(*) AS n, round(sum(part) / 1e12, 6) AS score FROM p GROUP BY source""")
def source_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-decayed credibility of each user as a source."""
    obs = scored(spark, sf_dir).select(F.col("user_id").alias("source"), "micros", F.col("event_id").alias("idx"), "milli")
    return A.credibility(obs).select("source", "n", *r6("score"))


@query(f"""WITH {SCORED}, a AS (SELECT user_id AS agent, count(*) AS samples, sum(milli) AS s, sum((NOT approved)::INT) AS h, sum(milli) AS t, sum((event_type = 'error' AND milli > 990)::INT) AS b FROM scored GROUP BY 1)
    SELECT agent, samples, samples >= 32 AND s >= 500 * samples AS coherent, samples >= 32 AND h / samples <= 0.2 AS continuous, t >= 36000 AS experienced, samples >= 32 AND b = 0 AS contained FROM a""")
def attested_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about each user's record."""
    log = scored(spark, sf_dir).select(F.col("user_id").alias("agent"), "milli", (~F.col("approved")).alias("halted"), F.col("milli").alias("seconds"), ((F.col("event_type") == "error") & (F.col("milli") > 990)).alias("breakout"))
    return A.attested(log, 500, 0.2, 10.0)


@query(f"""WITH {SCORED}, r AS (SELECT user_id AS prompt, milli, approved, row_number() OVER (PARTITION BY user_id ORDER BY milli) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM scored)
    SELECT prompt, count(*) AS n, round(sum((NOT approved)::INT) / count(*), 6) AS halt_rate, round(sum(milli) / count(*) / 1000, 6) AS mean, round(coalesce(stddev_samp(milli), 0) / 1000, 6) AS deviation,
        max(CASE WHEN i = greatest(0, least(n - 1, floor((1 - 0.95) / 2 * n))) THEN milli END) AS low, max(CASE WHEN i = greatest(0, least(n - 1, ceil((1 - (1 - 0.95) / 2) * n) - 1)) THEN milli END) AS high,
        CASE WHEN sum((NOT approved)::INT) / count(*) >= 0.5 THEN 'halt' WHEN sum((NOT approved)::INT) / count(*) >= 0.25 THEN 'warn' ELSE 'proceed' END AS action FROM r GROUP BY prompt""")
def trajectory_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halt rates and intervals over the runs of each user."""
    draws = scored(spark, sf_dir).select(F.col("user_id").alias("prompt"), "milli", "approved")
    return A.preflight(draws).select("prompt", "n", *r6("halt_rate", "mean", "deviation"), "low", "high", "action")


_RELATIONS = "relations AS (SELECT src AS source, dst AS target, CASE WHEN (src * 31 + dst) % 40 = 0 THEN 'contradicts' ELSE 'implies' END AS kind FROM edges)"


@query(f"""WITH {EDGES}, {_RELATIONS}, claims AS (SELECT l_partkey AS id, l_returnflag = 'R' AS negated FROM lineitem)
    SELECT id AS source, id AS target, 'polarity conflict' AS reason FROM claims GROUP BY id HAVING min(negated) <> max(negated)
    UNION ALL SELECT source, target, 'direct contradicts' FROM relations WHERE kind = 'contradicts'
    UNION ALL SELECT a.source, b.target, 'transitive via ' || a.target FROM relations a JOIN relations b ON a.target = b.source AND a.kind = 'implies' AND b.kind = 'contradicts'""")
def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts among claims: both polarities, direct ones, one implication away."""
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_returnflag") == "R").alias("negated"))
    src, dst = F.col("src"), F.col("dst")
    kind = F.when((src * 31 + dst) % 40 == 0, "contradicts").otherwise("implies")
    relations = graphs.interactions(views.audit(spark, sf_dir)).select(src.alias("source"), dst.alias("target"), kind.alias("kind"))
    return A.claim_conflicts(claims, relations)


@query("""WITH RECURSIVE edges AS (SELECT n_name AS child, 'region ' || n_regionkey AS parent FROM nation UNION SELECT 'region ' || r_regionkey, CASE WHEN r_regionkey < 2 THEN 'west' ELSE 'east' END FROM region),
    classes AS (SELECT child AS class FROM edges WHERE child <> 'JAPAN' UNION SELECT parent FROM edges), up(node, ancestor) AS (SELECT class, class FROM classes UNION SELECT u.node, e.parent FROM up u JOIN edges e ON u.ancestor = e.child),
    clash AS (SELECT DISTINCT a.node AS class_a, b.node AS class_b FROM up a JOIN up b ON (a.ancestor = 'west' AND b.ancestor = 'east' OR a.ancestor = 'east' AND b.ancestor = 'west') AND a.node < b.node),
    said AS (SELECT s_suppkey AS individual, n_name AS class FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), held AS (SELECT DISTINCT * FROM said WHERE class IN (SELECT class FROM classes))
    SELECT individual, 'unknown_class' AS kind, class AS class_a, NULL::VARCHAR AS class_b FROM said WHERE class NOT IN (SELECT class FROM classes)
    UNION ALL SELECT x.individual, 'disjoint_conflict', class_a, class_b FROM held x JOIN held y USING (individual) JOIN clash ON x.class = class_a AND y.class = class_b""")
def ontology_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of one number in classes that can't go together."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda c: F.concat(F.lit("region "), c)
    edges = nation.select(F.col("n_name").alias("child"), name("n_regionkey").alias("parent")).union(region.select(name("r_regionkey"), F.when(F.col("r_regionkey") < 2, "west").otherwise("east")))
    classes = edges.where("child <> 'JAPAN'").select(F.col("child").alias("class")).union(edges.select("parent")).distinct()
    named = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("class"))
    said = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("individual"), F.col("s_nationkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    disjoint = spark.createDataFrame([("west", "east")], "a string, b string")
    return A.ontology_conflicts(said.join(named, "k").select("individual", "class"), classes, edges, disjoint)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, n_nationkey + k AS dst, (n_nationkey * 7 + k * 5) % 11 + 1 AS cost FROM nation, range(1, 4) r(k) WHERE n_nationkey + k < 25 AND (n_nationkey * 7 + k * 5) % 11 <> 4),
    r(node, cost) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.dst, r.cost + e.cost FROM r JOIN e ON r.node = e.src) SELECT node, min(cost) AS cost FROM r GROUP BY node""")
def policy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest paths over the edges that a policy allows."""
    n, k = F.col("n_nationkey").cast("bigint"), F.col("k")
    steps = table(spark, sf_dir, "nation").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))).where((n + k < 25) & ((n * 7 + k * 5) % 11 != 4))
    return A.shortest_paths(steps.select(n.alias("src"), (n + k).alias("dst"), ((n * 7 + k * 5) % 11 + 1).alias("cost")), 0)


def games(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Payoffs of one game for each supplier number modulo 50: ``game, r, c, u0, u1``."""
    li = table(spark, sf_dir, "lineitem")
    keys = [(F.col("l_suppkey") % 50).alias("game"), (F.col("l_linenumber") % size).cast("bigint").alias("r"), (F.col("l_orderkey") % size).alias("c")]
    return li.groupBy(*keys).agg((F.sum(F.col("l_quantity").cast("bigint")) % 10).alias("u0"), (F.sum("l_partkey") % 10).alias("u1"))


def _games_sql(size: int) -> str:
    return f"games AS (SELECT l_suppkey % 50 AS game, (l_linenumber % {size})::BIGINT AS r, l_orderkey % {size} AS c, (sum(l_quantity::BIGINT) % 10)::BIGINT AS u0, (sum(l_partkey) % 10)::BIGINT AS u1 FROM lineitem GROUP BY 1, 2, 3)"


@query(f"""WITH {_games_sql(3)}, b AS (SELECT *, max(u0) OVER (PARTITION BY game, c) AS b0, max(u1) OVER (PARTITION BY game, r) AS b1 FROM games)
    SELECT game, r, c, u0, u1, u0 = b0 AND u1 = b1 AS nash, greatest(b0 - u0, b1 - u1) AS gain, row_number() OVER (PARTITION BY game ORDER BY CASE WHEN u1 = b1 THEN u0 END DESC NULLS LAST, r, c) = 1 AS leader_choice FROM b""")
def game_equilibria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pure equilibria, deviation gains and the leader's choice of three-by-three games."""
    return A.equilibria(games(spark, sf_dir, 3))


@query(f"""WITH {_games_sql(2)}, g AS (SELECT game, {", ".join(f"max(CASE WHEN r = {r} AND c = {c} THEN {u} END) AS {u}{r}{c}" for u in ("u0", "u1") for r in (0, 1) for c in (0, 1))} FROM games GROUP BY game),
    m AS (SELECT game, (u111 - u110) / nullif(u100 - u110 - u101 + u111, 0) AS p, (u011 - u001) / nullif(u000 - u001 - u010 + u011, 0) AS q FROM g) SELECT game, round(p, 6) AS p, round(q, 6) AS q FROM m WHERE p > 0 AND p < 1 AND q > 0 AND q < 1""")
def mixed_equilibria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed equilibria of two-by-two games."""
    return A.mixed_equilibria(games(spark, sf_dir, 2)).select("game", *r6("p", "q"))


@query("""WITH a AS (SELECT c_custkey AS pool, c_nationkey % 5 + 1 AS v0, c_custkey % 7 + 1 AS v1, c_custkey % 3 * 4 AS d0, c_nationkey % 4 * 3 AS d1 FROM customer), g AS (SELECT pool, x, greatest(1e-6, (v0 * x - d0)::DOUBLE) * greatest(1e-6, (v1 * (20 - x) - d1)::DOUBLE) AS product FROM a, range(0, 21) r(x)),
    k AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY product DESC, x) AS k FROM g) SELECT pool, x::INT AS share0, (20 - x)::INT AS share1, round(product, 6) AS product FROM k WHERE k = 1""")
def nash_bargains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of twenty units between two agents for each customer."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    agents = table(spark, sf_dir, "customer").select(k.alias("pool"), (n % 5 + 1).alias("v0"), (k % 7 + 1).alias("v1"), (k % 3 * 4).alias("d0"), (n % 4 * 3).alias("d1"))
    return A.bargain(agents, 20).select("pool", "share0", "share1", *r6("product"))


_HOUR = 3_600_000_000


@query(f"""WITH {SCORED}, w AS (SELECT tenant AS pool, event_id AS idx, micros, sum(milli) OVER (PARTITION BY tenant ORDER BY micros RANGE BETWEEN {_HOUR - 1} PRECEDING AND CURRENT ROW) / 3600.0::DOUBLE AS rate FROM scored),
    o AS (SELECT *, rate > 0.5 * 1.25 AS over, sum((NOT (rate > 0.5 * 1.25))::INT) OVER (PARTITION BY pool ORDER BY micros, idx) AS calm FROM w)
    SELECT pool, idx, round(rate, 6) AS rate, round(CASE WHEN rate <= 0.5 THEN 0.0 WHEN rate <= 0.625 THEN 0.5 * (rate - 0.5) / 0.125 ELSE 0.5 + 0.5 * least(1.0, (rate - 0.625) / 0.625) END, 6) AS pressure, over,
        over AND micros - min(CASE WHEN over THEN micros END) OVER (PARTITION BY pool, calm) >= 1800000000 AS firing FROM o""")
def shared_overdraws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws on each tenant's shared pool that exceed what it can bear."""
    draws = scored(spark, sf_dir).select(F.col("tenant").alias("pool"), F.col("event_id").alias("idx"), "micros", F.col("milli").alias("amount"))
    return A.overdraws(draws, 0.5, _HOUR, _HOUR // 2).select("pool", "idx", *r6("rate", "pressure"), "over", "firing")


SCALES = {"individual": {"care": 0.8, "speed": 0.2}, "team": {"care": 0.3, "speed": 0.7}, "society": {"care": 1.0, "speed": -0.6}}
_LOGIT = {k: f"1 / (1 + exp(-4 * ({' + '.join(f'{w} * {v}' for v, w in ws.items())})))" for k, ws in SCALES.items()}


@query(f"""WITH i AS (SELECT event_id, least(value, 100) / 50 - 1 AS care, (event_id % 11) / 5.0::DOUBLE - 1 AS speed FROM events), s AS (SELECT event_id, {", ".join(f"{x} AS {k}" for k, x in _LOGIT.items())} FROM i)
    SELECT event_id, round(individual, 6) AS individual, round(team, 6) AS team, round(society, 6) AS society, round((individual + team + society) / 3, 6) AS composite, array_to_string(list_filter([{", ".join(f"CASE WHEN round({k}, 9) < 0.4 THEN '{k}' END" for k in SCALES)}], lambda x: x IS NOT NULL), ',') AS failing,
        (round(abs(individual - team), 9) > 0.5)::INT + (round(abs(individual - society), 9) > 0.5)::INT + (round(abs(team - society), 9) > 0.5)::INT AS conflicts FROM s""")
def scale_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of events on three scales and where the scales disagree."""
    actions = table(spark, sf_dir, "events").select("event_id", (F.least("value", F.lit(100)) / 50 - 1).alias("care"), (F.col("event_id") % 11 / 5.0 - 1).alias("speed"))
    return A.alignment(actions, SCALES).select("event_id", *r6(*SCALES, "composite"), "failing", "conflicts")


@query("""WITH b AS (SELECT s_suppkey AS box_id, s_suppkey * 7 % 45 AS x0, s_suppkey * 7 % 45 + 3 AS x1, s_nationkey % 5 AS z0 FROM supplier), p AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, l_quantity AS x, round(l_discount * 100)::INT AS y, round(l_tax * 100)::INT AS z FROM lineitem)
    SELECT box_id, count(*) AS points FROM p JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN 1 AND 5 AND z BETWEEN z0 AND 6 GROUP BY box_id""")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of line items in each supplier's box."""
    hundred = lambda c: F.round(F.col(c) * 100).cast("int")
    points = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), F.col("l_quantity").alias("x"), hundred("l_discount").alias("y"), hundred("l_tax").alias("z"))
    at = F.col("s_suppkey") * 7 % 45
    boxes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("box_id"), at.alias("x0"), (at + 3).alias("x1"), F.lit(1).alias("y0"), F.lit(5).alias("y1"), (F.col("s_nationkey") % 5).alias("z0"), F.lit(6).alias("z1"))
    return A.points_in_boxes(points, boxes, 3.0).groupBy("box_id").agg(F.count(F.lit(1)).alias("points"))


@query("SELECT event_id, sqrt(x * x + y * y) <= 70 AND sqrt(x * x + y * y) >= 20 AS reachable FROM (SELECT event_id, value AS x, (event_id % 60)::DOUBLE AS y FROM events)")
def arm_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a two-link arm reaches each target."""
    return table(spark, sf_dir, "events").select("event_id", A.reach_two_links(F.col("value"), (F.col("event_id") % 60).cast("double"), 45.0, 25.0).alias("reachable"))


@query("""WITH g AS (SELECT user_id, count(value) AS n, sum(round(cos(value) * 1e9)::BIGINT) / 1e9 / count(value) AS c, sum(round(sin(value) * 1e9)::BIGINT) / 1e9 / count(value) AS s FROM events GROUP BY 1) SELECT user_id, n, round(sqrt(c * c + s * s), 6) AS r FROM g""")
def phase_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's phases agree."""
    return A.order_parameter(table(spark, sf_dir, "events").select(F.col("user_id").alias("group"), F.col("value").alias("phase"))).select(F.col("group").alias("user_id"), "n", *r6("r"))


@query()
def walk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stationary distribution of a walk over the interaction graph; iterated to a tolerance, so there is no plain SQL."""
    return A.stationary(graphs.interactions(views.audit(spark, sf_dir))).select("node", *r6("p"))


@query(f"""WITH {views.SQL["corrections"]}, g AS (SELECT t, sum(((milli >= t) = (label = 1))::INT) AS good, sum(((milli >= t) <> (label = 1))::INT) AS bad FROM corrections, range(50, 951, 10) r(t) GROUP BY t),
    l AS (SELECT t, ln(t / 1000 * (1 - t / 1000)) + good * ln(0.99) + bad * ln(1 - 0.99) AS l FROM g), e AS (SELECT t, exp(l - max(l) OVER ()) AS e FROM l) SELECT t, round(e / sum(e) OVER (), 6) AS posterior FROM e""")
def threshold_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior over thresholds, exact on a grid."""
    from tidemark.operators import stats

    sweep = stats.threshold_sweep(views.corrections(spark, sf_dir))
    counts = sweep.select("t", (F.col("tp") + F.col("tn")).alias("good"), (F.col("pos") - F.col("tp") + F.col("neg") - F.col("tn")).alias("bad"))
    return A.threshold_posterior(counts).select("t", *r6("posterior"))


@query(f"""WITH {SCORED}, c AS (SELECT user_id AS tenant, event_type AS action, count(*) AS k FROM scored GROUP BY 1, 2), q AS (SELECT action, sum(k) / sum(sum(k)) OVER () AS q FROM c GROUP BY 1), n AS (SELECT tenant, sum(k) AS n FROM c GROUP BY 1),
    x AS (SELECT n.tenant, n.n, coalesce(c.k, 0) / n.n AS p, q.q FROM n CROSS JOIN q LEFT JOIN c ON c.tenant = n.tenant AND c.action = q.action) SELECT tenant, n, round(sum((p - q) * (p - q) / q), 6) AS chi2 FROM x GROUP BY 1, 2""", longs="n")
def action_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's actions depart from everyone's."""
    return A.action_divergence(scored(spark, sf_dir).select(F.col("user_id").alias("tenant"), F.col("event_type").alias("action"))).select("tenant", "n", *r6("chi2"))


@query("""WITH p AS (SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(greatest(0.0, least(1.0, c)), 6) AS similarity, CASE WHEN c < 0.15 THEN 'hallucinated' WHEN c < 0.45 THEN 'uncertain' ELSE 'consistent' END AS band FROM p""")
def similarity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of similarity between each vector and the next."""
    v = table(spark, sf_dir, "embeddings")
    pairs = v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return A.similarity_bands(pairs).select("vec_id", *r6("similarity"), "band")
