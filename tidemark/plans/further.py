"""Queries over the further operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import evidence, further, safety
from tidemark.operators import pairs as pair_operators
from tidemark.plans import sqltext as S
from tidemark.plans.catalog import ATTACKED, attacked
from tidemark.plans.registry import SQL, query, r6
from tidemark.plans.search import facts
from tidemark.sources import views
from tidemark.sources.tables import table


@query(f"""WITH o AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS seq, role, lower(trim(coalesce(text, ''), ' ')) AS t FROM conversations), g AS (SELECT *, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM o WHERE length(t) >= 20),
    p AS (SELECT a.seq, b.seq AS output, round({S.jaccard("a.g", "b.g")}, 9) AS j FROM g a JOIN g b ON a.role = 'user' AND b.role = 'assistant' AND b.seq < a.seq AND b.seq >= a.seq - 1000), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY j DESC, output) AS k FROM p)
    SELECT seq, output, round(j, 6) AS likeness, CASE WHEN j > 0.8 THEN 'high' WHEN j > 0.6 THEN 'medium' ELSE 'low' END AS severity FROM r WHERE k = 1 AND j >= 0.2""")
def echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that repeat any of the thousand turns before them (from a likeness of 0.2, so that these tables have some)."""
    c = table(spark, sf_dir, "conversations")
    seq = F.row_number().over(Window.orderBy("conv_id", "turn"))  # the test table has no order of its own
    return further.echoes(c.select(seq.cast("bigint").alias("seq"), "role", "text"), least=0.2).select("seq", "output", *r6("likeness"), "severity")


@query("""WITH p AS (SELECT o_orderkey AS point_id, (o_orderkey * 7 % 1000) / 10 AS x, (o_custkey * 13 % 1000) / 10 AS y, (o_orderkey * 3 % 500) / 10 AS z FROM orders), s AS (SELECT s_suppkey AS sphere_id, (s_suppkey * 37 % 1000) / 10 AS cx, (s_suppkey * 91 % 1000) / 10 AS cy, 25.0 AS cz, 5.0 + s_suppkey % 20 AS r FROM supplier)
    SELECT point_id, sphere_id FROM p JOIN s ON (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) <= r * r""")
def points_in_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points in suppliers' spheres."""
    n = lambda c, k, m: F.col(c) * k % m / 10
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), n("o_orderkey", 7, 1000).alias("x"), n("o_custkey", 13, 1000).alias("y"), n("o_orderkey", 3, 500).alias("z"))
    spheres = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sphere_id"), n("s_suppkey", 37, 1000).alias("cx"), n("s_suppkey", 91, 1000).alias("cy"), F.lit(25.0).alias("cz"), (5.0 + F.col("s_suppkey") % 20).alias("radius"))
    return further.points_in_spheres(points, spheres, 10.0)


@query("""WITH b AS (SELECT p_partkey AS box_id, (p_partkey * 37 % 1000) / 10 AS x0, (p_partkey * 37 % 1000) / 10 + 10 + p_partkey % 7 AS x1, (p_partkey * 91 % 1000) / 10 AS y0, (p_partkey * 91 % 1000) / 10 + 15 AS y1, (p_partkey % 10)::DOUBLE AS z0, p_partkey % 10 + 4.5 AS z1 FROM part)
    SELECT p.box_id AS a, q.box_id AS b FROM b p JOIN b q ON p.box_id < q.box_id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1 AND p.z0 <= q.z1 AND q.z0 <= p.z1""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes that touch."""
    k = F.col("p_partkey")
    x, y = k * 37 % 1000 / 10, k * 91 % 1000 / 10
    boxes = table(spark, sf_dir, "part").select(k.alias("box_id"), x.alias("x0"), (x + 10 + k % 7).alias("x1"), y.alias("y0"), (y + 15).alias("y1"), (k % 10).cast("double").alias("z0"), (k % 10 + 4.5).alias("z1"))
    return further.box_overlaps(boxes, 5.0)


@query("SELECT event_id, round(1.5 * cos(q1) + cos(q1 + q2), 6) AS x, round(1.5 * sin(q1) + sin(q1 + q2), 6) AS y, q1 BETWEEN -1 AND 1 AND q2 BETWEEN 0 AND 2 AS within FROM (SELECT event_id, (event_id % 40) / 10 - 2 AS q1, (event_id % 50) / 10 - 2 AS q2 FROM events) p")
def arm_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of a planar arm against its joints' limits."""
    poses = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 40 / 10 - 2).alias("q1"), (F.col("event_id") % 50 / 10 - 2).alias("q2"))
    return further.arm_checks(poses, 1.5, 1.0, (-1.0, 1.0, 0.0, 2.0)).select("event_id", *r6("x", "y"), "within")


@query()
def active_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version in force after each change of each user's registry; a stack that SQL cannot keep."""
    e = views.audit(spark, sf_dir)
    action = F.when(F.col("event_type") == "click", "publish").when(F.col("event_type") == "view", "promote").when(F.col("event_type") == "error", "rollback").otherwise("none")
    return further.active_versions(e.select(F.col("user_id").alias("tenant"), "micros", "event_id", action.alias("action"), (F.col("tokens") % 20).alias("version")))


_ACTION = "CASE event_id % 50 WHEN 0 THEN 'delete the table' WHEN 1 THEN 'preview it' ELSE 'lint only' END"


@query(f"""WITH a AS (SELECT user_id AS session, event_id AS key, {_ACTION} AS action FROM events), r AS (SELECT session, key, CASE WHEN action LIKE 'delete%' THEN 0.05 ELSE 0.95 END::DOUBLE AS r FROM a),
    f AS (SELECT session, b, max((('0x' || substr(md5(key || '-' || b), 1, 8))::BIGINT / 4294967296 >= r)::INT) AS bad, count(*) AS n FROM r, range(64) x(b) GROUP BY 1, 2), s AS (SELECT session, max(n) AS actions, sum(bad)::BIGINT AS breaches FROM f GROUP BY 1),
    w AS (SELECT *, breaches / 64 AS p, (breaches / 64 + 3.8416::DOUBLE / 128) / (1 + 3.8416::DOUBLE / 64) AS c, 1.96::DOUBLE * sqrt((breaches / 64 * (1 - breaches / 64) + 3.8416::DOUBLE / 256) / 64) / (1 + 3.8416::DOUBLE / 64) AS d FROM s)
    SELECT session, actions, breaches, round(p, 6) AS share, round(greatest(0.0, c - d), 6) AS low, round(least(1.0, c + d), 6) AS high FROM w""")
def drawn_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a session's actions turn out irreversible, over 64 tries."""
    k = F.col("event_id") % 50
    actions = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("key"), F.when(k == 0, "delete the table").when(k == 1, "preview it").otherwise("lint only").alias("action"))
    return further.drawn_breaches(actions).select("session", "actions", "breaches", *r6("share", "low", "high"))


@query("SELECT o_custkey AS account, count(*) AS leaves, true AS all_proven FROM orders GROUP BY o_custkey")
def challenged_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commitments to each customer's orders, opened where their root says."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), "o_orderkey", F.col("o_orderstatus").alias("value"), F.md5(F.col("o_orderkey").cast("string")).alias("salt"))
    found = further.challenged_proofs(rows, "account", "o_orderkey", "value", "salt")
    return found.select("account", "leaves", ((F.col("challenged") > 0) & (F.col("proven") == F.col("challenged"))).alias("all_proven"))


@query()
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where personal data stands in documents; DuckDB gives no offsets."""
    return further.pii_spans(attacked(spark, sf_dir), "doc_id")


@query(f"""WITH h AS ({SQL["halt_kernel"]}), t AS (SELECT user_id AS session, event_id % 7 = 0 AS ends, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
    s AS (SELECT session, h.n_tokens, h.n_emitted + 1 AS halt, h.reason, min(pos) FILTER (WHERE ends AND pos >= h.n_emitted + 1) AS stop FROM t JOIN h USING (session) GROUP BY ALL)
    SELECT session, CASE WHEN reason IS NULL THEN n_tokens WHEN reason = 'hard_limit' THEN halt - 1 ELSE least(coalesce(stop, n_tokens), halt + 49, n_tokens) END AS n_emitted, reason FROM s""")
def soft_halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halts of each session that let a sentence end."""
    tokens = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), F.rint(F.least("value", F.lit(100)) * 10).cast("bigint").alias("milli"), (F.col("event_id") % 7 == 0).alias("ends"))
    return further.soft_halts(tokens)


_HIDE = "CASE doc_id % 7 WHEN 3 THEN repeat(chr(8203), 30000) WHEN 4 THEN ' quoted in a security advisory' WHEN 5 THEN ' jailbreak now' ELSE '' END"
_SUM = " + ".join(f"CASE WHEN regexp_matches(text, {S.rx(p)}) THEN {w} ELSE 0 END" for p, w in safety.INJECTION.values())


@query(f"""WITH {ATTACKED}, x AS (SELECT doc_id, text || {_HIDE} AS text FROM attacked), s AS (SELECT doc_id, text, ({_SUM} + CASE WHEN regexp_matches(text, '(?i)jailbreak') THEN 0.5 ELSE 0 END)::DOUBLE AS total FROM x),
    v AS (SELECT doc_id, round(CASE WHEN length(text) > 100000 OR len(regexp_extract_all(text, '[\\p{{Cf}}\\p{{Co}}\\p{{Me}}]')) / length(text) > 0.15 THEN 1.0 ELSE least(1.0, CASE WHEN regexp_matches(text, 'security advisory') THEN total * 0.1 ELSE total END) END, 6)::DOUBLE AS suspicion FROM s) SELECT doc_id, suspicion, suspicion >= 0.8 AS blocked FROM v""")
def screened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injection patterns with an allowlist, an extra pattern and hidden characters."""
    k = F.col("doc_id") % 7
    extra = F.when(k == 3, F.repeat(F.lit("​"), 30000)).when(k == 4, " quoted in a security advisory").when(k == 5, " jailbreak now").otherwise("")
    rows = attacked(spark, sf_dir).withColumn("text", F.concat("text", extra))
    return further.screened(rows, ("security advisory",), {"jailbreak": r"(?i)jailbreak"}).select("doc_id", F.round("suspicion", 6).alias("suspicion"), "blocked")


@query(r"""WITH d AS (SELECT coalesce(text, '') AS t FROM documents), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS term FROM d), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark), a AS (SELECT count(DISTINCT item_id) AS answered FROM q JOIN k USING (term)),
    s AS (SELECT count(*) AS documents, sum((length(t) = 0)::INT)::BIGINT AS empty, sum((length(t) < 50)::INT)::BIGINT AS short, count(DISTINCT md5(t)) AS distinct_texts, (SELECT count(DISTINCT item_id) FROM benchmark) AS probes FROM d)
    SELECT documents, empty, short, distinct_texts, probes, answered, array_to_string(list_filter([CASE WHEN documents = 0 THEN 'no documents' END, CASE WHEN empty > 0 THEN 'empty documents' END, CASE WHEN probes > 0 AND answered = 0 THEN 'no probe answered' END], lambda x: x IS NOT NULL), ',') AS issues,
        array_to_string(list_filter([CASE WHEN short > empty THEN 'short documents' END, CASE WHEN distinct_texts < documents THEN 'copies' END, CASE WHEN answered < probes THEN 'probes without an answer' END], lambda x: x IS NOT NULL), ',') AS warnings FROM s, a""")
def knowledge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a knowledge base, probed with benchmark passages."""
    return further.knowledge_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"))


FEATURES = ["premise_len", "hypothesis_len", "num_entities_premise", "num_entities_hypothesis", "word_overlap", "premise_word_count", "hypothesis_word_count", "len_ratio", "avg_word_len_premise", "avg_word_len_hypothesis", "has_question_mark"]


@query()
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of data set that each pair looks like, learned from pairs whose turn divides by 4, and its threshold."""
    rows = evidence.text_features(pair_operators.task_type(views.pairs(spark, sf_dir)).withColumnRenamed("threshold", "task_threshold"))
    found = further.text_classes(rows.where("turn % 4 = 0"), rows, FEATURES, "task_type", "pair_id", {"qa": 0.69, "summarization": 0.72}, 0.6)
    return found.select("pair_id", "kind", *r6("confidence"), "threshold")


@query(f"""WITH {views.SQL["pairs"]}, f AS (SELECT item_id AS fact_id, text AS value, unnest(list_filter(string_split_regex(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '\\s+'), lambda x: x <> '')) AS word FROM benchmark),
    c AS (SELECT conv_id, premise, hypothesis, (pair_id % 10) / 10 AS score FROM pairs), b AS (SELECT conv_id, arg_min(hypothesis, {{'s': -score, 't': hypothesis}}) AS approved FROM c WHERE score >= 0.6 GROUP BY 1), p AS (SELECT conv_id, min(premise) AS text FROM c GROUP BY 1),
    h AS (SELECT DISTINCT conv_id, fact_id, value FROM p JOIN f ON contains(lower(text), word)), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY fact_id) AS n FROM h), a AS (SELECT conv_id, string_agg(value, '; ' ORDER BY fact_id) AS answer FROM n WHERE n <= 3 GROUP BY 1)
    SELECT conv_id AS prompt_id, md5(coalesce(approved, answer)) AS answer_md5, CASE WHEN approved IS NOT NULL THEN 'candidate' WHEN answer IS NOT NULL THEN 'facts' ELSE 'halted' END AS source FROM p LEFT JOIN b USING (conv_id) LEFT JOIN a USING (conv_id)""")
def retried_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that each conversation ends up with: a candidate, facts, or none."""
    c = views.pairs(spark, sf_dir).select(F.col("conv_id").alias("prompt_id"), F.col("premise").alias("prompt"), F.col("hypothesis").alias("text"), (F.col("pair_id") % 10 / 10).alias("score"))
    return further.retried(c, facts(spark, sf_dir)).select("prompt_id", F.md5("answer").alias("answer_md5"), "source")
