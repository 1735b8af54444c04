"""Queries over records, sessions, changed texts and learned guards, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import guards, provenance, records, stats
from tidemark.operators import pairs as pair_operators
from tidemark.plans.catalog import DECISIONS, FACTUAL, LOGICAL, SETS, decisions
from tidemark.plans.chunked import trim_sql
from tidemark.plans.registry import SINCE, SQL, UNTIL, longs, query, r6
from tidemark.sources import views
from tidemark.sources.tables import table

AUDIT, PAIRS = views.SQL["audit"], views.SQL["pairs"]


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).withColumn("tenant", F.col("user_id"))


@query()
def behaviour_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each user against a record that leaves anomalies out; they feed back."""
    return records.behaviour_records(by_user(spark, sf_dir)).select("tenant", "event_id", *r6("z"), "anomaly")


@query()
def adaptive_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens of each user are scored at a cadence that their scores set."""
    return records.adaptive_cadence(by_user(spark, sf_dir))


_HALTS = SQL["halt_kernel"]


@query(f"""WITH h AS ({_HALTS}), t AS (SELECT user_id AS session, event_id AS idx, event_type AS token, (least(value, 100) * 10)::BIGINT AS milli, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events)
    SELECT session, md5(string_agg(token, '' ORDER BY pos)) AS output_md5, count(*) AS n_tokens, round(sum(milli) / count(*), 6) AS mean, min(milli) AS least, sum((milli < 300)::INT)::BIGINT AS warnings FROM t JOIN h USING (session) WHERE pos <= h.n_emitted GROUP BY session""")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each session put out before it halted."""
    tokens = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), F.col("event_type").alias("token"), F.rint(F.least("value", F.lit(100)) * 10).cast("bigint").alias("milli"))
    return records.session_rollup(tokens).select("session", F.md5("output").alias("output_md5"), "n_tokens", *r6("mean"), "least", "warnings")


@query(f"""WITH {SETS}, l AS (SELECT pair_id, conv_id, turn + 1 AS turn, {LOGICAL} AS h FROM content), c AS ({SQL["cross_turn_divergence"]})
    SELECT pair_id, round(h, 6) AS h_logical, round(divergence, 5) AS cross_turn, floor(coalesce(0.7 * round(h, 6) + 0.3 * divergence, round(h, 6)) * 1e5 + 0.5001) / 1e5 AS blended FROM l LEFT JOIN c USING (conv_id, turn)""")
def blended_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical divergence of each pair, mixed with that from earlier turns."""
    found = records.blended_logic(views.pairs(spark, sf_dir), table(spark, sf_dir, "conversations"))
    six = [F.round(c, 6) for c in ("h_logical", "cross")]
    return found.select("pair_id", six[0].alias("h_logical"), F.round(six[1], 5).alias("cross_turn"), (F.floor(F.coalesce(0.7 * six[0] + 0.3 * six[1], six[0]) * 1e5 + 0.5001) / 1e5).alias("blended"))


@query()
def embed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of hashed bags of each pair."""
    return records.embed_scores(views.pairs(spark, sf_dir)).select("pair_id", *r6("embed_score"))


@query(f"WITH {SETS}, s AS (SELECT pair_id, {LOGICAL} AS a, CASE WHEN pair_id % 20000 = 0 THEN NULL ELSE {FACTUAL} END AS b FROM content) SELECT pair_id, round(CASE WHEN b IS NULL THEN a ELSE (0.75 * a + 0.25 * b) / 1.0 END, 6) AS score FROM s")
def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted ensemble of two scorers, one of them sometimes silent."""
    scored = pair_operators.heuristic_factual(pair_operators.heuristic_logical(views.pairs(spark, sf_dir)))
    scored = scored.withColumn("h_factual", F.when(F.col("pair_id") % 20000 != 0, F.col("h_factual")))
    return scored.select("pair_id", F.round(records.ensemble(scored, {"h_logical": 0.75, "h_factual": 0.25}), 6).alias("score"))


_WORDS = rf"list_filter(string_split_regex({trim_sql('text')}, '\s+'), lambda w: w <> '')"
_CHANGED = {
    "token_drop": "array_to_string(list_filter(w, lambda x, i: i % 3 <> 0), ' ')",
    "token_repeat": "array_to_string(flatten(list_transform(w, lambda x, i: CASE WHEN i % 4 = 0 THEN [x, x] ELSE [x] END)), ' ')",
    "char_swap": "array_to_string(list_transform(w, lambda x: CASE WHEN length(x) > 3 THEN substr(x, 2, 1) || substr(x, 1, 1) || substr(x, 3) ELSE x END), ' ')",
    "casing": "array_to_string(list_transform(w, lambda x, i: CASE WHEN i % 2 = 1 THEN translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END), ' ')",
    "digits": "translate(array_to_string(w, ' '), 'aeiost', '431057')",
    "hidden": "array_to_string(w, ' ' || chr(8203))",
}


@query(f"WITH t AS (SELECT pair_id, {_WORDS} AS w FROM ({'WITH ' + PAIRS + ' SELECT pair_id, premise AS text FROM pairs'}) p) " + " UNION ALL ".join(f"SELECT pair_id, '{k}' AS change, md5({v}) AS text_md5 FROM t" for k, v in _CHANGED.items()))
def perturbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts under six changes."""
    made = records.perturbations(F.col("premise"))
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("change"), F.md5(v).alias("text_md5")) for k, v in made.items()]))
    return views.pairs(spark, sf_dir).select("pair_id", forms.alias("x")).select("pair_id", "x.change", "x.text_md5")


@query("SELECT o_custkey AS account, count(*) AS leaves, count(*) AS proven FROM orders GROUP BY o_custkey")
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of each customer's orders, followed to the root."""
    leaves = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("leaf"))
    roots = provenance.merkle_roots(leaves, "account", "o_orderkey", "leaf").select("account", "root")
    proofs = provenance.merkle_proofs(leaves, "account", "o_orderkey", "leaf").join(roots, "account")
    return proofs.groupBy("account").agg(F.count(F.lit(1)).alias("leaves"), F.count_if(provenance.proven_root(F.col("leaf"), F.col("path")) == F.col("root")).alias("proven"))


@query(f"""WITH {AUDIT}, w AS (SELECT model, (micros - {SINCE}) // {stats.WEEK} AS week, count(*) AS n, sum((NOT approved)::INT) AS bad FROM audit WHERE micros >= {SINCE} AND micros < {UNTIL} GROUP BY 1, 2),
    m AS (SELECT model, sum(n)::BIGINT AS total, round(arg_max(bad / n, week) - arg_min(bad / n, week), 9) AS change FROM w GROUP BY 1) SELECT model, total, round(greatest(0.0, change), 6) AS severity, change > 0.05 AS drift FROM m""")
def model_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each model's rejection rate has risen from the first week to the last."""
    a = views.audit(spark, sf_dir).where((F.col("micros") >= SINCE) & (F.col("micros") < UNTIL))
    weekly = a.groupBy("model", F.floor((F.col("micros") - SINCE) / stats.WEEK).alias("week")).agg(F.count(F.lit(1)).alias("n"), (F.count_if(~F.col("approved")) / F.count(F.lit(1))).alias("rate"))
    out = weekly.groupBy("model").agg(F.sum("n").alias("total"), F.round(F.max_by("rate", "week") - F.min_by("rate", "week"), 9).alias("change"))
    return out.select("model", "total", F.round(F.greatest(F.lit(0.0), F.col("change")), 6).alias("severity"), (F.col("change") > 0.05).alias("drift"))


@query(f"WITH {DECISIONS}, l AS (SELECT tenant, max(micros) AS last FROM decisions GROUP BY 1) SELECT tenant, count(*) AS n, sum(points)::BIGINT AS points FROM decisions JOIN l USING (tenant) WHERE micros > last - 86400000000 GROUP BY tenant")
def recent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each tenant's last day of decisions."""
    d = decisions(spark, sf_dir)
    last = d.groupBy(F.col("tenant").alias("t")).agg(F.max("micros").alias("last"))
    return d.join(last, d["tenant"] == last["t"]).where(F.col("micros") > F.col("last") - 86_400_000_000).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


@query(f"""WITH {views.SQL["corrections"]}, s AS (SELECT abs(milli - 1000 * label) AS x, row_number() OVER (ORDER BY abs(milli - 1000 * label)) AS i, count(*) OVER () AS n FROM corrections)
    SELECT x AS threshold, n AS calibration_size FROM s WHERE i = 1 + least(greatest(ceil(0.9 * (n + 1)) - 1, 0), n - 1)""")
def conformal_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conformal predictor's order statistic of the labels' residuals, in thousandths."""
    rows = views.corrections(spark, sf_dir).select(F.abs(F.col("milli") - 1000 * F.col("label")).alias("nonconformity"))
    return stats.conformal_threshold(rows, ceiling=True).select(*longs("threshold", "calibration_size"))


@query()
def learned_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learned guard's probability that each document is good, from rows whose key's CRC32 modulo 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select(F.col("doc_id").alias("key"), "text", F.col("quality").alias("label"))
    weights, bias = records.learned_guard(rows)
    bags = guards.hash_bag(docs.select("doc_id", "text"), records.SLOTS)
    return bags.select("doc_id", F.round(records.guard_score(F.col("bag"), weights, bias), 6).alias("score"))
