"""Queries over audits, corrections and thresholds, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calibration as K
from tidemark.plans.registry import SINCE, UNTIL, longs, query, r6
from tidemark.sources import views
from tidemark.sources.tables import table

AUDIT = views.SQL["audit"]
#: Labelled scores with the data set (the document's source) and the task (its language) that they come from.
_ROWS = "rows AS (SELECT doc_id, n_chars * 37 % 1000 AS milli, quality AS label, toxic, coalesce(source, '?') AS dataset, coalesce(lang, '?') AS task FROM documents JOIN labels USING (doc_id))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, milli, label, toxic, dataset, task``."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select("doc_id", (F.col("n_chars") * 37 % 1000).alias("milli"), F.col("quality").alias("label"), "toxic", F.coalesce("source", F.lit("?")).alias("dataset"), F.coalesce("lang", F.lit("?")).alias("task"))


def swept_sql(by: str, source: str = "rows", counts: str = "") -> str:
    """CTEs up to ``swept`` (by, t, tp, tn, pos, neg, ba)."""
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    counts = counts or f"SELECT {keys}milli, sum(label) AS pos, sum(1 - label) AS neg FROM {source} WHERE label IN (0, 1) AND milli IS NOT NULL GROUP BY {keys}milli"
    return f"""counts AS ({counts}), totals AS (SELECT *, sum(pos) OVER ({over}) AS p, sum(neg) OVER ({over}) AS n FROM counts),
    grid AS (SELECT {keys}t * 10 AS t, p AS pos, n AS neg, sum(CASE WHEN milli >= t * 10 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN milli >= t * 10 THEN 0 ELSE neg END) AS tn FROM totals, range(10, 91) r(t) GROUP BY {keys}t, p, n),
    swept AS (SELECT *, round(CASE WHEN pos = 0 THEN tn / neg WHEN neg = 0 THEN tp / pos ELSE (tp / pos + tn / neg) / 2 END, 9) AS ba FROM grid)"""


def best_sql(by: str) -> str:
    return f"WITH {_ROWS}, {swept_sql(by)}, k AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ba DESC, t) AS k FROM swept) SELECT {by}, t AS threshold, round(ba, 6) AS balanced_acc, pos, neg, tp, tn FROM k WHERE k = 1"


def best(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    found = K.best_thresholds(labelled(spark, sf_dir), [by])
    return found.select(by, *longs("threshold"), *r6("balanced_acc"), *longs("pos", "neg", "tp", "tn"))


@query(f"WITH {AUDIT} SELECT event_id, micros, tenant, model, approved, round(score, 6) AS score FROM audit WHERE micros >= {SINCE} AND micros <= {UNTIL} AND model = 'm1' ORDER BY micros DESC, event_id DESC LIMIT 100")
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest hundred audit rows of one model in a month (the limit is the query's)."""
    found = K.audit_query(views.audit(spark, sf_dir), SINCE, UNTIL, 100, model="m1")
    return found.select("event_id", "micros", "tenant", "model", "approved", *r6("score"))


@query(f"WITH {_ROWS} SELECT doc_id, dataset AS domain, milli >= 500 AS guardrail, label = 1 AS human FROM rows WHERE (milli >= 500) <> (label = 1)")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections where guardrail and human differ."""
    c = labelled(spark, sf_dir).select("doc_id", F.col("dataset").alias("domain"), (F.col("milli") >= 500).alias("guardrail"), (F.col("label") == 1).alias("human"))
    return K.disagreements(c)


@query(best_sql("dataset"), longs="pos neg tp tn")
def dataset_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold of each data set."""
    return best(spark, sf_dir, "dataset")


@query(best_sql("task"), longs="pos neg tp tn")
def task_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold of each task type."""
    return best(spark, sf_dir, "task")


@query(f"WITH {_ROWS}, {swept_sql('dataset')}, m AS (SELECT t, round(sum(round(ba * 1e9)::BIGINT) / count(*) / 1e9, 9) AS a FROM swept GROUP BY t) SELECT t AS threshold, round(a, 6) AS macro_acc FROM m ORDER BY a DESC, t LIMIT 1")
def macro_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold for all data sets together."""
    return K.macro_threshold(labelled(spark, sf_dir), "dataset").select(*longs("threshold"), *r6("macro_acc"))


@query(f"""WITH {_ROWS}, {swept_sql("task")}, k AS (SELECT task, t, row_number() OVER (PARTITION BY task ORDER BY ba DESC, t) AS k FROM swept), j AS (SELECT task, t AS threshold, milli >= t AS up, label FROM rows JOIN k USING (task) WHERE k = 1),
    c AS (SELECT task, threshold, sum((up AND label = 1)::INT)::BIGINT AS tp, sum((up AND label = 0)::INT)::BIGINT AS fp, sum((NOT up AND label = 1)::INT)::BIGINT AS fn, sum((NOT up AND label = 0)::INT)::BIGINT AS tn FROM j GROUP BY 1, 2),
    p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
    SELECT task, threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM p""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each task at its threshold."""
    rows = labelled(spark, sf_dir)
    found = K.class_report(rows, K.best_thresholds(rows, ["task"]), "task")
    return found.select("task", *longs("threshold", "tp", "fp", "fn", "tn"), *r6("precision", "recall", "f1"))


_POISSON = " + ".join(f"(u >= {p})::INT" for p in K.POISSON)


@query(f"""WITH {_ROWS}, d AS (SELECT doc_id, milli, label, b, ('0x' || substr(md5(doc_id || '-' || b), 1, 8))::BIGINT / 4294967296 AS u FROM rows, range(200) r(b) WHERE label IN (0, 1)), w AS (SELECT *, {_POISSON} AS w FROM d),
    {swept_sql("b", counts="SELECT b, milli, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM w WHERE w > 0 GROUP BY b, milli")}, k AS (SELECT b, t, row_number() OVER (PARTITION BY b ORDER BY ba DESC, t) AS k FROM swept),
    s AS (SELECT list_sort(list(t)) AS t, count(*) AS n FROM k WHERE k = 1) SELECT t[floor((n - 1) * 0.025 + 0.5)::INT + 1] AS low, t[floor((n - 1) * 0.5 + 0.5)::INT + 1] AS median, t[floor((n - 1) * 0.975 + 0.5)::INT + 1] AS high, n AS replicates FROM s""")
def bootstrap_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval of the best threshold over two hundred resamples."""
    found = K.bootstrap_thresholds(labelled(spark, sf_dir), "doc_id")
    return found.select(*longs("low", "median", "high", "replicates"))


@query(f"WITH {_ROWS}, c AS (SELECT doc_id, milli, label, toxic FROM rows WHERE milli IS NOT NULL AND label IS NOT NULL AND toxic IS NOT NULL) SELECT 'milli' AS a, 'label' AS b, round(corr(milli, label), 6) AS r FROM c UNION ALL SELECT 'milli', 'toxic', round(corr(milli, toxic), 6) FROM c UNION ALL SELECT 'label', 'toxic', round(corr(label, toxic), 6) FROM c")
def score_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of scores and labels, two by two."""
    return K.correlations(labelled(spark, sf_dir), ["milli", "label", "toxic"]).select("a", "b", *r6("r"))


@query(f"""WITH {AUDIT}, k AS (SELECT tenant, tokens AS v, row_number() OVER (PARTITION BY tenant ORDER BY event_id DESC) AS k FROM audit), l AS (SELECT tenant, v AS latest FROM k WHERE k = 1)
    SELECT tenant, max(latest) AS latest, round(avg(v), 6) AS mean, round(sum((v <= latest)::INT) / count(*), 6) AS percentile, count(*) AS n FROM k JOIN l USING (tenant) WHERE k <= 672 GROUP BY tenant""")
def recent_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each tenant's latest reading stands among its last 672."""
    return K.recent_standing(views.audit(spark, sf_dir), "tenant", "event_id", "tokens").select("tenant", "latest", *r6("mean", "percentile"), "n")


RATIOS = {"en": 0.5, "fr": 1.0, "de": 0.25}


@query(f"WITH {_ROWS} SELECT doc_id, task FROM rows WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296 < CASE task {' '.join(f"WHEN '{k}' THEN {v}" for k, v in RATIOS.items())} ELSE 0.0 END")
def mixed_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows drawn at each task's ratio (a sampling operator)."""
    return K.mixed_rows(labelled(spark, sf_dir), "doc_id", "task", RATIOS).select("doc_id", "task")


@query()
def adjusted_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of each tenant after each week's analysis; moves feed back, which SQL cannot express."""
    week = F.floor((F.col("micros") - SINCE) / (7 * 86_400_000_000)).cast("bigint")
    weekly = views.audit(spark, sf_dir).groupBy("tenant", week.alias("i")).agg(F.round(F.avg("score"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("approved")).alias("bad"))
    return K.adjusted_thresholds(weekly.select("tenant", "i", (F.col("bad") * 6 > F.col("n")).alias("alarm"), "mean", (F.col("n") % 2 == 0).alias("brier_alarm")), 0.4, 0.6).select("tenant", "i", *r6("warn", "halt"), "moved")
