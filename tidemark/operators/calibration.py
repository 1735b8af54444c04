"""Audit queries, corrections, threshold sweeps and resampling over scored, labelled rows.

Scores are whole thousandths, so sums do not depend on the order of rows. Sweeps count rows by score first and meet the
grid of thresholds afterwards. Null scores and labels take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cumulative chances of a Poisson variable of mean 1 to be below 1, 2, ... 7.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def audit_query(log: DataFrame, since: int | None = None, until: int | None = None, limit: int = 100, **equal: object) -> DataFrame:
    """The latest ``limit`` rows of the log (``micros, event_id, ...``) from ``since`` on, up to ``until``, with these values.

    Latest first; of one time the larger ``event_id``. A limit of 0 means all rows.
    """
    for name, bound in (("since", since), ("until", until)):
        if bound is not None:
            log = log.where(F.col("micros") >= bound if name == "since" else F.col("micros") <= bound)
    for column, value in equal.items():
        log = log.where(F.col(column) == value)
    ordered = log.orderBy(F.desc("micros"), F.desc("event_id"))
    return ordered.limit(limit) if limit else ordered


def disagreements(corrections: DataFrame, domain: str | None = None) -> DataFrame:
    """Corrections (``guardrail, human`` booleans, ``domain``) where the two differ, of one domain or all."""
    rows = corrections.where(F.col("guardrail") != F.col("human"))
    return rows if domain is None else rows.where(F.col("domain") == domain)


def training_rows(corrections: DataFrame) -> DataFrame:
    """Corrections as training rows: ``premise, hypothesis, label`` (1 where the human approved)."""
    return corrections.select(F.col("prompt").alias("premise"), F.col("response").alias("hypothesis"), F.col("human").cast("int").alias("label"))


def counts_by_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, milli, pos, neg``: labelled rows (``milli, label``) by score; labels other than 0 and 1 drop out."""
    kept = rows.where(F.col("label").isin(0, 1) & F.col("milli").isNotNull())
    return kept.groupBy(*by, "milli").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def balanced_accuracy(tp: Column, pos: Column, tn: Column, neg: Column) -> Column:
    """Mean recall of the classes that are there."""
    return F.when(pos == 0, tn / neg).when(neg == 0, tp / pos).otherwise((tp / pos + tn / neg) / 2)


def at_thresholds(counts: DataFrame, by: list[str], grid: list[int]) -> DataFrame:
    """``by, t, tp, tn, pos, neg, ba`` for every threshold: a score of t or more is positive."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    all_counts = counts.withColumns({"all_pos": F.sum("pos").over(w), "all_neg": F.sum("neg").over(w)})
    met = all_counts.withColumn("t", F.explode(F.array(*[F.lit(t) for t in grid])))
    up = F.col("milli") >= F.col("t")
    out = met.groupBy(*by, "t", F.col("all_pos").alias("p"), F.col("all_neg").alias("n")).agg(F.sum(F.when(up, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(up, 0).otherwise(F.col("neg"))).alias("tn"))
    out = out.withColumnsRenamed({"p": "pos", "n": "neg"})
    return out.withColumn("ba", F.round(balanced_accuracy(F.col("tp"), F.col("pos"), F.col("tn"), F.col("neg")), 9))


GRID = [10 * t for t in range(10, 91)]


def best_thresholds(rows: DataFrame, by: list[str], grid: list[int] | None = None) -> DataFrame:
    """``by, threshold, balanced_acc, pos, neg, tp, tn``: the smallest threshold of the largest balanced accuracy."""
    swept = at_thresholds(counts_by_score(rows, by), by, grid or GRID)
    best = swept.groupBy(*by).agg(F.max(F.struct("ba", (-F.col("t")).alias("t"), "tp", "tn", "pos", "neg")).alias("b"))
    return best.select(*by, (-F.col("b.t")).alias("threshold"), F.col("b.ba").alias("balanced_acc"), "b.pos", "b.neg", "b.tp", "b.tn")


def macro_threshold(rows: DataFrame, by: str, grid: list[int] | None = None) -> DataFrame:
    """``threshold, macro_acc``: one threshold for all data sets, by the mean of their balanced accuracies."""
    swept = at_thresholds(counts_by_score(rows, [by]), [by], grid or GRID)
    whole = F.round(F.col("ba") * 1e9).cast("bigint")
    mean = swept.groupBy("t").agg((F.sum(whole) / F.count(F.lit(1)) / 1e9).alias("a"))
    return mean.agg(F.max(F.struct(F.round("a", 9).alias("a"), (-F.col("t")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.a").alias("macro_acc"))


def class_report(rows: DataFrame, thresholds: DataFrame, by: str) -> DataFrame:
    """``by, threshold, tp, fp, fn, tn`` and precision, recall and F1 of the positive class at each group's threshold."""
    counted = counts_by_score(rows, [by]).join(thresholds.select(by, "threshold"), by)
    up = F.col("milli") >= F.col("threshold")
    total = lambda c, hit: F.sum(F.when(up == hit, F.col(c)).otherwise(0))
    out = counted.groupBy(by, "threshold").agg(total("pos", True).alias("tp"), total("neg", True).alias("fp"), total("pos", False).alias("fn"), total("neg", False).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) by the keys alone: the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def bootstrap_thresholds(rows: DataFrame, key: str, replicates: int = 200, grid: list[int] | None = None, level: float = 0.95) -> DataFrame:
    """``low, median, high, replicates`` of the best threshold over resamples.

    Each row enters each resample as often as a Poisson variable says that its key and the resample's number fix; so a
    resample needs no shuffle of rows, only their counts by score. Quantiles are the nearest ranks.
    """
    u = uniform(F.col(key), F.col("b"))
    weight = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    drawn = rows.where(F.col("label").isin(0, 1) & F.col("milli").isNotNull()).select(key, "milli", "label", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")).withColumn("w", weight).where("w > 0")
    counts = drawn.groupBy("b", "milli").agg(F.sum(F.col("w") * F.col("label")).alias("pos"), F.sum(F.col("w") * (1 - F.col("label"))).alias("neg"))
    swept = at_thresholds(counts, ["b"], grid or GRID)
    best = swept.groupBy("b").agg((-F.max(F.struct("ba", (-F.col("t")).alias("t")))["t"]).alias("t"))
    ranked = best.agg(F.array_sort(F.collect_list("t")).alias("t"), F.count(F.lit(1)).alias("n"))  # one number a resample
    at = lambda q: F.element_at("t", (F.floor((F.col("n") - 1) * q + 0.5) + 1).cast("int"))
    return ranked.select(at((1 - level) / 2).alias("low"), at(0.5).alias("median"), at((1 + level) / 2).alias("high"), F.col("n").alias("replicates"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r``: Pearson's correlation of each pair of whole-number columns, from their exact sums; null where one is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    big = "decimal(38,0)"
    sums = [F.count(F.lit(1)).cast(big).alias("n"), *[F.sum(F.col(c).cast("bigint")).cast(big).alias(f"s_{c}") for c in columns], *[F.sum(F.col(a).cast("bigint") * F.col(b).cast("bigint")).cast(big).alias(f"p_{a}_{b}") for a, b in [*pairs, *[(c, c) for c in columns]]]]
    one = rows.dropna(subset=columns).agg(*sums)
    n = F.col("n").cast("double")
    mean = lambda c: F.col(c).cast("double") / n
    made = []
    for a, b in pairs:
        spread = [F.greatest(F.lit(0.0), mean(f"p_{c}_{c}") - mean(f"s_{c}") * mean(f"s_{c}")) for c in (a, b)]
        r = F.when((spread[0] > 0) & (spread[1] > 0), (mean(f"p_{a}_{b}") - mean(f"s_{a}") * mean(f"s_{b}")) / F.sqrt(spread[0] * spread[1]))
        made.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    return one.select(F.explode(F.array(*made)).alias("x")).select("x.a", "x.b", "x.r")


def recent_standing(readings: DataFrame, key: str, order: str, value: str, last: int = 672) -> DataFrame:
    """``key, latest, mean, percentile, n`` of the last ``last`` readings: the latest, their mean, the share not above the latest."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    kept = readings.select(key, F.col(value).alias("v"), F.row_number().over(w).alias("k")).where(F.col("k") <= last)
    latest = kept.where("k = 1").select(F.col(key).alias("own"), F.col("v").alias("latest"))
    met = kept.join(latest, kept[key] == latest["own"])
    return met.groupBy(key).agg(F.max("latest").alias("latest"), F.avg("v").alias("mean"), (F.count_if(F.col("v") <= F.col("latest")) / F.count(F.lit(1))).alias("percentile"), F.count(F.lit(1)).alias("n"))


def mixed_rows(rows: DataFrame, key: str, source: str, ratios: dict[str, float]) -> DataFrame:
    """Rows of each source drawn by the hash of their key at the source's ratio; sources without one go."""
    ratio = F.lit(0.0)
    for name, share in ratios.items():
        ratio = F.when(F.col(source) == name, share).otherwise(ratio)
    return rows.where(uniform(F.col(key)) < ratio)


def adjusted_thresholds(analyses: DataFrame, warn: float, halt: float, step: float = 0.02, strikes: int = 2, floor: float = 0.05, ceiling: float = 0.98) -> DataFrame:
    """``tenant, i, warn, halt, moved``: thresholds after each analysis (``tenant, i, alarm, mean, brier_alarm``), in order.

    An alarm with a mean at or above the warning threshold raises both by ``step``, below it lowers both; a Brier alarm
    alone moves both half a step towards their centre; ``strikes`` analyses in one direction are needed for a move, and
    the count starts anew after it. Moves feed back into what counts as high, so a tenant's analyses are a fold, one Arrow pass over sorted rows.
    """
    import pyarrow as pa

    eps = 1e-6

    def fold(batches):
        tenant, state = None, (warn, halt, 0, 0)
        for batch in batches:
            out = []
            for t, i, alarm, mean, brier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w, h, way, count = state if t == tenant else (warn, halt, 0, 0)
                tenant = t
                now = (1 if mean >= w else -1) if alarm and mean is not None and mean > 0 else 2 if brier else 0
                count = count + 1 if now and now == way else int(now != 0)
                moved = now != 0 and count >= strikes
                if moved:
                    count, middle = 0, (w + h) / 2
                    w, h = {1: (w + step, h + step), -1: (w - step, h - step), 2: (min(w + step / 2, middle - eps), max(h - step / 2, middle + eps))}[now]
                    w = max(floor, min(w, ceiling - eps))
                    h = max(w + eps, min(h, ceiling))
                state = (w, h, now, count)
                out.append((t, i, w, h, moved))
            cols = zip(*out, strict=True) if out else [()] * 5
            types = (batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.record_batch([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], ["tenant", "i", "warn", "halt", "moved"])

    kind = analyses.schema["tenant"].dataType.simpleString()
    rows = analyses.select("tenant", F.col("i").cast("bigint").alias("i"), "alarm", "mean", "brier_alarm").repartition("tenant").sortWithinPartitions("tenant", "i")
    return rows.mapInArrow(fold, f"tenant {kind}, i bigint, warn double, halt double, moved boolean")
