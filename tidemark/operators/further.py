"""Joins by likeness within a band, geometry, versions, drawn outcomes, challenged proofs, spans of personal data, soft halts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import calibration, evidence, policies, provenance, retrieval, safety, streams
from tidemark.operators.sequential import folded


def trigrams(text: Column) -> Column:
    """The set of runs of three characters."""
    return F.when(F.char_length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def echoes(turns: DataFrame, within: int = 1000, least: float = 0.5, shortest: int = 20) -> DataFrame:
    """``seq, output, likeness, severity``: inputs that repeat one of the ``within`` outputs before them, whatever conversation it is from.

    ``turns``: ``seq`` (the order of all turns), ``role`` (user, assistant), ``text``. Likeness is the Jaccard of character trigrams; the best of
    at least ``least`` counts, of equals the first. Two sets that alike share one of the rarest trigrams of either: only so
    many of each as could all be missed by a like set are joined, and common ones never meet. Candidates are then compared in full.
    """
    low = F.lower(F.btrim(F.coalesce("text", F.lit(""))))
    t = turns.select("seq", "role", low.alias("t")).where(F.char_length("t") >= shortest).select("seq", "role", trigrams(F.col("t")).alias("g"))
    grams = t.select("seq", "role", F.size("g").alias("n"), F.explode("g").alias("gram"))
    ranked = grams.join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("f")), "gram")
    w = Window.partitionBy("seq").orderBy("f", "gram")
    # A set of n shares at least ceil(least * n) members with a like one, so one of its n - that + 1 rarest.
    kept = ranked.withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("n") - F.ceil(F.round(least * F.col("n"), 9)) + 1)
    a, b = kept.where("role = 'user'").select("gram", "seq", "n"), kept.where("role = 'assistant'").select("gram", F.col("seq").alias("output"), F.col("n").alias("m"))
    sized = F.least("n", "m") >= F.round(least * F.greatest("n", "m"), 9)  # sets of too different sizes are not alike
    near = a.join(b, "gram").where((F.col("output") < F.col("seq")) & (F.col("output") >= F.col("seq") - within) & sized).select("seq", "output").distinct()
    met = near.join(t.select("seq", F.col("g").alias("x")), "seq").join(t.select(F.col("seq").alias("output"), F.col("g").alias("y")), "output")
    scored = met.select("seq", "output", F.round(T.jaccard(F.col("x"), F.col("y")), 9).alias("likeness")).where(F.col("likeness") >= least)
    best = scored.groupBy("seq").agg(F.max(F.struct("likeness", (-F.col("output")).alias("o"))).alias("b"))
    likeness = F.col("b.likeness")
    return best.select("seq", (-F.col("b.o")).alias("output"), likeness.alias("likeness"), F.when(likeness > 0.8, "high").when(likeness > 0.6, "medium").otherwise("low").alias("severity"))


def points_in_spheres(points: DataFrame, spheres: DataFrame, cell: float) -> DataFrame:
    """``point_id, sphere_id`` for points (``x, y, z``) in closed spheres (``cx, cy, cz, radius``), by an equi-join over cells along x."""
    at = lambda c: F.floor(c / cell)
    s = spheres.where("radius >= 0").withColumn("cell", F.explode(F.sequence(at(F.col("cx") - F.col("radius")), at(F.col("cx") + F.col("radius")))))
    gap = sum(((F.col(p) - F.col(c)) * (F.col(p) - F.col(c)) for p, c in zip("xyz", ("cx", "cy", "cz"), strict=True)), F.lit(0.0))
    return points.withColumn("cell", at(F.col("x"))).join(s, "cell").where(gap <= F.col("radius") * F.col("radius")).select("point_id", "sphere_id")


def box_overlaps(boxes: DataFrame, cell: float) -> DataFrame:
    """``a, b`` with a < b for closed boxes (``box_id, x0, x1, y0, y1, z0, z1``) that share a point.

    Boxes meet in the cells along x that both touch; a pair counts in the first of them alone.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    b = boxes.where("x0 <= x1 AND y0 <= y1 AND z0 <= z1").withColumns({"first": at("x0"), "cell": F.explode(F.sequence(at("x0"), at("x1")))})
    p, q = b.alias("p"), b.alias("q")
    touch = F.lit(True)
    for axis in "xyz":
        touch = touch & (F.col(f"p.{axis}0") <= F.col(f"q.{axis}1")) & (F.col(f"q.{axis}0") <= F.col(f"p.{axis}1"))
    met = p.join(q, (F.col("p.cell") == F.col("q.cell")) & (F.col("p.box_id") < F.col("q.box_id")))
    return met.where(touch & (F.col("p.cell") == F.greatest("p.first", "q.first"))).select(F.col("p.box_id").alias("a"), F.col("q.box_id").alias("b"))


def arm_checks(poses: DataFrame, l1: float, l2: float, limits: tuple[float, float, float, float]) -> DataFrame:
    """Adds ``x, y`` of a planar arm's tip at joint angles ``q1, q2`` and ``within``: whether both joints keep to their limits (low, high, low, high)."""
    q1, q2 = F.col("q1"), F.col("q2")
    low1, high1, low2, high2 = limits
    return poses.withColumns({"x": l1 * F.cos(q1) + l2 * F.cos(q1 + q2), "y": l1 * F.sin(q1) + l2 * F.sin(q1 + q2), "within": q1.between(low1, high1) & q2.between(low2, high2)})


def active_versions(changes: DataFrame) -> DataFrame:
    """``tenant, event_id, active``: the version in force after each change (``tenant, micros, event_id, action, version``), in order.

    ``publish`` makes a version known if it is above all before it; ``promote`` puts a known version in force; ``rollback`` goes back
    to the one in force before. Other changes, and promotions of unknown versions, change nothing.
    """

    def start() -> Callable[..., tuple]:
        known: set[int] = set()
        stack: list[int] = []

        def step(action: str, version: int | None) -> tuple[int | None]:
            if action == "publish" and version is not None and version > max(known, default=-1):
                known.add(version)
            elif action == "promote" and version in known and (not stack or stack[-1] != version):
                stack.append(version)
            elif action == "rollback" and len(stack) > 1:
                stack.pop()
            return (stack[-1] if stack else None,)

        return step

    return folded(changes, ["action", "version"], start, {"active": ("bigint", pa.int64())})


def drawn_breaches(actions: DataFrame, draws: int = 64, z: float = 1.96) -> DataFrame:
    """``session, actions, breaches, share, low, high``: how often one of a session's actions turns out irreversible, over ``draws`` tries.

    ``actions``: ``session, key, action``. An action of reversibility r fails in a try whose number, fixed by key and try, is at
    least r. The interval is Wilson's.
    """
    r = evidence.reversibility(F.col("action"))
    rows = actions.select("session", "key", r.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    fails = rows.withColumn("bad", calibration.uniform(F.col("key"), F.col("b")) >= F.col("r"))
    tries = fails.groupBy("session", "b").agg(F.max("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    out = tries.groupBy("session").agg(F.max("n").alias("actions"), F.count_if("bad").alias("breaches"))
    p, n = F.col("breaches") / draws, float(draws)
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)
    return out.select("session", "actions", "breaches", p.alias("share"), F.greatest(F.lit(0.0), centre - spread).alias("low"), F.least(F.lit(1.0), centre + spread).alias("high"))


def challenged_proofs(rows: DataFrame, group: str, idx: str, value: str, salt: str, challenges: int = 4) -> DataFrame:
    """``group, leaves, root, challenged, proven``: commitments to salted values, opened where the root itself says.

    A leaf is the SHA-256 of salt, a separator and value. The root's hash with a number names each challenged place; their
    proofs must lead to the root.
    """
    leaf = F.sha2(F.concat_ws("|", F.col(salt), F.col(value).cast("string")), 256)
    leaves = rows.select(group, F.col(idx).alias("idx"), leaf.alias("leaf"))
    roots = provenance.merkle_roots(leaves, group, "idx", "leaf")
    asked = roots.select(F.col(group).alias("asked group"), "leaves", "root", F.explode(F.sequence(F.lit(0), F.lit(challenges - 1))).alias("j"))
    place = F.conv(F.substring(F.sha2(F.concat(F.col("root"), F.lit("|"), F.col("j").cast("string")), 256), 1, 8), 16, 10).cast("bigint") % F.col("leaves")
    asked = asked.select("asked group", "leaves", "root", place.alias("place")).distinct()
    numbered = provenance.merkle_proofs(leaves, group, "idx", "leaf").withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("idx")) - 1)
    met = numbered.withColumnRenamed("place", "own place").join(asked, (F.col(group) == F.col("asked group")) & (F.col("own place") == F.col("place")))
    proven = provenance.proven_root(F.col("leaf"), F.col("path")) == F.col("root")
    return met.groupBy(group, "leaves", "root").agg(F.count(F.lit(1)).alias("challenged"), F.count_if(proven).alias("proven"))


def pii_spans(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``key, kind, start, end``: where personal data stands in a text, in characters, half open; one Arrow pass, each pattern over texts that can hold it."""
    patterns = {k: re.compile(p) for k, p in safety.PII.items()}

    def run(batches):
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                low = text.lower()
                for kind, pattern in patterns.items():
                    if kind not in safety.NEEDS or any(n in low for n in safety.NEEDS[kind]):
                        out += [(row, kind, m.start(), m.end()) for m in pattern.finditer(text)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], [key, "kind", "start", "end"])

    return df.select(key, column).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, kind string, start int, end int")


def soft_halts(tokens: DataFrame, patience: int = 50, **limits: int) -> DataFrame:
    """``session, n_emitted, reason``: halts that let a sentence end; ``tokens`` has ``session, idx, milli, ends``.

    A score below the hard limit halts before its token. A low mean or a falling trend halts after the next token that ends
    a sentence, its own included, or after ``patience`` tokens.
    """
    first = streams.halt_kernel(tokens.select("session", "idx", "milli"), **limits).select("session", "n_tokens", (F.col("n_emitted") + 1).alias("at"), "reason")
    w = Window.partitionBy("session").orderBy("idx")
    placed = tokens.select("session", "ends", F.row_number().over(w).alias("pos")).join(first, "session")
    stop = F.min(F.when(F.col("ends") & (F.col("pos") >= F.col("at")), F.col("pos")))
    out = placed.groupBy("session", "n_tokens", "at", "reason").agg(stop.alias("stop"))
    soft = F.least(F.coalesce("stop", F.col("n_tokens")), F.col("at") + patience - 1, F.col("n_tokens"))
    return out.select("session", F.when(F.col("reason").isNull(), F.col("n_tokens")).when(F.col("reason") == "hard_limit", F.col("at") - 1).otherwise(soft).alias("n_emitted"), "reason")


def screened(df: DataFrame, allow: tuple[str, ...] = (), extra: dict[str, str] | None = None, column: str = "text", block: float = 0.8) -> DataFrame:
    """Adds ``suspicion`` and ``blocked``: injection patterns, ``extra`` ones at a weight of 0.5, a tenth of all weights for texts
    that an ``allow`` pattern matches; 1 for texts that are too long or hold too many odd characters."""
    text = F.coalesce(F.col(column), F.lit(""))
    scored = safety.injection_score(df.withColumn("screened text", text), "screened text").drop("blocked")
    weights = F.create_map(*[F.lit(x) for k, (_, w) in safety.INJECTION.items() for x in (k, w)])
    total = F.aggregate(F.transform("found", lambda k: weights[k]), F.lit(0.0), lambda a, w: a + w)
    total = total + sum((F.when(text.rlike(p), 0.5).otherwise(0.0) for p in (extra or {}).values()), F.lit(0.0))
    trusted = F.lit(False)
    for p in allow:
        trusted = trusted | text.rlike(p)
    odd = F.when(F.octet_length(text) != F.char_length(text), policies.odd_share(text) > policies.ODD_SHARE).otherwise(False)
    value = F.when((F.char_length(text) > 100_000) | odd, 1.0).otherwise(F.least(F.lit(1.0), F.when(trusted, total * 0.1).otherwise(total)))
    out = scored.withColumn("suspicion", F.round(value, 9)).drop("found", "screened text")
    return out.withColumn("blocked", F.col("suspicion") >= block)


def knowledge_report(docs: DataFrame, probes: DataFrame, shortest: int = 50) -> DataFrame:
    """One row ``documents, empty, short, distinct_texts, probes, answered, issues, warnings``: the state of a knowledge base.

    ``probes``: ``query_id, text``; one is answered if a document shares a word with it. Issues: no documents, empty ones, no probe answered;
    warnings: short documents, copies, probes without an answer.
    """
    text = F.coalesce("text", F.lit(""))
    state = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.char_length(text) == 0).alias("empty"), F.count_if(F.char_length(text) < shortest).alias("short"), F.count_distinct(F.md5(text)).alias("distinct_texts"))
    known = docs.select(F.explode(T.words(text)).alias("term")).distinct()
    asked = probes.select("query_id", F.explode(T.words(F.coalesce("text", F.lit("")))).alias("term"))
    hit = asked.join(known, "term", "left_semi").select("query_id").distinct()
    tried = probes.agg(F.count_distinct("query_id").alias("probes")).crossJoin(hit.agg(F.count(F.lit(1)).alias("answered")))  # one row each
    out = state.crossJoin(F.broadcast(tried))
    some = lambda *named: F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named])), ",")
    issues = some(("no documents", F.col("documents") == 0), ("empty documents", F.col("empty") > 0), ("no probe answered", (F.col("probes") > 0) & (F.col("answered") == 0)))
    warnings = some(("short documents", F.col("short") > F.col("empty")), ("copies", F.col("distinct_texts") < F.col("documents")), ("probes without an answer", F.col("answered") < F.col("probes")))
    return out.withColumns({"issues": issues, "warnings": warnings})


def text_classes(train: DataFrame, rows: DataFrame, features: list[str], label: str, key: str, thresholds: dict[str, float], default: float, gate: float = 0.5) -> DataFrame:
    """``key, kind, confidence, threshold``: the class whose mean of standardised features lies nearest, and the threshold that goes with it.

    Means and spreads are sums over all training rows, one row a class. Confidence is the softmax of the negative squared
    distances, per feature; below ``gate`` the default threshold holds.
    """
    known = train.where(F.col(label).isNotNull())
    whole = known.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    unit = lambda f: (F.col(f) - float(whole[f"m_{f}"])) / float(whole[f"s_{f}"] or 1.0)
    centres = known.groupBy(label).agg(*[F.avg(unit(f)).alias(f) for f in features]).limit(1001).collect()
    if len(centres) > 1000:
        raise ValueError("more than 1,000 classes")
    gap = lambda c: sum(((unit(f) - float(c[f])) * (unit(f) - float(c[f])) for f in features), F.lit(0.0)) / len(features)
    listed = F.array(*[F.struct(gap(c).alias("gap"), F.lit(str(c[label])).alias("kind")) for c in sorted(centres, key=lambda c: str(c[label]))])
    out = rows.select(key, listed.alias("all")).withColumn("best", F.array_min("all"))
    share = 1 / F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(F.col("best.gap") - x["gap"]))
    own = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("kind")]
    out = out.select(key, F.col("best.kind").alias("kind"), share.alias("confidence"))
    return out.withColumn("threshold", F.when(F.col("confidence") >= gate, F.coalesce(own, F.lit(default))).otherwise(default))


def retried(candidates: DataFrame, facts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``prompt_id, answer, source``: the best approved candidate (``prompt_id, text, prompt, score``), else facts that the prompt holds, else a halt.

    Candidates are approved from ``threshold`` on; of equal ones the smaller text wins.
    """
    best = candidates.where(F.col("score") >= threshold).groupBy("prompt_id").agg(F.min_by("text", F.struct((-F.col("score")).alias("s"), "text")).alias("approved"))
    prompts = candidates.groupBy(F.col("prompt_id").alias("query_id")).agg(F.min("prompt").alias("text"))
    found = retrieval.keyword_facts(facts, prompts, 3).select(F.col("query_id").alias("prompt_id"), "answer")
    out = prompts.select(F.col("query_id").alias("prompt_id")).join(best, "prompt_id", "left").join(found, "prompt_id", "left")
    source = F.when(F.col("approved").isNotNull(), "candidate").when(F.col("answer").isNotNull(), "facts").otherwise("halted")
    return out.select("prompt_id", F.coalesce("approved", "answer").alias("answer"), source.alias("source"))
