"""Evidence and routing: features of pairs, freshness, compound queries, agreement of answers, intent drift.

Null texts count as empty; empty inputs give no rows, or the neutral value that the docstring names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.lexicons import NLI_NEGATION
from tidemark.operators import claims, pairs, safety

# Date-sensitive phrases; risk is base + slope * age factor.
FRESHNESS = {
    "position": (r"(?i)(?:the\s+)?(?:CEO|CTO|CFO|COO|president|prime\s+minister|chairman|director|head|leader|secretary|minister|governor|mayor)\s+(?:of\s+)?(\S+(?:\s+\S+){0,10})\s+(?:is|was)\b", 0.6, 0.4),
    "statistic": (r"(?i)(?:population|GDP|revenue|market\s+cap|stock\s+price|unemployment|inflation|interest\s+rate|exchange\s+rate|growth\s+rate)(?:\s+\w+){0,5}\s+([\d,.]+\s*(?:million|billion|trillion|%|percent)?)", 0.4, 0.4),
    "current_reference": (r"(?i)(?:currently|as of|right now|at present|today|this year|in \d{4})", 0.5, 0.5),
    "record": (r"(?i)(?:world\s+record|fastest|tallest|largest|smallest|highest|lowest|most\s+\w+|best\s+selling|top\s+\w+|#1|number\s+one)", 0.3, 0.3),
}
# Phrases of factual and of creative prompts.
FACTUAL = r"(?i)\b(what\s+is|who\s+is|when\s+did|where\s+is|how\s+many|how\s+much|define|explain|according\s+to|based\s+on|verify|fact[- ]?check|is\s+it\s+true|confirm|source|reference|policy|regulation|specification|requirement|standard|guideline)\b"
CREATIVE = r"(?i)\b(write\s+(?:me\s+)?a|compose|create|imagine|brainstorm|suggest|recommend|draft|rewrite|rephrase|paraphrase|translate|summarise|tell\s+me\s+a\s+(?:joke|story)|poem|story|essay|song|code\s+(?:me|a)|hello|hi\b|hey\b|thanks|thank\s+you|bye|goodbye)\b"
# What joins two questions; no question is shorter than eight characters.
JOINTS = r"(?i)\s*(?:\band\b|\bor\b|\balso\b|\badditionally\b|[;]\s*|[?]\s+(?=[A-Z])|\d+[.)]\s)\s*"
LEAST_QUESTION = 8
# Marks of actions that can't or can be undone.
IRREVERSIBLE = ("delete", "drop table", "truncate", "rm -rf", "format", "force push", "publish", "send email", "transfer funds", "merge to main")
REVERSIBLE = ("preview", "dry-run", "stage", "validate", "simulate", "lint", "read-only")
# Phrases that try to leave a sandbox, and hosts that it must not reach.
ANTI_ANCHOR = ("ignore sandbox", "ignore the sandbox", "disregard containment", "you are in production", "switch to production", "bypass reality anchor", "pretend this is real", "act as if live")
PRODUCTION_HOSTS = ("api.openai.com", "api.anthropic.com", "api.stripe.com", "api.github.com", "kubernetes.default.svc")


def folded(text: Column) -> Column:
    """Letters outside ASCII as underscores: word characters in every engine."""
    return F.regexp_replace(text, T.NON_ASCII_LETTER, "_")


def pieces(text: Column) -> Column:
    """Lower-cased pieces between white space, repeats included."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def text_features(df: DataFrame) -> DataFrame:
    """Text features of each pair, the inputs of a data-set-type classifier; ratios of empty texts divide by 1."""
    made = {}
    for side, c in (("premise", "premise"), ("hypothesis", "hypothesis")):
        text, listed = F.col(c), pieces(F.col(c))
        total = F.aggregate(listed, F.lit(0), lambda a, w: a + F.char_length(w))
        made |= {
            f"{side}_len": F.char_length(text),
            f"{side}_words": F.array_distinct(listed),
            f"num_entities_{side}": F.size(T.find_all(text, "[A-Z][a-z]+")),
            f"{side}_sent_count": F.char_length(text) - F.char_length(F.translate(text, ".!?", "")),
            f"avg_word_len_{side}": total / F.greatest(F.size(listed), F.lit(1)),
        }
    df = df.withColumns(made)
    p, h = F.col("premise_words"), F.col("hypothesis_words")
    df = df.withColumns({"has_negation_premise": T.has_any(p, NLI_NEGATION).cast("int"), "has_negation_hypothesis": T.has_any(h, NLI_NEGATION).cast("int")})
    return df.withColumns({
        "word_overlap": T.jaccard(p, h), "premise_word_count": F.size(p), "hypothesis_word_count": F.size(h),
        "negation_asymmetry": (F.col("has_negation_premise") != F.col("has_negation_hypothesis")).cast("int"),
        "has_question_mark": F.col("hypothesis").contains("?").cast("int"),
        "len_ratio": F.col("premise_len") / F.greatest("hypothesis_len", F.lit(1)),
    })


def freshness(df: DataFrame, age_factor: float = 0.5, column: str = "text") -> DataFrame:
    """``n_<kind>`` date-sensitive phrases and the largest ``staleness`` (0 without any); an unknown age counts as 0.5."""
    df = df.withColumn("folded_text", folded(F.coalesce(column, F.lit(""))))
    df = df.withColumns({f"n_{k}": F.regexp_count("folded_text", F.lit(p)) for k, (p, _, _) in FRESHNESS.items()}).drop("folded_text")
    risks = [F.when(F.col(f"n_{k}") > 0, min(1.0, base + slope * age_factor)).otherwise(0.0) for k, (_, base, slope) in FRESHNESS.items()]
    return df.withColumn("staleness", F.greatest(*risks))


def retrieval_route(df: DataFrame, threshold: float = 0.5, default: bool = True) -> DataFrame:
    """``retrieve`` and ``route_confidence`` from the task type and the factual and creative phrases of the prompt."""
    df = pairs.task_type(df).withColumns({"n_factual": F.regexp_count(folded(F.col("premise")), F.lit(FACTUAL)), "n_creative": F.regexp_count(folded(F.col("premise")), F.lit(CREATIVE))})
    kind, f, c = F.col("task_type"), F.col("n_factual") > 0, F.col("n_creative") > 0
    base = F.when(kind.isin("rag", "fact_check", "qa"), 0.8).when(kind.isin("dialogue", "default"), 0.7).otherwise(0.5)
    wants = F.when(kind.isin("rag", "fact_check", "qa"), True).when(kind.isin("dialogue", "default"), False).otherwise(default)
    confidence = F.when(f != c, F.least(F.lit(1.0), base + 0.15)).when(f & c, F.greatest(F.lit(0.3), base - 0.2)).otherwise(base)
    df = df.withColumn("route_confidence", F.round(confidence, 3)).withColumn("retrieve", F.when(f & ~c, True).when(c & ~f, False).otherwise(wants))
    return df.withColumn("retrieve", F.when(F.col("retrieve") & (F.col("route_confidence") < threshold), default).otherwise(F.col("retrieve")))


def sub_queries(query: Column) -> Column:
    """The questions of a compound query; the query itself if no part is long enough."""
    strip = lambda x: F.btrim(x, F.lit(" \t\n\r"))
    parts = F.transform(F.split(query, JOINTS), lambda p: strip(F.regexp_replace(strip(p), r"\?+$", "")))
    kept = F.filter(parts, lambda p: F.char_length(p) >= LEAST_QUESTION)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(query))


def consensus(answers: DataFrame, least: float = 0.5) -> DataFrame:
    """Agreement of answers (``prompt_id, model_idx, text``) by prompt: mean and lowest, disagreements, consensus.

    Prompts with one answer have none of it to compare: agreement 1, no pairs. An empty answer disagrees with all.
    """
    a = answers.select("prompt_id", "model_idx", T.spaced_words(F.coalesce("text", F.lit(""))).alias("w"))
    n = a.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("models"))
    x, y = a.alias("x"), a.alias("y")
    both = x.join(y, (F.col("x.prompt_id") == F.col("y.prompt_id")) & (F.col("x.model_idx") < F.col("y.model_idx")))
    both = both.select(F.col("x.prompt_id").alias("prompt_id"), F.round(T.jaccard(F.col("x.w"), F.col("y.w")), 9).alias("j"))
    sums = both.groupBy("prompt_id").agg(F.sum(F.round(F.col("j") * 1e9).cast("bigint")).alias("s"), F.count(F.lit(1)).alias("pairs"), F.min("j").alias("lowest"), F.count_if(1 - F.col("j") >= least).alias("disagree"))
    out = n.join(sums, "prompt_id", "left")
    agreement = F.coalesce(F.col("s") / 1e9 / F.col("pairs"), F.lit(1.0))
    return out.select("prompt_id", "models", F.coalesce("pairs", F.lit(0)).alias("pairs"), agreement.alias("agreement"), F.coalesce("lowest", F.lit(1.0)).alias("lowest"), F.coalesce("disagree", F.lit(0)).alias("disagree"), (agreement > 0.7).alias("consensus"))


def intent_drift(df: DataFrame, baseline: float = 0.4, drift: float = 0.6, injected: float = 0.75, floor: float = 0.15, stage1: float = 0.3, detect: float = 0.7) -> DataFrame:
    """Claims of each answer against its prompt: grounded, drifted or injected counts, risk and detection.

    Divergence is the smaller of the heuristic entailment scores both ways, above a baseline. Answers without claims
    have no row.
    """
    split = df.select("pair_id", "premise", F.posexplode(T.sentences(F.col("hypothesis"))).alias("claim_index", "hypothesis"))
    forward = pairs.heuristic_nli(pairs.claim_signals(split)).select("pair_id", "claim_index", "premise", "hypothesis", "traceability", "entity_overlap", F.col("nli").alias("fwd"))
    turned = pairs.heuristic_nli(forward.select("pair_id", "claim_index", F.col("hypothesis").alias("premise"), F.col("premise").alias("hypothesis"), "traceability", "entity_overlap", "fwd"))
    cal = F.greatest(F.lit(0.0), (F.round(F.least("fwd", "nli"), 9) - baseline) / (1 - baseline))
    tr = F.round("traceability", 9)
    verdict = F.when(tr < floor, "injected").when((cal >= injected) & (tr < 0.2), "injected").when((cal >= drift) & (tr >= 0.3), "drifted").when(cal >= drift, "injected").otherwise("grounded")
    counts = turned.withColumn("v", verdict).groupBy("pair_id").agg(F.count(F.lit(1)).alias("claims"), *[F.count_if(F.col("v") == k).alias(k) for k in ("grounded", "drifted", "injected")])
    first = safety.injection_score(df.select("pair_id", F.col("premise").alias("text"))).select("pair_id", "suspicion")
    out = counts.join(first, "pair_id").withColumn("risk", (F.col("injected") + 0.4 * F.col("drifted")) / F.col("claims"))
    return out.withColumn("combined", F.round(stage1 * F.col("suspicion") + (1 - stage1) * F.col("risk"), 9)).withColumn("detected", F.col("combined") >= detect)


def claim_coverage(df: DataFrame, covered: float = 0.6, trim: float = 0.25) -> DataFrame:
    """Divergence of each answer's sentences from their best source sentence: coverage, mean, maximum, trimmed mean.

    The trimmed mean leaves out the largest ``trim`` share, rounded down. Pairs without claims or sources have no row.
    """
    best = claims.best_sources(df)
    scored = best.select("pair_id", "claim_index", F.round(1 - T.jaccard(T.words(F.col("hypothesis")), T.words(F.col("premise"))), 9).alias("d"))
    w = Window.partitionBy("pair_id")
    scored = scored.withColumns({"k": F.row_number().over(w.orderBy("d", "claim_index")), "n": F.count(F.lit(1)).over(w)})
    whole = F.round(F.col("d") * 1e9).cast("bigint")
    kept = F.col("k") <= F.col("n") - F.floor(F.col("n") * trim)
    out = scored.groupBy("pair_id").agg(F.count(F.lit(1)).alias("claims"), (F.count_if(F.col("d") < covered) / F.count(F.lit(1))).alias("coverage"), (F.sum(whole) / F.count(F.lit(1)) / 1e9).alias("mean"), F.max("d").alias("worst"), (F.sum(F.when(kept, whole)) / F.count_if(kept) / 1e9).alias("trimmed"))
    return out


def class_probabilities(df: DataFrame, logits: str = "logits") -> DataFrame:
    """``divergence`` P(contradiction) + P(neutral) / 2 and ``confidence`` 1 - H / ln 3 of three logits (entailed, neutral, contradicted)."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    p = F.transform(e, lambda x: x / (e[0] + e[1] + e[2]))
    df = df.withColumn("p", p)
    q = [F.greatest(F.col("p")[i], F.lit(1e-10)) for i in range(3)]
    return df.withColumns({"divergence": F.col("p")[2] + 0.5 * F.col("p")[1], "confidence": 1 + sum((x * F.log(x) for x in q), F.lit(0.0)) / F.log(F.lit(3.0))})


def reversibility(text: Column) -> Column:
    """0.05 for actions with an irreversible mark, 0.95 with a reversible one, 0.5 with both, neither or no text."""
    low = F.lower(text)
    bad, good = (F.coalesce(low.rlike("|".join(m)), F.lit(False)) for m in (IRREVERSIBLE, REVERSIBLE))
    return F.when(bad & ~good, 0.05).when(good & ~bad, 0.95).otherwise(0.5)


def irreversibility(actions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """By session: actions of each kind, log10 of the product of their reversibilities, whether it is at or below ``threshold``.

    Kinds are counted, so the product does not depend on the order of rows and can't underflow.
    """
    counted = actions.withColumn("r", reversibility(F.col("action"))).groupBy("session").agg(*[F.count_if(F.col("r") == v).alias(k) for k, v in (("irreversible", 0.05), ("reversible", 0.95), ("unknown", 0.5))])
    log = F.col("irreversible") * F.log10(F.lit(0.05)) + F.col("reversible") * F.log10(F.lit(0.95)) + F.col("unknown") * F.log10(F.lit(0.5))
    return counted.withColumn("log10_reversible", log).withColumn("crosses", F.col("log10_reversible") <= F.log10(F.lit(threshold)))


def breakouts(events: DataFrame, sandboxed: bool = True) -> DataFrame:
    """One row per finding of ``event_id, text, url``: ``event_id, category, detail``."""
    low, host = F.lower(F.coalesce("text", F.lit(""))), F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^(?:https?://)?([a-z0-9][a-z0-9.\-]*[a-z0-9])", 1)
    found = [F.when(low.contains(p), F.struct(F.lit("anti_anchor_injection").alias("category"), F.lit(p).alias("detail"))) for p in ANTI_ANCHOR]
    if sandboxed:
        found.append(F.when(host.isin(*PRODUCTION_HOSTS), F.struct(F.lit("production_target").alias("category"), host.alias("detail"))))
    return events.select("event_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("event_id", "f.category", "f.detail")


def best_candidates(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The candidate of smallest divergence of each prompt (``prompt_id, candidate_id, divergence``); ``halt`` if its coherence is below ``threshold``."""
    best = df.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("candidates"), F.min(F.struct("divergence", "candidate_id")).alias("b"))
    return best.select("prompt_id", "candidates", F.col("b.candidate_id").alias("candidate_id"), (1 - F.col("b.divergence")).alias("coherence"), (1 - F.col("b.divergence") < threshold).alias("halt"))


def ranking_metrics(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """Hit rates at 1 and 3 and precision at 3 over the queries of ``ranking`` (``query_id, doc_id, rank``)."""
    hits = ranking.join(relevant.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    by = hits.groupBy("query_id").agg(F.count_if((F.col("rank") <= 1) & (F.col("hit") == 1)).alias("h1"), F.count_if((F.col("rank") <= 3) & (F.col("hit") == 1)).alias("h3"))
    return by.agg(F.count(F.lit(1)).alias("queries"), (F.sum("h1") / F.count(F.lit(1))).alias("hit_at_1"), (F.count_if(F.col("h3") > 0) / F.count(F.lit(1))).alias("hit_at_3"), (F.sum("h3") / F.count(F.lit(1)) / 3).alias("precision_at_3"))


def class_weights(rows: DataFrame) -> DataFrame:
    """``label, n, weight``: all rows / (labels * rows of the label)."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select("label", "n", (F.col("total") / (F.col("kinds") * F.col("n"))).alias("weight"))
