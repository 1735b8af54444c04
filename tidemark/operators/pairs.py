"""Scores of (premise, hypothesis) pairs, as Column expressions.

Every function takes a DataFrame with string columns ``premise`` and ``hypothesis`` and adds columns. The word, entity
and number sets of a side are computed once and kept as array columns until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.lexicons import CLAIM_NEGATION, CLAIM_STOP, NEGATION, NLI_NEGATION, STOP

MARKERS = r"(?i)\b(?:however|but actually|in fact|contrary to|on the other hand|that said|nevertheless|this is (?:not|in)?correct|wrong|false)\b"
REFERENCES = r"(?i)\[\d+\]|\((?:19|20)\d{2}\)|(?:doi|https?)://\S+"
RULE_WEIGHTS = {"entity_grounding": 0.8, "numeric_consistency": 1.5, "negation_flip": 2.0, "length_ratio": 1.5, "word_overlap": 0.5, "contradiction_keywords": 1.2, "source_attribution": 0.5, "content_word_divergence": 1.5}
#: Phrases of the hypothesis that settle the heuristics by themselves.
PHRASES = (("consistent with reality", 0.1), ("opposite is true", 0.9), ("depends on your perspective", 0.5))


def with_sets(df: DataFrame) -> DataFrame:
    """Add word, white-space word, entity and number sets of both sides."""
    made = {}
    for side, c in (("p", "premise"), ("h", "hypothesis")):
        made |= {f"{side}_words": T.words(F.col(c)), f"{side}_spaced": T.spaced_words(F.col(c)), f"{side}_ents": T.entities(F.col(c)), f"{side}_nums": T.numbers(F.col(c))}
    return df.withColumns(made)


def lite_divergence(df: DataFrame, in_bytes: bool = False) -> DataFrame:
    """``divergence``: 1 - (0.4 word Jaccard + 0.2 length ratio + 0.2 entity overlap + 0.2 (1 - 0.3 negation asymmetry)).

    0.5 if a side is empty or has no word. Entity overlap is 0.5 if neither side has entities, 0 if one has. Lengths are
    characters, or bytes of UTF-8 with ``in_bytes``.
    """
    df = with_sets(df)
    pw, hw, pe, he = (F.col(c) for c in ("p_words", "h_words", "p_ents", "h_ents"))
    lp, lh = (F.octet_length(c) if in_bytes else F.char_length(c) for c in ("premise", "hypothesis"))
    ents = F.when((F.size(pe) > 0) & (F.size(he) > 0), T.shared(pe, he) / T.union_size(pe, he)).when((F.size(pe) > 0) | (F.size(he) > 0), 0.0).otherwise(0.5)
    asym = F.when(T.has_any(pw, NEGATION) != T.has_any(hw, NEGATION), 0.3).otherwise(0.0)
    alike = 0.4 * (T.shared(pw, hw) / T.union_size(pw, hw)) + 0.2 * (F.least(lp, lh) / F.greatest(lp, lh)) + 0.2 * ents + 0.2 * (1 - asym)
    return df.withColumn("divergence", F.when((F.size(pw) == 0) | (F.size(hw) == 0), 0.5).otherwise(T.clamp(1 - alike)))


def phrase_or(otherwise: Column) -> Column:
    """A settled score if the hypothesis has one of the phrases."""
    out = F
    for phrase, score in PHRASES:
        out = out.when(F.lower("hypothesis").contains(phrase), score)
    return out.otherwise(otherwise)


def heuristic_logical(df: DataFrame) -> DataFrame:
    """``h_logical``: a settling phrase's score, else 1 - word Jaccard; 0.5 if a side has no word."""
    df = with_sets(df)
    pw, hw = F.col("p_words"), F.col("h_words")
    return df.withColumn("h_logical", phrase_or(F.when((F.size(pw) == 0) | (F.size(hw) == 0), 0.5).otherwise(T.clamp(1 - T.jaccard(pw, hw)))))


def heuristic_factual(df: DataFrame) -> DataFrame:
    """``h_factual``: 1 - max(recall, precision) of content words, + 0.25 negation asymmetry, + 0.15 novel entity."""
    df = with_sets(df)
    stop = T.word_array(STOP)
    pc, hc = F.array_except("p_words", stop), F.array_except("h_words", stop)
    base = 1 - F.greatest(T.shared(pc, hc) / F.size(pc), T.shared(pc, hc) / F.size(hc))
    base = base + F.when(T.has_any(F.col("p_words"), NEGATION) != T.has_any(F.col("h_words"), NEGATION), 0.25).otherwise(0.0)
    base = base + F.when(F.size(F.array_except("h_ents", "p_ents")) > 0, 0.15).otherwise(0.0)
    return df.withColumn("h_factual", F.when((F.size(pc) == 0) | (F.size(hc) == 0), 0.5).otherwise(T.clamp(base)))


def heuristic_nli(df: DataFrame) -> DataFrame:
    """``nli``: 0.5 - 0.3 overlap / |premise words|, at least 0.7 with negation asymmetry and overlap over 0.3, in [0.1, 0.9]."""
    df = with_sets(df)
    ps, hs = F.col("p_spaced"), F.col("h_spaced")
    overlap = T.shared(ps, hs) / F.size(ps)
    raw = 0.5 - overlap * 0.3
    raw = F.when((T.has_any(ps, NLI_NEGATION) != T.has_any(hs, NLI_NEGATION)) & (overlap > 0.3), F.greatest(raw, F.lit(0.7))).otherwise(raw)
    return df.withColumn("nli", phrase_or(F.when(F.size(ps) == 0, 0.5).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(0.9), raw)))))


def composite(df: DataFrame, w_logic: float = 0.6, w_fact: float = 0.4, threshold: float = 0.6, soft: float = 0.1) -> DataFrame:
    """Both heuristics, their weighted divergence, coherence, approval, warning and meta-confidence."""
    df = heuristic_factual(heuristic_logical(df))
    df = df.withColumn("score", 1 - (w_logic * F.col("h_logical") + w_fact * F.col("h_factual")))
    margin = F.least(F.abs(F.col("score") - threshold) / 0.2, F.lit(1.0))
    return df.withColumns({"approved": F.col("score") >= threshold, "warning": (F.col("score") >= threshold) & (F.col("score") < threshold + soft), "confidence": F.least(margin, 1 - F.abs(F.col("h_logical") - F.col("h_factual")))})


def rules(df: DataFrame) -> DataFrame:
    """The eight rules and their weighted mean ``rules_score``."""
    df = with_sets(df)
    stop = T.word_array(STOP)
    pn, hn = T.numbers(F.col("premise"), T.RULE_NUMBER), T.numbers(F.col("hypothesis"), T.RULE_NUMBER)
    pc, hc = F.array_except("p_words", stop), F.array_except("h_words", stop)
    recall, precision = T.shared(pc, hc) / F.size(pc), T.shared(pc, hc) / F.size(hc)
    count = lambda c: F.greatest(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")), F.lit(1))
    ratio = count(F.col("hypothesis")) / count(F.col("premise"))
    hits = F.size(T.find_all(F.col("hypothesis"), MARKERS))
    made = {
        "entity_grounding": F.when(F.size("h_ents") == 0, 1.0).otherwise(T.shared(F.col("h_ents"), F.col("p_ents")) / F.size("h_ents")),
        "numeric_consistency": F.when(F.size(hn) == 0, 1.0).otherwise(T.shared(hn, pn) / F.size(hn)),
        "negation_flip": F.when(T.has_any(F.col("p_words"), NEGATION) == T.has_any(F.col("h_words"), NEGATION), 1.0).otherwise(0.3),
        "length_ratio": F.when(ratio <= 3, 1.0).when(ratio <= 6, 0.6).otherwise(0.2),
        "word_overlap": F.when((F.size(pc) == 0) | (F.size(hc) == 0), 0.5).when(T.shared(pc, hc) == 0, 0.0).otherwise(2 * recall * precision / (recall + precision)),
        "contradiction_keywords": F.when(hits == 0, 1.0).otherwise(1 - F.least(hits * 0.25, F.lit(0.7))),
        "source_attribution": F.when(~F.col("premise").rlike(REFERENCES) | F.col("hypothesis").rlike(REFERENCES), 1.0).otherwise(0.5),
        "content_word_divergence": F.when(F.size(hc) == 0, 1.0).otherwise(1 - F.size(F.array_except(hc, pc)) / F.size(hc)),
    }
    df = df.withColumns(made)
    total = sum(RULE_WEIGHTS.values())
    return df.withColumn("rules_score", sum((F.col(k) * w for k, w in RULE_WEIGHTS.items()), F.lit(0.0)) / total)


def claim_signals(df: DataFrame) -> DataFrame:
    """Signals of a claim (hypothesis) against a source (premise), the five-signal verdict and its confidence.

    ``numerical_match`` is null unless both sides have numbers; null neither supports nor contradicts.
    """
    df = with_sets(df)
    ps, hs = F.col("p_spaced"), F.col("h_spaced")
    neg, dull = T.word_array(CLAIM_NEGATION), T.word_array([*CLAIM_STOP, *CLAIM_NEGATION])
    hc = F.array_except(hs, dull)
    df = df.withColumns({
        "divergence": 1 - T.jaccard(F.col("p_words"), F.col("h_words")),
        "entity_overlap": F.when((F.size("p_ents") == 0) & (F.size("h_ents") == 0), 1.0).otherwise(T.jaccard(F.col("p_ents"), F.col("h_ents"))),
        "numerical_match": F.when((F.size("p_nums") > 0) & (F.size("h_nums") > 0), F.arrays_overlap("p_nums", "h_nums")),
        "negation_flip": (T.shared(F.array_except(hs, neg), F.array_except(ps, neg)) >= 3) & (T.has_any(hs, CLAIM_NEGATION) != T.has_any(ps, CLAIM_NEGATION)),
        "traceability": F.when(F.size(hc) == 0, 1.0).otherwise(T.shared(hc, F.array_except(ps, dull)) / F.size(hc)),
    })
    one = lambda c: F.when(c, 1).otherwise(0)
    num, ent, tr, div = F.col("numerical_match"), F.col("entity_overlap"), F.col("traceability"), F.col("divergence")
    total = 2 + one(ent > 0) + one(num.isNotNull()) + one(F.col("negation_flip"))
    support = one(div < 0.35) + one(ent >= 0.5) + one(F.coalesce(num, F.lit(False))) + one(tr >= 0.5)
    against = one((div > 0.65)) + one((ent > 0) & (ent < 0.2)) + one(~F.coalesce(num, F.lit(True))) + one(F.col("negation_flip"))
    s, c = support / total, against / total
    verdict = F.when(tr < 0.15, "fabricated").when((tr < 0.2) & (against == 0) & (s < 0.5), "fabricated").when(c >= 0.5, "contradicted").when(s >= 0.5, "supported").otherwise("unverifiable")
    confidence = F.when(tr < 0.15, 0.7 + (1 - tr) * 0.3).when((tr < 0.2) & (against == 0) & (s < 0.5), 0.5 + (1 - tr) * 0.5).when(c >= 0.5, c).when(s >= 0.5, s).otherwise(F.greatest(s, c))
    return df.withColumns({"verdict": verdict, "verdict_confidence": confidence})


def task_type(df: DataFrame) -> DataFrame:
    """``task_type`` of the premise (the prompt), by ordered rules, and its approval threshold."""
    low = F.lower("premise")
    any_of = lambda *keys: F.lit(False) if not keys else low.rlike("|".join(keys))
    turns = F.size(T.find_all(F.col("premise"), r"(?i)(?:^|\s)(?:(?:User|Human|Customer|Student|Interviewer|Speaker|Assistant|AI|Bot|Agent|Interviewee|System)[\s\d]*:|\[(?:User|Human|Assistant|AI|System)\])"))
    lp, lh = F.char_length("premise"), F.char_length("hypothesis")
    kind = (
        F.when(turns >= 2, "dialogue")
        .when(any_of("summarize", "summary", "summarise", "tldr", "abstract"), "summarization")
        .when((lp > 1000) & (lh > 20) & (lh / lp < 0.3), "summarization")
        .when(any_of("based on the context", "based on the following", "given the document", "given the passage", "retrieved", "source document", "reference text"), "rag")
        .when(any_of("verify", "fact-check", "is it true", "claim", "support"), "fact_check")
        .when(F.col("premise").contains("?") | any_of("answer the question", "based on the", "according to"), "qa")
        .otherwise("default")
    )
    limits = {"summarization": 0.72, "qa": 0.69, "rag": 0.78, "dialogue": 0.68, "fact_check": 0.56, "default": 0.6}
    return df.withColumn("task_type", kind).withColumn("threshold", F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("task_type")])
