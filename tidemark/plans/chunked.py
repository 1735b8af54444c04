"""Queries over sentences, claims and chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lexicons import NLI_NEGATION
from tidemark.operators import chunks as C
from tidemark.operators import guards, pairs
from tidemark.plans import sqltext as S
from tidemark.plans.registry import query, r6
from tidemark.sources import views
from tidemark.sources.tables import table

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_GAP = r"[ \t\n\r\f\v]+"


def trim_sql(x: str) -> str:
    return f"trim({x}, {_WS})"


def nli_sentences_sql(x: str) -> str:
    """``chunks.nli_sentences`` in DuckDB."""
    held = rf"regexp_replace(regexp_replace({trim_sql(x)}, {S.rx(C.ABBREVIATIONS)}, '\1' || chr(1), 'g'), '(\d)\.(\d)', '\1.' || chr(1) || '\2', 'g')"
    return rf"list_filter(list_transform(string_split(regexp_replace({held}, '([.!?]){_GAP}', '\1' || chr(2), 'g'), chr(2)), lambda s: {trim_sql("translate(s, chr(1), ' ')")}), lambda s: s <> '')"


def sentences_sql(x: str) -> str:
    """``text.sentences`` in DuckDB."""
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: len(list_filter(string_split_regex(s, '[ \t\n\r\f]+'), lambda w: w <> '')) >= 3)"


def tokens_sql(x: str) -> str:
    return f"(length({x}) // 4 + 1)"


def packed_sql(s: str, budget: int) -> str:
    """``chunks.budget_chunks`` of a list of sentences."""
    start = "{'d': []::STRUCT(a BIGINT, b BIGINT)[], 'a': 1::BIGINT, 't': 0::BIGINT}"
    step = f"CASE WHEN i > 1 AND acc.t + {tokens_sql(f'{s}[i]')} > {budget} THEN {{'d': list_append(acc.d, {{'a': acc.a, 'b': i - 1}}), 'a': i - 1, 't': {tokens_sql(f'{s}[i - 1]')} + {tokens_sql(f'{s}[i]')}}} ELSE {{'d': acc.d, 'a': acc.a, 't': acc.t + {tokens_sql(f'{s}[i]')}}} END"
    return f"list_reduce(range(1, len({s}) + 1), lambda acc, i: {step}, {start})"


def chunked_sql(source: str, out: str, premise: str = "premise", hypothesis: str = "hypothesis", inner: str = "max", outer: str = "max", ratio: float = 0.4, key: str = "pair_id") -> str:
    """CTEs up to ``out`` (key, divergence, n_premise, n_hypothesis): ``chunks.chunked`` over a CTE of pairs."""
    budgets = int(512 * ratio), int(512 * (1 - ratio))
    phrase = "CASE " + " ".join(f"WHEN contains(lower(h), '{p}') THEN {v}" for p, v in pairs.PHRASES)
    mean = "sum(round({0} * 1e9)::BIGINT) / 1e9 / count(*)"
    combine = {"max": "max({0})", "min": "min({0})", "mean": mean}
    sides = ", ".join(f"CASE WHEN {tokens_sql(c)} > {b} AND len({c}s) > 1 THEN list_transform(list_append({c}k.d, {{'a': {c}k.a, 'b': len({c}s)}}), lambda x: array_to_string({c}s[x.a:x.b], ' ')) ELSE [{c}] END AS {c}c" for c, b in zip("ph", budgets, strict=True))
    return f"""{out}_s AS (SELECT {key} AS k, coalesce({premise}, '') AS p, coalesce({hypothesis}, '') AS h, {nli_sentences_sql(f"coalesce({premise}, '')")} AS ps, {nli_sentences_sql(f"coalesce({hypothesis}, '')")} AS hs FROM {source}),
    {out}_f AS (SELECT *, {packed_sql("ps", budgets[0])} AS pk, {packed_sql("hs", budgets[1])} AS hk FROM {out}_s), {out}_c AS (SELECT k, {sides} FROM {out}_f),
    {out}_h AS (SELECT k, len(pc) AS n_premise, len(hc) AS n_hypothesis, pc, generate_subscripts(hc, 1) AS i, unnest(hc) AS h FROM {out}_c), {out}_p AS (SELECT k, n_premise, n_hypothesis, i, h, unnest(pc) AS p FROM {out}_h),
    {out}_w AS (SELECT *, {S.spaced("p")} AS ps, {S.spaced("h")} AS hs FROM {out}_p), {out}_o AS (SELECT *, {S.shared("ps", "hs")} / len(ps) AS overlap FROM {out}_w),
    {out}_d AS (SELECT k, n_premise, n_hypothesis, i, round({phrase} WHEN len(ps) = 0 THEN 0.5 ELSE greatest(0.1, least(0.9, CASE WHEN {S.has_any("ps", NLI_NEGATION)} <> {S.has_any("hs", NLI_NEGATION)} AND overlap > 0.3 THEN greatest(0.5 - 0.3 * overlap, 0.7) ELSE 0.5 - 0.3 * overlap END)) END, 9) AS d FROM {out}_o),
    {out}_i AS (SELECT k, n_premise, n_hypothesis, i, {combine[inner].format("d")} AS d FROM {out}_d GROUP BY ALL), {out} AS (SELECT k AS {key}, n_premise, n_hypothesis, {combine[outer].format("d")} AS divergence FROM {out}_i GROUP BY ALL)"""


def both_ways_sql(inner: str, outer: str) -> str:
    return f"{chunked_sql('pairs', 'fwd', inner=inner, outer=outer)}, {chunked_sql('pairs', 'rev', premise='hypothesis', hypothesis='premise', inner='min', outer='mean')}, raw AS (SELECT pair_id, least(fwd.divergence, rev.divergence) AS raw FROM fwd JOIN rev USING (pair_id))"


def coverage_sql(source: str, listed: str, least: float, inner: str = "min", outer: str = "mean", ratio: float = 0.85) -> str:
    """CTEs up to ``cov`` (pair_id, n_claims, coverage)."""
    return f"""cl AS (SELECT pair_id, premise, {listed} AS s FROM {source}), claims AS (SELECT {{'own': pair_id, 'i': i}} AS claim, premise, s[i] AS hypothesis FROM (SELECT *, generate_subscripts(s, 1) AS i FROM cl) q),
    {chunked_sql("claims", "cc", inner=inner, outer=outer, ratio=ratio, key="claim")}, cov AS (SELECT claim.own AS pair_id, count(*) AS n_claims, sum((divergence < {least})::INT) / count(*) AS coverage FROM cc GROUP BY 1)"""


PAIRS = views.SQL["pairs"]
_POINTS = f"list_transform(list_filter(string_split(hypothesis, '.'), lambda s: {trim_sql('s')} <> ''), lambda s: {trim_sql('s')} || '.')"


@query(f"WITH d AS (SELECT doc_id, {nli_sentences_sql("coalesce(text, '')")} AS s FROM documents) SELECT doc_id, len(s)::INT AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM d")
def nli_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents, not broken after abbreviations."""
    s = table(spark, sf_dir, "documents").select("doc_id", C.nli_sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS hypothesis FROM documents), s AS (SELECT doc_id, CASE WHEN len({_POINTS}) > 0 THEN {_POINTS} WHEN {trim_sql('hypothesis')} <> '' THEN [{trim_sql('hypothesis')}] ELSE [] END AS s FROM d) SELECT doc_id, len(s)::INT AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM s")
def point_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents between points."""
    s = table(spark, sf_dir, "documents").select("doc_id", C.point_sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


#: Sentences that hold several claims, put behind the hypotheses.
COMPOUND = " The river runs north and the bridge crosses it twice, but Prof. Lane said no. Costs rose by 2.3 percent while the new plant stayed closed however."


@query(rf"""WITH {PAIRS}, s AS (SELECT pair_id, {sentences_sql(f"hypothesis || '{COMPOUND}'")} AS s FROM pairs),
    p AS (SELECT pair_id, s, list_transform(flatten(list_transform(s, lambda x: string_split_regex(x, {S.rx(C.CONJUNCTIONS)}))), lambda x: {trim_sql("x")}) AS p FROM s),
    j AS (SELECT pair_id, s, string_split(array_to_string(list_transform(p, lambda x: CASE WHEN len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) >= 4 THEN chr(1) || x ELSE ' ' || x END), ''), chr(1))[2:] AS c FROM p)
    SELECT pair_id, len(CASE WHEN len(c) > 0 THEN c ELSE s END)::INT AS n_claims, md5(array_to_string(CASE WHEN len(c) > 0 THEN c ELSE s END, chr(10))) AS claims_md5 FROM j""")
def atomic_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers broken into claims at conjunctions."""
    c = views.pairs(spark, sf_dir).select("pair_id", C.atomic_claims(F.concat("hypothesis", F.lit(COMPOUND))).alias("c"))
    return c.select("pair_id", F.size("c").alias("n_claims"), F.md5(F.array_join("c", "\n")).alias("claims_md5"))


@query(f"WITH {PAIRS}, {chunked_sql('pairs', 'o')} SELECT pair_id, round(divergence, 6) AS divergence, n_premise::INT AS n_premise, n_hypothesis::INT AS n_hypothesis FROM o")
def chunked_nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked divergence of each pair; the worst chunk rules."""
    return C.chunked(views.pairs(spark, sf_dir), "pair_id").select("pair_id", *r6("divergence"), "n_premise", "n_hypothesis")


@query(f"WITH {PAIRS}, {both_ways_sql('min', 'mean')} SELECT pair_id, round(greatest(0.0, (raw - 0.8) / (1 - 0.8)), 6) AS divergence FROM raw")
def dialogue_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of dialogue turns above their baseline."""
    return C.dialogue_divergence(views.pairs(spark, sf_dir), "pair_id").select("pair_id", *r6("divergence"))


def _summary_sql(listed: str, least: float, alpha: float, **kw: str) -> str:
    return f"""WITH {PAIRS}, {both_ways_sql("max", "max")}, short AS (SELECT pair_id, substr(premise, 1, 3000) AS premise, hypothesis FROM pairs), {coverage_sql("short", listed, least, **kw)},
    a AS (SELECT pair_id, greatest(0.0, (raw - 0.2) / (1 - 0.2)) AS layer_a, coalesce(coverage, 1.0) AS coverage FROM raw LEFT JOIN cov USING (pair_id))
    SELECT pair_id, round(layer_a, 6) AS layer_a, round(coverage, 6) AS coverage, round({alpha} * (1 - coverage) + (1 - {alpha}) * layer_a, 6) AS divergence FROM a"""


@query(_summary_sql(f"CASE WHEN len({nli_sentences_sql('hypothesis')}) > 0 THEN {nli_sentences_sql('hypothesis')} ELSE [hypothesis] END", 0.6, 0.4))
def summary_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of summaries, blended with claim coverage."""
    return C.summary_divergence(views.pairs(spark, sf_dir), "pair_id").select("pair_id", *r6("layer_a", "coverage", "divergence"))


@query(_summary_sql(_POINTS, 0.5, 0.6, outer="max", inner="max"))
def sentence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of summaries, blended with coverage sentence by sentence."""
    return C.summary_divergence(views.pairs(spark, sf_dir), "pair_id", by_points=True).select("pair_id", *r6("layer_a", "coverage", "divergence"))


@query(f"""WITH {PAIRS}, {chunked_sql("pairs", "whole")}, long AS (SELECT * FROM pairs WHERE length(hypothesis) > 100), {coverage_sql("long", nli_sentences_sql("hypothesis"), 0.6, outer="max", ratio=0.4)}
    SELECT pair_id, round(CASE WHEN n_claims > 1 THEN 0.4 * (1 - coverage) + (1 - 0.4) * divergence ELSE divergence END, 6) AS score FROM whole LEFT JOIN cov USING (pair_id)""")
def grounded_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence from retrieved context, blended with claim coverage."""
    return C.grounded_divergence(views.pairs(spark, sf_dir), "pair_id").select("pair_id", *r6("score"))


@query(f"WITH {PAIRS}, {chunked_sql('pairs', 'o')} SELECT pair_id, round(greatest(0.0, least(1.0, (1 - (0.6 * divergence + 0.4 * 0.5) - 0.2) / 0.6)), 6) AS coherence FROM o")
def ungrounded_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence without retrieved facts, rescaled to [0, 1]."""
    scored = C.chunked(views.pairs(spark, sf_dir), "pair_id").withColumn("coherence", C.rescaled(1 - (0.6 * F.col("divergence") + 0.4 * 0.5)))
    return scored.select("pair_id", *r6("coherence"))


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 512 characters, by separators from paragraphs to blanks; a fold of folds."""
    c = C.recursive_chunks(table(spark, sf_dir, "documents"), "doc_id")
    return c.select("doc_id", "i", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query()
def topic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of neighbouring sentences on one topic, by hashed bags of their words."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.nli_sentences(F.coalesce("text", F.lit("")))).alias("i", "sentence"))
    bags = guards.hash_bag(s, 64, "sentence")
    return C.topic_chunks(bags.select("doc_id", "i", "sentence", F.col("bag").alias("vector")))
