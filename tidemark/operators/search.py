"""Searches built on others: rerankers, late interaction, stores with a fallback, merged sub-queries, abstention, judges.

Queries have ``query_id, text``, documents ``doc_id, text``; null texts are empty. Every ranking has the document's id as
its tie-break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import evidence, pairs, retrieval

# What a judge's verdict is worth as a divergence, and its weight at full confidence.
AGREES, DISAGREES, JUDGE_WEIGHT = 0.2, 0.8, 0.3
NEUTRAL = 0.5


def reranked(docs: DataFrame, queries: DataFrame, n: int = 5, fetch: int = 3) -> DataFrame:
    """``query_id, doc_id, relevance, rank``: the ``fetch * n`` best by BM25, ordered anew by a scorer of (query, document) pairs.

    The scorer is 1 - lite divergence; any other pair scorer fits its place.
    """
    first = retrieval.bm25(docs, queries, n * fetch).select("query_id", "doc_id")
    met = first.join(queries.select("query_id", F.col("text").alias("premise")), "query_id").join(docs.select("doc_id", F.col("text").alias("hypothesis")), "doc_id")
    scored = pairs.lite_divergence(met.withColumns({"premise": F.coalesce("premise", F.lit("")), "hypothesis": F.coalesce("hypothesis", F.lit(""))}))
    return retrieval.top(scored.select("query_id", "doc_id", F.round(1 - F.col("divergence"), 9).alias("relevance")), F.col("relevance"), n)


def late_interaction(docs: DataFrame, queries: DataFrame, n: int = 5, block: int = 1024) -> DataFrame:
    """``query_id, doc_id, score, rank``: for each vector of the query the best of the document's, summed.

    Rows hold ``doc_id`` or ``query_id`` and ``vectors array<array<float>>``. Queries go out in blocks of at most ``block`` rows; a task
    keeps its ``n`` best documents for each query, so the shuffle carries n rows a query and task. Rows without vectors
    take no part; a document is not among the results of the query with its id.
    """
    asked = queries.where(F.size("vectors") > 0).select("query_id", "vectors")
    blocks = max(1, -(-asked.count() // max(1, block // 2)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    found = None
    for i in range(blocks):
        rows = asked.where(F.col("block") == i).select("query_id", "vectors").collect()
        part = _late_block(docs, [r["query_id"] for r in rows], [np.array(r["vectors"], np.float64) for r in rows], n)
        found = part if found is None else found.unionByName(part)
    return retrieval.top(found, F.col("score"), n)


def _late_block(docs: DataFrame, ids: list, matrices: list[np.ndarray], n: int) -> DataFrame:
    """The ``n`` best documents of each task for a bounded block of queries."""
    cuts = np.cumsum([0, *map(len, matrices)])
    stacked = np.concatenate(matrices) if matrices else np.zeros((0, 1))
    names = np.array(ids, np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, 3))
        for batch in batches:
            rows = []
            for key, vectors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vectors and len(names):
                    top = np.round(stacked @ np.array(vectors, np.float64).T, 9).max(axis=1)
                    score = np.round(np.add.reduceat(top, cuts[:-1]), 6)
                    rows.append(np.stack([names, np.full(len(names), key), score], axis=1)[names != key])
            if rows:
                made = np.concatenate([best, *rows])
                made = made[np.lexsort((made[:, 1], -made[:, 2], made[:, 0]))]
                first = np.flatnonzero(np.concatenate([[True], made[1:, 0] != made[:-1, 0]]))
                place = np.arange(len(made)) - np.repeat(first, np.diff(np.append(first, len(made))))
                best = made[place < n]
        yield pa.record_batch([pa.array(best[:, 0].astype(np.int64)), pa.array(best[:, 1].astype(np.int64)), pa.array(best[:, 2].copy())], ["query_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "vectors").mapInArrow(search, "query_id bigint, doc_id bigint, score double")


def store_context(facts: DataFrame, queries: DataFrame, n: int = 3, least: float = 0.0) -> DataFrame:
    """``query_id, context, source``: texts of the ``n`` facts (``fact_id, key, value``) most like the query, as ``key: value``, joined by ``; ``.

    Where none has a similarity above ``least``, keyword facts answer; queries that these do not answer either have a null
    context.
    """
    entries = facts.select(F.col("fact_id").alias("doc_id"), F.concat_ws(": ", "key", "value").alias("text"))
    hits = retrieval.jaccard_search(entries, queries, n).where(F.col("similarity") > least).join(entries, "doc_id")
    near = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "; ").alias("near"))
    keyed = retrieval.keyword_facts(facts, queries, n).select("query_id", F.col("answer").alias("keyed"))
    out = queries.select("query_id").distinct().join(near, "query_id", "left").join(keyed, "query_id", "left")
    source = F.when(F.col("near").isNotNull(), "vectors").when(F.col("keyed").isNotNull(), "keywords")
    return out.select("query_id", F.coalesce("near", "keyed").alias("context"), source.alias("source"))


def merged_search(docs: DataFrame, queries: DataFrame, n: int = 3, most_parts: int = 5, k: int = 60) -> DataFrame:
    """``query_id, doc_id, fused, rank``: each of a query's first ``most_parts`` questions searched, ranks merged by reciprocal rank.

    ``fused`` is the sum of 1 / (k + rank); a single question passes with its ranks.
    """
    parts = queries.select("query_id", F.posexplode(F.slice(evidence.sub_queries(F.coalesce("text", F.lit(""))), 1, most_parts)).alias("part", "text"))
    asked = parts.select(F.struct("query_id", "part").alias("query_id"), "text")
    hits = retrieval.jaccard_search(docs, asked, max(n, 3))
    fused = hits.groupBy(F.col("query_id.query_id").alias("query_id"), "doc_id").agg(F.round(F.sum(F.round(1e12 / (k + F.col("rank"))).cast("bigint")) / 1e12, 9).alias("fused"))
    return retrieval.top(fused, F.col("fused"), n)


def search_text(query: Column, generated: Column) -> Column:
    """What is searched for: the generated answer, where there is one, else the query itself."""
    made = F.btrim(F.coalesce(generated, F.lit("")), F.lit(" \t\n\r"))
    return F.when(made != "", made).otherwise(query)


def abstained(hits: DataFrame, scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``query_id, best, divergence``: neutral where a query's best distance (1 - score) is over 1 - ``threshold``, or it has no hit.

    ``hits``: ``query_id, score``; ``scored``: ``query_id, divergence``.
    """
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    out = scored.join(best, "query_id", "left")
    weak = F.col("best").isNull() | (F.round(1 - F.col("best"), 9) > 1 - threshold)
    return out.select("query_id", "best", F.when(weak, NEUTRAL).otherwise(F.col("divergence")).alias("divergence"))


def judged(rows: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Adds ``escalated`` (the score lies within ``threshold`` of 0.5), ``agrees``, ``judge_confidence`` and ``adjusted``.

    ``score`` is a divergence, ``reply`` the judge's JSON (verdict YES, confidence in percent). A reply that does not
    parse agrees if it holds YES, at confidence 0.5. Scores that are not escalated, or have no reply, stay.
    """
    parsed = F.try_parse_json("reply")
    verdict = F.upper(F.coalesce(F.get_json_object("reply", "$.verdict"), F.lit("")))
    said = F.get_json_object("reply", "$.confidence")
    number = F.coalesce(said.try_cast("double"), F.when(said.isNull(), F.lit(50.0)))
    readable = parsed.isNotNull() & F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)) & number.isNotNull()
    agrees = F.when(readable, verdict == "YES").otherwise(F.upper("reply").contains("YES"))
    confidence = F.when(readable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), number / 100))).otherwise(0.5)
    out = rows.withColumns({"escalated": F.abs(F.col("score") - 0.5) < threshold, "agrees": agrees, "judge_confidence": confidence})
    weight = JUDGE_WEIGHT * F.col("judge_confidence")
    blend = T.clamp((1 - weight) * F.col("score") + weight * F.when(F.col("agrees"), AGREES).otherwise(DISAGREES))
    return out.withColumn("adjusted", F.when(F.col("escalated") & F.col("reply").isNotNull(), blend).otherwise(F.col("score")))
