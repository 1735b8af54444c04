"""Retrieval: set similarity, BM25, dense search, rank fusion, keyword facts.

Queries meet documents by equi-joins on terms; a nested loop over all pairs is never planned. Every ranking has the
document id as its tie-break.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources.shared import store


def top(df: DataFrame, score: Column, n: int, by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The ``n`` best rows of each query as ``rank`` 1 to n."""
    w = Window.partitionBy(by).orderBy(score.desc(), F.col(tie))
    best = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return best.withColumn("rank", F.col("rank").cast("bigint"))  # after the filter, which limits groups before the shuffle


#: Rows of query postings that are broadcast at most; more are joined by their terms.
MOST_POSTINGS = 2_000_000


def terms(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``key, term, tf, length``: one row per term of a text."""
    # In two steps, so that the length is read off the column and the pattern does not run again for every term.
    listed = df.select(key, T.find_all(F.lower(column), T.WORD).alias("tokens"))
    exploded = listed.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return exploded.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def sent_out(postings: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What broadcasts a table of at most a row for each posting, where the postings of queries were counted to be few."""
    few = postings.limit(MOST_POSTINGS + 1).count() <= MOST_POSTINGS
    return F.broadcast if few else lambda df: df


def jaccard_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, doc_id, shared, similarity`` by word-set Jaccard, for all that share a word.

    A document's words are dealt by its id once; they meet the queries' words and are counted where they are, so pairs
    of query and document do not travel.
    """
    d = docs.select("doc_id", T.words(F.col("text")).alias("words")).select("doc_id", F.size("words").alias("d_size"), F.explode("words").alias("term")).repartition("doc_id")
    q = queries.select("query_id", T.words(F.col("text")).alias("words")).select("query_id", F.size("words").alias("q_size"), F.explode("words").alias("term"))
    hits = d.join(sent_out(q)(q), "term").groupBy("query_id", "doc_id", "q_size", "d_size").agg(F.count(F.lit(1)).alias("shared"))
    return hits.select("query_id", "doc_id", "shared", (F.col("shared") / (F.col("q_size") + F.col("d_size") - F.col("shared"))).alias("similarity"))


def jaccard_search(docs: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """``query_id, doc_id, shared, similarity, rank`` by word-set Jaccard; documents without a shared word don't count."""
    return top(jaccard_hits(docs, queries), F.col("similarity"), n).select("query_id", "doc_id", "shared", "similarity", "rank")


def children(docs: DataFrame, size: int = 256) -> DataFrame:
    """``doc_id, text``: pieces of ``size`` characters; ids are the document's times 2^24 plus the place (ids below 2^39)."""
    cut = docs.select(F.col("doc_id").alias("parent"), F.posexplode(T.find_all(F.col("text"), f"(?s).{{1,{size}}}")).alias("i", "text"))
    return cut.select((F.col("parent") * 16777216 + F.col("i")).alias("doc_id"), "text")


def parent_child(docs: DataFrame, queries: DataFrame, n: int = 5, fetch: int = 5, size: int = 256) -> DataFrame:
    """``query_id, doc_id, child, similarity, rank``: parents of the ``fetch * n`` best pieces, each by its first piece."""
    found = jaccard_search(children(docs, size), queries, n * fetch).withColumns({"child": F.col("doc_id") % 16777216, "parent": F.floor(F.col("doc_id") / 16777216).cast("bigint")})
    first = found.groupBy("query_id", F.col("parent").alias("doc_id")).agg(F.min(F.struct("rank", "child", "similarity")).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.rank")
    ranked = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return ranked.select("query_id", "doc_id", F.col("f.child").alias("child"), F.col("f.similarity").alias("similarity"), F.col("place").cast("bigint").alias("rank"))


def multi_vector(reps: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """``query_id, doc_id, similarity, rank`` by each document's best representation (``doc_id, rep, text``; rep 0 to 3)."""
    hits = jaccard_hits(reps.select((F.col("doc_id") * 4 + F.col("rep")).alias("doc_id"), "text"), queries)
    best = hits.groupBy("query_id", F.floor(F.col("doc_id") / 4).cast("bigint").alias("doc_id")).agg(F.max("similarity").alias("similarity"))
    return top(best, F.col("similarity"), n)


def bm25(docs: DataFrame, queries: DataFrame, n: int = 5, k1: float = 1.2, b: float = 0.75, tenant: str | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank``; idf = ln((N - df + 0.5) / (df + 0.5) + 1), statistics over all documents.

    A query term counts as often as the query repeats it. ``tenant`` names a column of both sides: only documents of the
    query's own tenant are ranked, the statistics stay those of all. Weights are summed as whole billionths, so the sums
    do not depend on the order of rows and aggregate on the map side.
    """
    owner = lambda: (F.col(tenant) if tenant else F.lit(0)).alias("tenant")
    listed = docs.select("doc_id", owner(), T.find_all(F.lower("text"), T.WORD).alias("tokens")).select("doc_id", "tenant", F.size("tokens").alias("length"), "tokens")
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(T.find_all(F.lower("text"), T.WORD))).alias("mean_length"))
    q = terms(queries, "query_id").select("query_id", "term", F.col("tf").alias("q_tf"))
    out = sent_out(q)
    # Only terms that a query has are dealt and counted further; a document's terms stay together from there on.
    used = listed.select("doc_id", "tenant", "length", F.explode("tokens").alias("term")).join(out(q.select("term").distinct()), "term", "left_semi")
    used = used.repartition("doc_id").groupBy("doc_id", "tenant", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = q.join(queries.select("query_id", owner()).withColumnRenamed("tenant", "q_tenant"), "query_id") if tenant else q.withColumn("q_tenant", F.lit(0))
    rows = used.join(out(asked.join(df, "term")), "term").where(F.col("tenant").eqNullSafe(F.col("q_tenant"))).crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("q_tf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = rows.groupBy("query_id", "doc_id").agg((F.sum(F.round(weight * 1e9).cast("bigint")) / 1e9).alias("score"))
    return top(scored, F.col("score"), n).select("query_id", "doc_id", "score", "rank")


def dense(vectors: DataFrame, queries: DataFrame, n: int = 5, block: int = 4096) -> DataFrame:
    """Brute-force search of unit vectors by inner product: ``query_id, doc_id, score, rank``.

    Queries go out in blocks of about half of ``block`` rows, which bounds what each task holds. A task keeps the
    ``n`` best of its own rows for each query, so the shuffle carries n rows a query and task, not all pairs. The
    query itself is not among its results, nor are scores of 0 or less.
    """
    total = queries.count()
    blocks = max(1, -(-total // max(1, block // 2)))
    queries = queries.select("vec_id", "embedding").where("embedding IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = None
    for i in range(blocks):
        part = dense_block(vectors, queries.where(F.col("block") == i).toPandas(), n)
        part = part if blocks == 1 else store(part, "dense")
        found = part if found is None else found.unionByName(part)
    return top(found, F.col("score"), n)


def dense_block(vectors: DataFrame, block: pd.DataFrame, n: int) -> DataFrame:
    """The ``n`` best rows of each task for a bounded block of queries: ``query_id, doc_id, score``."""
    ids = block["vec_id"].to_numpy(np.int64)
    matrix = np.array(block["embedding"].tolist() or [[0.0]], np.float64)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for rows in batches:
            rows = rows.dropna()
            for at in range(0, len(rows) if len(ids) else 0, 1024):
                piece = rows.iloc[at : at + 1024]
                docs = piece["vec_id"].to_numpy(np.int64)
                scores = np.round(np.array(piece["embedding"].tolist(), np.float64) @ matrix.T, 9)
                scores[docs[:, None] == ids[None, :]] = -1.0
                r, q = np.nonzero(scores > 0)
                made = pd.DataFrame({"query_id": ids[q], "doc_id": docs[r], "score": scores[r, q]})
                best = made if best is None else pd.concat([best, made])
                best = best.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True]).groupby("query_id").head(n)
        if best is not None:
            yield best

    return vectors.select("vec_id", "embedding").mapInPandas(search, "query_id bigint, doc_id bigint, score double")


def fuse(rankings: list[tuple[DataFrame, float]], n: int = 5, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion, sum of weight / (k + rank): ``query_id, doc_id, fused, rank``."""
    parts = None
    for ranking, weight in rankings:
        part = ranking.select("query_id", "doc_id", (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("fused"))
    return top(fused, F.col("fused"), n)


def keyword_facts(facts: DataFrame, queries: DataFrame, n: int = 0, tenant: str = "") -> DataFrame:
    """``query_id, answer, n_facts``: values of facts any of whose key words lies within the query, joined by ``; ``.

    Facts (``fact_id, key, value``) come in the order of their ids, ``n`` of them at most (0: all). Keys and queries are
    lower-cased, keys split at white space; a key word may be part of a longer word. Under a ``tenant`` only keys that
    begin with ``tenant:`` count, without that prefix. Queries without a hit have no row. Key words meet queries by
    their first three characters, an equi-join, and are tested for containment afterwards.
    """
    key = F.col("key")
    if tenant:
        facts, key = facts.where(key.startswith(f"{tenant}:")), F.substring(key, len(tenant) + 2, 2**31 - 1)
    f = facts.select("fact_id", "value", F.explode(F.array_distinct(F.filter(F.split(F.lower(key), r"\s+"), lambda w: w != ""))).alias("word"))
    f = f.withColumn("gram", F.substring("word", 1, 3))
    q = queries.select("query_id", F.lower("text").alias("text")).where(F.char_length("text") > 0)
    places = F.sequence(F.lit(1), F.char_length("text"))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.substring(F.col("text"), i, F.lit(k)) for k in (1, 2, 3)]))))
    # The text is not carried through the explode: words that a gram admits are few, and meet their query again.
    near = q.select("query_id", F.explode(grams).alias("gram")).join(f.select("gram", "word").distinct(), "gram").select("query_id", "word").distinct()
    inside = q.join(near, "query_id").where(F.contains("text", "word")).select("query_id", "word")
    hits = inside.join(f, "word").select("query_id", "fact_id", "value").distinct()
    found = F.array_sort(F.collect_list(F.struct("fact_id", "value")))
    found = F.slice(found, 1, n) if n else found
    return hits.groupBy("query_id").agg(found.alias("found")).select("query_id", F.array_join(F.transform("found", lambda x: x["value"]), "; ").alias("answer"), F.size("found").cast("bigint").alias("n_facts"))


def chunk_paragraphs(docs: DataFrame, most_words: int = 120) -> DataFrame:
    """Lines packed greedily into chunks of at most ``most_words`` words: ``doc_id, chunk_no, n_words, n_lines``."""
    lines = F.filter(F.split("text", r"\n"), lambda x: F.btrim(x) != "")
    sizes = F.transform(lines, lambda x: F.size(T.find_all(x, r"\S+")))
    start = F.array().cast("array<struct<words:int,lines:int>>")

    def grow(acc, size):
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (last["words"] + size <= most_words)
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["words"] + size).alias("words"), (last["lines"] + 1).alias("lines"))))
        return F.when(fits, wider).otherwise(F.concat(acc, F.array(F.struct(size.alias("words"), F.lit(1).alias("lines")))))

    packed = docs.select("doc_id", F.posexplode(F.aggregate(sizes, start, grow)).alias("chunk_no", "c"))
    return packed.select("doc_id", "chunk_no", F.col("c.words").alias("n_words"), F.col("c.lines").alias("n_lines"))


def nearest_centroid(vectors: DataFrame, most_labels: int = 10_000) -> DataFrame:
    """``vec_id, label, predicted, margin``: the label of the centroid of largest cosine, and its lead over the next.

    Centroids are one row per label; their number is checked before they are broadcast.
    """
    rows = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    parts = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centroids = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    centroids = centroids.select(F.col("label").alias("k"), "c", F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
    if centroids.limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    scored = rows.join(F.broadcast(centroids)).select("vec_id", "label", "k", F.round(F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.col("norm"), 7).alias("score"))
    ranked = scored.groupBy("vec_id", "label").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", (-F.col("k")).alias("k"))))), 1, 2).alias("top"))
    return ranked.select("vec_id", "label", (-F.col("top")[0]["k"]).alias("predicted"), (F.col("top")[0]["score"] - F.col("top")[1]["score"]).alias("margin"))
