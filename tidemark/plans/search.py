"""Queries over searches, logic, swarms and clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graphs, logic, retrieval, search
from tidemark.plans.catalog import BM25, SETS
from tidemark.plans.registry import SQL, query, r6
from tidemark.sources import views
from tidemark.sources.tables import table

_DOC_TERMS = r"""d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS term FROM {docs}), dn AS (SELECT doc_id, count(*) AS s FROM d GROUP BY 1),
    q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS term FROM {queries}), qn AS (SELECT query_id, count(*) AS s FROM q GROUP BY 1),
    h AS (SELECT query_id, doc_id, count(*) AS shared FROM d JOIN q USING (term) GROUP BY 1, 2), j AS (SELECT query_id, doc_id, shared / (qn.s + dn.s - shared) AS similarity FROM h JOIN dn USING (doc_id) JOIN qn USING (query_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM j)"""


def jaccard_sql(docs: str, queries: str) -> str:
    """CTEs up to ``ranked`` (query_id, doc_id, similarity, rank)."""
    return _DOC_TERMS.format(docs=docs, queries=queries)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")


_LITE = SQL["lite_divergence"][SQL["lite_divergence"].index("SELECT pair_id") :]


@query(f"""WITH {BM25}, pairs AS (SELECT query_id, doc_id, query_id * 1000000007 + doc_id AS pair_id, coalesce(q.text, '') AS premise, coalesce(x.text, '') AS hypothesis FROM bm JOIN (SELECT item_id AS query_id, text FROM benchmark) q USING (query_id) JOIN documents x USING (doc_id) WHERE rank <= 15),
    {SETS[SETS.index("sets AS") :]}, lite AS ({_LITE.replace("round(CASE", "(CASE").replace(", 6) AS divergence", ") AS divergence")}),
    r AS (SELECT query_id, doc_id, round(1 - divergence, 9) AS relevance FROM pairs JOIN lite USING (pair_id)), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS rank FROM r)
    SELECT query_id, doc_id, round(relevance, 6) AS relevance, rank FROM k WHERE rank <= 5""")
def reranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for each benchmark passage by BM25, ordered anew pair by pair (top-k report)."""
    return search.reranked(table(spark, sf_dir, "documents"), benchmark(spark, sf_dir)).select("query_id", "doc_id", *r6("relevance"), "rank")


_OWN = BM25.replace("AS rank FROM b)", "AS rank FROM b WHERE query_id % 3 = doc_id % 3)")


@query(f"WITH {_OWN} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 5")
def tenant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each passage's own tenant by BM25 (top-k report); tenants are ids modulo 3."""
    docs = table(spark, sf_dir, "documents").withColumn("owner", F.col("doc_id") % 3)
    queries = benchmark(spark, sf_dir).withColumn("owner", F.col("query_id") % 3)
    return retrieval.bm25(docs, queries, tenant="owner").select("query_id", "doc_id", *r6("score"), "rank")


_TOKENS = "t AS (SELECT vec_id // 4 AS doc_id, vec_id AS tok, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"


@query(f"""WITH {_TOKENS}, s AS (SELECT q.doc_id AS query_id, d.doc_id, q.tok, max(round(list_dot_product(q.v, d.v), 9)) AS m FROM t q, t d WHERE q.doc_id % 100 = 0 AND q.doc_id <> d.doc_id GROUP BY 1, 2, 3),
    f AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id::BIGINT AS query_id, doc_id::BIGINT AS doc_id, score, rank FROM r WHERE rank <= 5""")
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of four vectors each, nearest to every hundredth by late interaction (top-k report over all)."""
    listed = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").groupBy(F.floor(F.col("vec_id") / 4).cast("bigint").alias("doc_id"))
    docs = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    return search.late_interaction(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))


_FACTS = "facts AS (SELECT item_id AS fact_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS key, text AS value FROM benchmark)"
_ASKED = "asked AS (SELECT conv_id * 10000 + turn AS query_id, CASE WHEN turn % 4 = 0 THEN '12 34' ELSE text END AS text FROM conversations WHERE role = 'user')"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("key"), F.col("text").alias("value"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of users; some hold numbers only, so that nothing is like them."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'")
    return q.select((F.col("conv_id") * 10000 + F.col("turn")).alias("query_id"), F.when(F.col("turn") % 4 == 0, "12 34").otherwise(F.col("text")).alias("text"))


@query(rf"""WITH {_FACTS}, {_ASKED}, entries AS (SELECT fact_id AS doc_id, key || ': ' || value AS text FROM facts), {jaccard_sql("entries", "asked")},
    near AS (SELECT query_id, string_agg(text, '; ' ORDER BY rank) AS near FROM ranked JOIN entries USING (doc_id) WHERE rank <= 3 AND similarity > 0 GROUP BY 1),
    w AS (SELECT fact_id, value, unnest(list_filter(string_split_regex(lower(key), '\s+'), lambda x: x <> '')) AS word FROM facts), k AS (SELECT DISTINCT query_id, fact_id, value FROM asked JOIN w ON contains(lower(text), word)),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fact_id) AS n FROM k), keyed AS (SELECT query_id, string_agg(value, '; ' ORDER BY fact_id) AS keyed FROM n WHERE n <= 3 GROUP BY 1)
    SELECT query_id, md5(coalesce(near, keyed)) AS context_md5, CASE WHEN near IS NOT NULL THEN 'vectors' WHEN keyed IS NOT NULL THEN 'keywords' END AS source FROM (SELECT DISTINCT query_id FROM asked) LEFT JOIN near USING (query_id) LEFT JOIN keyed USING (query_id)""")
def store_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of users' questions from a store of facts, by likeness or else by key words."""
    found = search.store_context(facts(spark, sf_dir), asked(spark, sf_dir))
    return found.select("query_id", F.md5("context").alias("context_md5"), "source")


@query(rf"""WITH {views.SQL["pairs"]}, parts AS (SELECT pair_id, string_split(regexp_replace(regexp_replace(premise || '; ' || hypothesis, '\s*[?]\s+([A-Z])', chr(1) || '\1', 'g'), '(?i)\s*(?:\band\b|\bor\b|\balso\b|\badditionally\b|[;]\s*|\d+[.)]\s)\s*', chr(1), 'g'), chr(1)) AS p, premise || '; ' || hypothesis AS q FROM pairs),
    kept AS (SELECT pair_id, q, list_filter(list_transform(p, lambda x: trim(rtrim(trim(x, ' ' || chr(9) || chr(10) || chr(13)), '?'), ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 8) AS k FROM parts),
    sub AS (SELECT pair_id, (CASE WHEN len(k) > 0 THEN k ELSE [q] END)[1:5] AS k FROM kept), asked AS (SELECT {{'query_id': pair_id, 'part': i}} AS query_id, k[i] AS text FROM (SELECT *, generate_subscripts(k, 1) AS i FROM sub) z), items AS (SELECT item_id AS doc_id, text FROM benchmark), {jaccard_sql("items", "asked")},
    f AS (SELECT query_id.query_id AS query_id, doc_id, round(sum(round(1e12 / (60 + rank))::BIGINT) / 1e12, 9) AS fused FROM ranked WHERE rank <= 3 GROUP BY 1, 2), k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM f)
    SELECT query_id, doc_id, round(fused, 6) AS fused, rank FROM k2 WHERE rank <= 3""")
def merged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages for compound queries, one search for each question, merged (top-k report)."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    queries = views.pairs(spark, sf_dir).select(F.col("pair_id").alias("query_id"), F.concat("premise", F.lit("; "), "hypothesis").alias("text"))
    return search.merged_search(items, queries).select("query_id", "doc_id", *r6("fused"), "rank")


@query(f"""WITH {views.SQL["pairs"]}, asked AS (SELECT pair_id AS query_id, CASE WHEN pair_id % 2 = 0 AND trim(hypothesis, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN trim(hypothesis, ' ' || chr(9) || chr(10) || chr(13)) ELSE premise END AS text FROM pairs), items AS (SELECT item_id AS doc_id, text FROM benchmark), {jaccard_sql("items", "asked")}
    SELECT query_id, doc_id, round(similarity, 6) AS similarity, rank FROM ranked WHERE rank <= 3""")
def generated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages like a generated answer, or like the query where there is none (top-k report)."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    made = F.when(F.col("pair_id") % 2 == 0, F.col("hypothesis"))
    queries = views.pairs(spark, sf_dir).select(F.col("pair_id").alias("query_id"), search.search_text(F.col("premise"), made).alias("text"))
    return retrieval.jaccard_search(items, queries, 3).select("query_id", "doc_id", *r6("similarity"), "rank")


@query(f"""WITH {_ASKED}, items AS (SELECT item_id AS doc_id, text FROM benchmark), {jaccard_sql("items", "asked")}, b AS (SELECT query_id, max(similarity) AS best FROM ranked WHERE rank <= 5 GROUP BY 1)
    SELECT query_id, round(best, 6) AS best, CASE WHEN best IS NULL OR round(1 - best, 9) > 1 - 0.1 THEN 0.5 ELSE 0.25 END::DOUBLE AS divergence FROM asked LEFT JOIN b USING (query_id)""")
def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose evidence is too far off for a verdict."""
    items, questions = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), asked(spark, sf_dir)
    hits = retrieval.jaccard_search(items, questions).select("query_id", F.col("similarity").alias("score"))
    return search.abstained(hits, questions.select("query_id", F.lit(0.25).alias("divergence")), 0.1).select("query_id", *r6("best"), "divergence")


_REPLY = """CASE event_id % 5 WHEN 0 THEN '{{"verdict": "yes", "confidence": ' || (event_id % 130) || '}}' WHEN 1 THEN '{{"verdict": "NO"}}' WHEN 2 THEN 'Yes, it does' WHEN 3 THEN 'no idea' END"""


@query(f"""WITH {views.SQL["audit"]}, r AS (SELECT event_id, 1 - score AS score, {_REPLY.format()} AS reply FROM audit),
    p AS (SELECT *, abs(score - 0.5) < 0.3 AS escalated, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS agrees, CASE event_id % 5 WHEN 0 THEN least(1.0, (event_id % 130) / 100) ELSE 0.5 END AS c FROM r)
    SELECT event_id, escalated, agrees, floor((CASE WHEN escalated AND reply IS NOT NULL THEN greatest(0.0, least(1.0, (1 - 0.3 * c) * score + 0.3 * c * CASE WHEN agrees THEN 0.2 ELSE 0.8 END)) ELSE score END) * 1e6 + 0.5001) / 1e6 AS adjusted FROM p""")
def judged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain scores blended with a judge's replies."""
    k = F.col("event_id") % 5
    reply = F.when(k == 0, F.concat(F.lit('{"verdict": "yes", "confidence": '), (F.col("event_id") % 130).cast("string"), F.lit("}"))).when(k == 1, '{"verdict": "NO"}').when(k == 2, "Yes, it does").when(k == 3, "no idea")
    rows = views.audit(spark, sf_dir).select("event_id", (1 - F.col("score")).alias("score"), reply.alias("reply"))
    return search.judged(rows).select("event_id", "escalated", "agrees", (F.floor(F.col("adjusted") * 1e6 + 0.5001) / 1e6).alias("adjusted"))


@query()
def token_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token edit distances of prompts and answers; DuckDB's distance counts bytes."""
    p = views.pairs(spark, sf_dir).select("pair_id", logic.spaced_tokens(F.col("premise")).alias("a"), logic.spaced_tokens(F.col("hypothesis")).alias("b"))
    return p.select("pair_id", logic.token_distance(F.col("a"), F.col("b")).alias("distance"), F.round(logic.edit_distance(F.col("a"), F.col("b")), 6).alias("normalised"))


@query()
def formula_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas with a clause for each line of an order, satisfiable or not; a search that SQL has no form for."""
    li = table(spark, sf_dir, "lineitem")
    literal = lambda c, m: F.when(F.col(c) % 2 == 0, (F.col(c) % m + 1)).otherwise(-(F.col(c) % m + 1)).cast("int")
    clause = F.array_distinct(F.array(literal("l_partkey", 3), literal("l_suppkey", 3)))
    lists = li.groupBy(F.col("l_orderkey").alias("formula")).agg(F.array_sort(F.collect_list(clause)).alias("clauses"))
    return logic.formula_verdicts(lists)


@query("""WITH b(branch, load, price) AS (VALUES ('as is', NULL, NULL), ('double load', 200.0, NULL), ('no price', NULL, 0.0)), v AS (SELECT o_orderkey, branch, coalesce(load, o_totalprice / 1000) AS load, price FROM orders, b),
    w AS (SELECT o_orderkey, branch, load, coalesce(price, load * 0.5 + o_custkey % 7) AS price FROM v JOIN (SELECT o_orderkey, o_custkey FROM orders) USING (o_orderkey)), s AS (SELECT o_orderkey, branch, load - 2 * price < 60 AS ok FROM w)
    SELECT o_orderkey, count(*) AS total, sum(ok::INT)::BIGINT AS safe, coalesce(array_to_string(list_sort(list(branch) FILTER (WHERE NOT ok)), ','), '') AS unsafe, round(sum(ok::INT) / count(*), 6) AS safety_rate FROM s GROUP BY o_orderkey""")
def counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under interventions on a small causal model."""
    model = logic.CausalModel({"price": (("load", "o_custkey"), lambda load, c: load * 0.5 + c % 7), "stress": (("load", "price"), lambda load, price: load - 2 * price), "load": (("o_totalprice",), lambda t: t.cast("double") / 1000)})
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    found = model.counterfactuals(rows, {"as is": {}, "double load": {"load": 200.0}, "no price": {"price": 0.0}}, F.col("stress") < 60, "o_orderkey")
    return found.select("o_orderkey", "total", "safe", F.array_join("unsafe_branches", ",").alias("unsafe"), *r6("safety_rate"))


_WALKS = """steps AS (SELECT o_orderkey AS path, row_number() OVER o AS i, (l_partkey % 6)::INT AS source, CASE WHEN l_linenumber % 5 = 0 THEN 9 ELSE (lead(l_partkey) OVER o % 6)::INT END AS target, CASE l_suppkey % 4 WHEN 0 THEN 'write' WHEN 1 THEN 'fly' ELSE 'read' END AS action,
    CASE WHEN l_orderkey % 2 = 0 THEN 'admin' ELSE 'guest' END AS role, CASE WHEN l_orderkey % 3 = 0 THEN ['audit'] ELSE ['audit', 'trace'] END AS permissions, l_orderkey % 4 AS tenant FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
    edges AS (SELECT s::INT AS source, t::INT AS target, a AS action, CASE WHEN s = 1 THEN ['admin'] ELSE [] END AS roles, CASE WHEN t = 2 THEN ['trace'] ELSE [] END AS needs, (s % 4)::BIGINT AS tenant, t = 3 AS same_tenant FROM range(6) r(s), range(6) q(t), (VALUES ('read'), ('write'), ('fly')) v(a) WHERE (s + t) % 7 <> 5)"""


@query(f"""WITH {_WALKS}, b AS (SELECT *, lag(target) OVER (PARTITION BY path ORDER BY i) AS before FROM steps), m AS (SELECT b.*, e.source AS es, e.roles, e.needs, e.tenant AS et, e.same_tenant FROM b LEFT JOIN edges e ON b.source = e.source AND b.target = e.target AND b.action = e.action),
    r AS (SELECT path, i, CASE WHEN before IS NOT NULL AND before <> source THEN 'not contiguous' WHEN es IS NULL THEN 'no edge' WHEN action NOT IN ('read', 'write', 'execute', 'delegate') THEN 'unknown action' WHEN len(roles) > 0 AND NOT list_contains(roles, role) THEN 'role'
        WHEN len(list_filter(needs, lambda x: NOT list_contains(permissions, x))) > 0 THEN 'permissions' WHEN same_tenant AND tenant IS DISTINCT FROM et THEN 'tenant' END AS reason FROM m)
    SELECT path, count(reason) = 0 AS allowed, min(i) FILTER (WHERE reason IS NOT NULL)::INT AS denied_step, coalesce(arg_min(reason, i) FILTER (WHERE reason IS NOT NULL), 'all steps sanctioned') AS reason FROM r GROUP BY path""")
def walk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed walks under the policies of a small graph's edges."""
    from pyspark.sql import Window

    k, li = F.col("l_suppkey") % 4, table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ahead = F.lead("l_partkey").over(w)
    steps = li.select(
        F.col("l_orderkey").alias("path"), F.row_number().over(w).alias("i"), (F.col("l_partkey") % 6).cast("int").alias("source"), F.when(F.col("l_linenumber") % 5 == 0, 9).otherwise((ahead % 6).cast("int")).alias("target"),
        F.when(k == 0, "write").when(k == 1, "fly").otherwise("read").alias("action"), F.when(F.col("l_orderkey") % 2 == 0, "admin").otherwise("guest").alias("role"),
        F.when(F.col("l_orderkey") % 3 == 0, F.array(F.lit("audit"))).otherwise(F.array(F.lit("audit"), F.lit("trace"))).alias("permissions"), (F.col("l_orderkey") % 4).cast("bigint").alias("tenant"),
    )
    rows = [(s, t, a, ["admin"] if s == 1 else [], ["trace"] if t == 2 else [], s % 4, t == 3) for s in range(6) for t in range(6) for a in ("read", "write", "fly") if (s + t) % 7 != 5]
    edges = spark.createDataFrame(rows, "source int, target int, action string, roles array<string>, needs array<string>, tenant bigint, same_tenant boolean")
    found = logic.walk_verdicts(steps, edges)
    return found.select("path", "allowed", F.col("denied_step").cast("int").alias("denied_step"), "reason")


@query()
def failure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents' first sentences by token edits, for each language and source; leaders depend on all before them."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    events = d.select(F.concat_ws("/", "lang", "source").alias("label"), F.col("doc_id").alias("i"), F.element_at(F.split("text", r"(?<=[.!?])\s+", 2), 1).alias("prompt"))
    return logic.leader_clusters(events).select("label", F.md5("leader").alias("leader_md5"), "support")


@query()
def swarm_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities, attractors and risk of each event type's graph of users; label propagation is a fold."""
    e = graphs.interactions(views.audit(spark, sf_dir))
    return logic.swarm_verdicts(e.select((F.col("src") % 3).alias("swarm"), "src", "dst", "weight")).select("swarm", "nodes", "communities", "cyclic", *r6("attractor", "imbalance", "risk"))
