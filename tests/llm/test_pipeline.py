"""The pipeline's stages, each against what it should have kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact, mixing, simhash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.createDataFrame([(10**9, "1234 !!", "en", "s", 7), (10**9 + 1, None, "en", None, 0)], docs.schema))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf_dir).cache()
        assert out.columns == docs.columns
        ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        before = seen.collect()
        if name == "language_id":
            assert ids == sorted(r["doc_id"] for r in before if r["text"] and any(map(str.isalpha, r["text"])))
        elif name == "exact_dedup":
            assert ids == sorted(r["keep_id"] for r in exact.exact_dedup(seen).select("keep_id").distinct().collect())
        elif name == "simhash_dedup":
            assert ids == sorted(r["component_id"] for r in simhash.simhash_components(seen).select("component_id").distinct().collect())
        else:
            want = sorted(r["doc_id"] for r in mixing.mix(seen).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("times").cast("int"))).alias("k")).where("k > 0").collect())
            assert ids == want and 0 < len(ids)
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir)
    assert last.count() == seen.count() and "ids_sha256" in last.columns


def test_stages_decide_by_row(spark, sf_dir):
    """Repeated rows, null ids, and ids whose rows differ: each row has its own decision."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(40)) for w in ("brook", "cedar", "plain", "stone"))
    texts = [(5, one), (5, one), (5, one), (None, one), (None, two), (None, two), (None, three), (3, four + "  "), (7, four), (7, two + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], schema)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    kept = [(5, one), (None, two), (None, three), (3, four + "  "), (7, two + " more")]
    assert rows(corpus_pipeline.exact_dedup(spark, docs, sf_dir)) == sorted(kept, key=str)
    prints = {t: simhash.fingerprint(t.encode()) for _, t in texts}
    assert min((prints[a] ^ prints[b]).bit_count() for a, b in ((one, two), (one, three), (one, four), (two, three), (two, four), (three, four))) > 2
    got = rows(corpus_pipeline.simhash_dedup(spark, docs, sf_dir))
    near = (prints[two] ^ prints[two + " more"]).bit_count() <= 2
    assert got == sorted([(5, one), (None, three), (3, four + "  "), (7, two + " more")] + ([] if near else [(None, two)]), key=str)
    many = [(None if k % 3 == 0 else k % 7, " ".join(["word"] * (k % 50 + 1)), "en", "ab"[k % 2], 0) for k in range(600)]
    docs = spark.createDataFrame(many, schema)
    words = mixing.word_count(F.col("text"))
    out = corpus_pipeline.mix_sources(spark, docs, sf_dir).groupBy("source").agg(F.sum(words).alias("n")).collect()
    wanted = docs.groupBy("source").agg(F.sum(words).alias("n")).orderBy("source").collect()
    targets = mixing.source_targets([r["n"] for r in wanted], [5.0, 2.0], 1.5, 2.0)
    found = {r["source"]: r["n"] for r in out}
    assert all(abs(found[r["source"]] - t) <= 50 for r, t in zip(wanted, targets, strict=True))


def test_stages_with_clashing_columns(spark, sf_dir):
    """Extra columns whose names repeat or differ in case only, null values everywhere, and an empty table."""
    rows = [(k if k % 4 else None, f"the text number {k % 9} of some words" if k % 5 else None, "en" if k % 3 else None, "ab"[k % 2], k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.selectExpr("*", "1 AS DOC_ID", "2 AS TEXT", "3 AS times", "4 AS id", "5 AS Lang", "6 AS `a.b`", "7 AS copy", "8 AS Source")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns
        got = sorted((tuple(r)[:5] for r in out.collect()), key=str)
        assert got == sorted((tuple(r) for r in stage(spark, docs, sf_dir).collect()), key=str), name
        assert all(tuple(r)[5:] == (1, 2, 3, 4, 5, 6, 7, 8) for r in out.collect())
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, wide, sf_dir)
    assert last.count() == len(rows)


def test_language_stage_without_labels(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "12 !", None, "s", 1), (3, None, None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect()] == [1]
