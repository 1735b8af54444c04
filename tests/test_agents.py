"""Operators on agents and evidence against plain Python, on small and awkward inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import agents as A
from tidemark.operators import evidence as E
from tidemark.operators import retrieval


def test_credibility_is_the_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for s in range(5):
        t, score = 0, None
        for i in range(rng.randint(1, 30)):
            gap = rng.choice([0, 1, 86_400_000_000, 700_000_000_000])
            t, x = t + gap, rng.randint(0, 1000)
            d = 0.5 ** (gap / A.HALF_LIFE)
            score = (0.5 + x / 1000) / 2 if score is None else d * score + (1 - d) * x / 1000
            rows.append((s, t, i, x))
        want[s] = score
    rng.shuffle(rows)
    got = {r["source"]: r["score"] for r in A.credibility(spark.createDataFrame(rows, "source int, micros long, idx long, milli long")).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_stationary_against_numpy(spark):
    edges = [(0, 1, 2), (1, 2, 1), (2, 0, 3), (2, 3, 1), (1, 0, 1)]  # node 3 has no way out
    n, p = 4, np.full(4, 0.25)
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[a, b] = w
    sums = m.sum(1, keepdims=True)
    m = 0.5 * np.eye(n) + 0.5 * np.where(sums > 0, m / np.maximum(sums, 1), 1 / n)
    for _ in range(500):
        p = p @ m
    got = A.stationary(spark.createDataFrame(edges, "src long, dst long, weight long")).orderBy("node").collect()
    assert [r["p"] for r in got] == pytest.approx(list(p), abs=1e-5)


def test_shortest_paths_and_cycles(spark):
    edges = spark.createDataFrame([(0, 1, 5), (0, 2, 1), (2, 1, 1), (1, 0, 1), (7, 8, 1), (0, 2, 9)], "src long, dst long, cost long")
    assert {tuple(r) for r in A.shortest_paths(edges, 0).collect()} == {(0, 0), (2, 1), (1, 2)}


def test_boxes_bargains_and_games(spark):
    points = spark.createDataFrame([(1, -0.5, 0.0, 0.0), (2, 3.0, 0.0, 0.0), (3, None, 0.0, 0.0)], "point_id long, x double, y double, z double")
    boxes = spark.createDataFrame([(9, -1.0, 3.0, 0.0, 0.0, 0.0, 1.0), (8, 2.0, 1.0, 0.0, 1.0, 0.0, 1.0)], "box_id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    assert {tuple(r) for r in A.points_in_boxes(points, boxes, 1.0).collect()} == {(1, 9), (2, 9)}
    split = A.bargain(spark.createDataFrame([(1, 1, 1, 0, 0)], "pool long, v0 long, v1 long, d0 long, d1 long"), 10).first()
    assert (split["share0"], split["share1"], split["product"]) == (5, 5, 25.0)
    dilemma = spark.createDataFrame([(1, 0, 0, 3, 3), (1, 0, 1, 0, 5), (1, 1, 0, 5, 0), (1, 1, 1, 1, 1)], "game long, r long, c long, u0 long, u1 long")
    assert [(r["r"], r["c"]) for r in A.equilibria(dilemma).where("nash").collect()] == [(1, 1)]
    pennies = spark.createDataFrame([(1, 0, 0, 1, -1), (1, 0, 1, -1, 1), (1, 1, 0, -1, 1), (1, 1, 1, 1, -1)], dilemma.schema)
    assert [tuple(r) for r in A.mixed_equilibria(pennies).collect()] == [(1, 0.5, 0.5)]


def test_irreversible_actions_and_sandbox(spark):
    rows = spark.createDataFrame([(1, "DELETE it"), (1, None), (1, "dry-run delete"), (1, "lint")], "session long, action string")
    got = E.irreversibility(rows).first()
    assert (got["irreversible"], got["reversible"], got["unknown"]) == (1, 1, 2)
    assert got["log10_reversible"] == pytest.approx(math.log10(0.05 * 0.95 * 0.25))
    seen = E.breakouts(spark.createDataFrame([(1, None, None), (2, "Act As If LIVE", "https://API.stripe.com/x")], "event_id long, text string, url string"))
    assert {tuple(r)[1] for r in seen.collect()} == {"anti_anchor_injection", "production_target"}


def test_sub_queries(spark):
    df = spark.createDataFrame([("What is the capital? When did it burn and who rebuilt it",), ("short",), ("",)], "q string")
    got = [r[0] for r in df.select(E.sub_queries(F.col("q"))).collect()]
    assert got == [["What is the capital", "When did it burn", "who rebuilt it"], ["short"], [""]]


def test_dense_in_blocks_is_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v[7] = v[9]  # a tie
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)] + [(500, None)], "vec_id long, embedding array<double>").repartition(5)
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.dense(rows, rows.where("vec_id % 10 = 0"), n=4, block=16).collect()}
    want = {}
    for q in range(0, 300, 10):
        s = np.round(v @ v[q], 9)
        best = sorted((d for d in range(300) if d != q and s[d] > 0), key=lambda d: (-s[d], d))[:4]
        want |= {(q, k + 1): d for k, d in enumerate(best)}
    assert got == want


def test_empty_inputs(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    assert E.consensus(none("prompt_id long, model_idx long, text string")).count() == 0
    assert A.fingerprints(none("agent long, idx long, value long")).count() == 0
    assert A.stationary(none("src long, dst long, weight long")).count() == 0
    assert A.claim_conflicts(none("id long, negated boolean"), none("source long, target long, kind string")).count() == 0
    vectors = none("vec_id long, embedding array<double>")
    assert retrieval.dense(vectors, vectors).count() == 0
