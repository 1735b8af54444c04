"""Operators that SQL has no form for against plain Python, and the usual cases of the checked ones."""

import csv
import io
import itertools
import math
import random
import re
import time
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import calibration, chunks, further, graphs, guards, logic, policies, prefix, provenance, records, retrieval, safety, search, sequential, service, streams, verification
from tidemark.sources import formats, shared


def words(text):
    return [w for w in (text or "").lower().split() if w]


def test_reasoning_chain_usual_cases(spark):
    chains = {
        "same": ["The sky is blue today", "The sky is blue today"], "support": ["Socrates is a man and men are mortal", "Socrates is a man and men are mortal indeed"],
        "leap": ["Cats like fish.", "Quantum computers factor integers."], "odd": ["the cat sat on a mat", "the cat ate a large fish"], "one": ["alone"],
    }
    df = spark.createDataFrame([(k, i, t) for k, v in chains.items() for i, t in enumerate(v)], "chain string, step int, text string")
    got = {(r["chain"], r["step"]): r["verdict"] for r in verification.reasoning_chain(df).collect()}
    assert [got[k, 1] for k in ("same", "support", "leap", "odd")] == ["circular", "circular", "unsupported_leap", "non_sequitur"]
    assert got["same", 0] == "supported" and ("one", 0) not in got
    seven = spark.createDataFrame([("x", 0, "a b c d e f g h i j"), ("x", 1, "a b c d e f g h k")], "chain string, step int, text string")
    (last,) = [r for r in verification.reasoning_chain(seven).collect() if r["step"] == 1]
    assert last["best"] == pytest.approx(8 / 11) and last["verdict"] == "supported"


def test_steps(spark):
    texts = ["Step 1: A holds.\nStep 2: B follows.\n3. So C.", "- first thing\n- second thing", "First, we look.\nThen we act.\nTherefore, it works.", "One sentence is here. Another sentence is there. no", "short", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(verification.reasoning_steps(F.coalesce("text", F.lit("")))).collect()]
    assert got == [["A holds.", "B follows.", "So C."], ["first thing", "second thing"], ["we look.", "we act.", "it works."], ["One sentence is here", "Another sentence is there"], [], []]


def test_keyword_facts_within_words(spark):
    facts = spark.createDataFrame([(1, "sky color", "blue"), (2, "t:Capital Paris", "yes"), (3, "x", "one letter"), (4, "", "never")], "fact_id int, key string, value string")
    queries = spark.createDataFrame([(1, "What about the SKYLINE?"), (2, "paris at night"), (3, "nothing to see"), (4, None), (5, "fox and sky")], "query_id int, text string")
    got = {r["query_id"]: r["answer"] for r in retrieval.keyword_facts(facts, queries).collect()}
    assert got == {1: "blue", 2: "yes", 5: "blue; one letter"}
    assert {r["query_id"]: r["n_facts"] for r in retrieval.keyword_facts(facts, queries, 1).collect()} == {1: 1, 2: 1, 5: 1}
    assert {r["query_id"]: r["answer"] for r in retrieval.keyword_facts(facts, queries, 0, "t").collect()} == {2: "yes"}


def test_contradictions_of_the_last_turns(spark):
    rng = random.Random(2)
    turns = [(c, t, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 6)))) for c in range(4) for t in range((1, 2, 5, 26)[c])]
    got = {r["conv_id"]: r for r in streams.contradictions(spark.createDataFrame(turns, "conv_id int, turn int, text string")).collect()}
    for c in range(4):
        sets = [set(t.split()) for k, _, t in turns if k == c][-20:]
        pairs = [(i, j, round(1 - (len(a & b) / len(a | b) if a | b else 0.0), 9)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j]
        values = [d for _, _, d in pairs]
        half = len(values) // 2
        trend = sum(values[half:]) / (len(values) - half) - sum(values[:half]) / half if len(values) >= 3 else 0.0
        worst = max(pairs, key=lambda p: (p[2], -p[0], -p[1]), default=None)
        r = got[c]
        assert r["n_pairs"] == len(pairs) and r["contradiction_index"] == max(values, default=0.0) and r["trend"] == pytest.approx(trend)
        assert (r["worst_a"], r["worst_b"]) == (worst[:2] if worst and worst[2] > 0 else (None, None))


def test_chunked_scores_by_hand(spark):
    """A premise over its budget is split into sentences packed in order, each chunk from the last sentence of the one before."""
    rng = random.Random(1)
    sentence = lambda: " ".join("".join(rng.choices("abcd", k=4)) for _ in range(rng.randrange(3, 20))).capitalize() + "."
    texts = [" ".join(sentence() for _ in range(n)) for n in (1, 3, 9, 20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    for budget in (10, 40, 1000):
        got = {r["k"]: r["c"] for r in df.select("k", chunks.budget_chunks(chunks.nli_sentences(F.col("t")), budget).alias("c")).collect()}
        slid = {r["k"]: r["c"] for r in df.select("k", chunks.sliding_chunks(chunks.nli_sentences(F.col("t")), budget, 0.5).alias("c")).collect()}
        for k, t in enumerate(texts):
            parts = t.replace(". ", ".|").split("|")
            size = [len(p) // 4 + 1 for p in parts]
            want, open_, total = [], [], 0
            for i, n in enumerate(size):
                if open_ and total + n > budget:
                    want.append(open_)
                    open_, total = [i - 1], size[i - 1]
                open_, total = [*open_, i], total + n
            assert got[k] == [" ".join(parts[i] for i in c) for c in [*want, open_]]
            want, i = [], 0
            while i < len(parts):
                j, total = i + 1, size[i]
                while j < len(parts) and total + size[j] <= budget:
                    total, j = total + size[j], j + 1
                want.append(" ".join(parts[i:j]))
                i += max(1, (j - i) // 2)
            assert slid[k] == want


def test_recursive_chunks(spark):
    text = "\n\n".join(["alpha beta. gamma delta? " * 12, "x" * 900, "short", ", ".join(f"item {i}" for i in range(200))])
    df = spark.createDataFrame([(1, text), (2, "tiny"), (3, ""), (4, None)], "doc_id int, text string")
    bare = [r["chunk"] for r in chunks.recursive_chunks(df, "doc_id", size=200, overlap=0).where("doc_id = 1").orderBy("i").collect()]
    assert all(len(c) <= 200 for c in bare)
    kept = "".join(c for c in "".join(bare) if c not in " \n,.?")
    assert kept == "".join(c for c in text if c not in " \n,.?")  # nothing but separators goes
    got = chunks.recursive_chunks(df, "doc_id", size=200, overlap=20).collect()
    assert [r["chunk"] for r in got if r["doc_id"] == 2] == ["tiny"] and not [r for r in got if r["doc_id"] > 2]


def test_paragraph_chunks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").limit(60).collect()
    got = defaultdict(list)
    for r in retrieval.chunk_paragraphs(spark.createDataFrame(rows)).orderBy("doc_id", "chunk_no").collect():
        got[r["doc_id"]].append((r["n_words"], r["n_lines"]))
    for doc_id, text in rows:
        want = []
        for line in text.split("\n"):
            if line.strip(" "):
                n = len(line.split())
                if want and want[-1][0] + n <= 120:
                    want[-1] = (want[-1][0] + n, want[-1][1] + 1)
                else:
                    want.append((n, 1))
        assert got[doc_id] == want


def test_nearest_centroid(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(i % 3 == k, 0.6) for k in range(4)]) for i in range(60)]
    got = {r["vec_id"]: r["predicted"] for r in retrieval.nearest_centroid(spark.createDataFrame(rows, "vec_id int, label int, embedding array<float>")).collect()}
    means = [[sum(v[k] for _, y, v in rows if y == label) / 20 for k in range(4)] for label in range(3)]
    for i, _, v in rows:
        score = [sum(a * b for a, b in zip(v, m, strict=True)) / math.sqrt(sum(b * b for b in m)) for m in means]
        assert got[i] == max(range(3), key=lambda k: (round(score[k], 7), -k))


def test_smoothed_scores(spark):
    rows = [(t, i, i * 1000, (i * 37 + t) % 1000) for t in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "tenant long, event_id long, micros long, points long")
    got = {(r["tenant"], r["event_id"]): r["level"] for r in sequential.smoothed(df).collect()}
    for t in range(3):
        series = [got[t, i] for i in range(30)]
        alpha = (series[1] - series[0]) / ((37 + t) % 1000 - series[0])
        level = float(t)
        for i in range(30):
            level = (i * 37 + t) % 1000 if i == 0 else level + alpha * ((i * 37 + t) % 1000 - level)
            assert series[i] == pytest.approx(level)
        assert 0 < alpha <= 1


def test_forecasts(spark):
    rows = [(t, i, i * 1000, (i * 53 + t) % 97) for t in range(2) for i in range(40)]
    df = spark.createDataFrame(rows, "tenant long, event_id long, micros long, points long").repartition(3)
    got = {(r["tenant"], r["event_id"]): (r["forecast"], r["width"]) for r in sequential.forecasts(df, window=10).collect()}
    for t in range(2):
        level, residuals = None, []
        for i in range(40):
            x = (i * 53 + t) % 97
            if level is not None:
                last = sorted(residuals[-10:])
                assert got[t, i][0] == pytest.approx(level)
                assert got[t, i][1] == (pytest.approx(last[min(len(last) - 1, max(0, int(0.9 * (len(last) + 1) - 1)))]) if last else None)
                residuals.append(abs(x - level))
            level = x if level is None else 0.4 * x + 0.6 * level


def test_behaviour_records_and_cadence(spark):
    rng = random.Random(11)
    rows = [(t, i, i, rng.choice((10, 11, 12, 500 if i > 20 else 12))) for t in range(2) for i in range(80)] + [(5, i, i, 700 if i < 30 else 300) for i in range(40)]
    df = spark.createDataFrame(rows, "tenant long, event_id long, micros long, points long").repartition(4)
    got = {(r["tenant"], r["event_id"]): (r["z"], r["anomaly"]) for r in records.behaviour_records(df).collect()}
    paced = {(r["tenant"], r["event_id"]): (r["scored"], r["in_force"]) for r in records.adaptive_cadence(df).collect()}
    for t in (0, 1, 5):
        series, kept = [p for k, _, _, p in rows if k == t], []
        for i, v in enumerate(series):
            mean = sum(kept) / len(kept) if kept else 0
            spread = sum((x - mean) ** 2 for x in kept) / len(kept) if kept else 0
            z = (v - mean) / math.sqrt(spread) if len(kept) >= 16 and spread > 1e-12 else 0.0
            assert got[t, i] == (pytest.approx(z), abs(z) > 3)
            if abs(z) <= 3:
                kept.append(v)
    assert any(a for _, a in got.values())
    # The cadence grows by one with each score: 2 after token 0, 3 after 2, 4 after 3, 5 after 4, 6 after 5, 7 after 6, 8 after 7.
    assert [i for i in range(30) if paced[5, i][0]] == [0, 2, 3, 4, 5, 6, 7, 8, 16, 24] and paced[5, 29][1] == 700
    assert paced[5, 32] == (True, 300) and paced[5, 39][1] == 300


def test_embed_and_learned_guard(spark, sf_dir):
    rows = [(1, "a b c", "a b c"), (2, "a b", ""), (3, "x y", "p q r s")]
    got = {r["pair_id"]: r["embed_score"] for r in records.embed_scores(spark.createDataFrame(rows, "pair_id int, premise string, hypothesis string")).collect()}
    assert got[1] == pytest.approx(1) and got[2] == 0.0 and 0 <= got[3] < 1
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    both = docs.join(labels, "doc_id").select(F.col("doc_id").alias("key"), "text", F.col("quality").alias("label"))
    held = F.crc32(F.col("key").cast("string")) % 5 == 0
    weights, bias = records.learned_guard(both.where(~held))
    scored = guards.hash_bag(both.where(held), records.SLOTS).select("label", records.guard_score(F.col("bag"), weights, bias).alias("s")).collect()
    bad, good = ([r["s"] for r in scored if r["label"] == v] for v in (0, 1))
    assert sum(a < b for a in bad for b in good) >= 0.7 * len(bad) * len(good) > 0


def test_running_values_in_spans(spark):
    rng = random.Random(12)
    rows = [(rng.choice("ab"), i, rng.randrange(0, 5000), rng.randrange(-9, 9)) for i in range(300)] + [(None, 999, 7, 1)]
    df = spark.createDataFrame(rows, "k string, id long, at long, v long").repartition(5)
    sums = {(r["k"], r["id"]): r["s"] for r in prefix.running_sums(df, "k", "id", {"s": F.col("v")}, 17).collect()}
    lags = {(r["k"], r["id"]): r["p"] for r in prefix.lagged(df, "k", "at", "id", "v", "p", 100).collect()}
    assert len(sums) == len(lags) == len(rows)
    for k in ("a", "b", None):
        own = [r for r in rows if r[0] == k]
        total = 0
        for r in own:
            total += r[3]
            assert sums[k, r[1]] == total
        before = None
        for r in sorted(own, key=lambda r: (r[2], r[1])):
            assert lags[k, r[1]] == before
            before = r[3]
    assert graphs.interactions(spark.createDataFrame([("t", 5, 1, 7), ("t", 10**10, 2, 8), ("t", 10**11, 3, 8)], "event_type string, micros long, event_id long, user_id long")).collect() == [(7, 8, 1)]


def test_merkle_proofs(spark):
    rows = [(g, i, f"{g}-{i}") for g in (1, 2, 3, 6, 7) for i in range(g)]
    df = spark.createDataFrame(rows, "g int, i int, leaf string")
    roots = {r["g"]: r["root"] for r in provenance.merkle_roots(df, "g", "i", "leaf").collect()}
    proofs = provenance.merkle_proofs(df, "g", "i", "leaf").withColumn("end", provenance.proven_root(F.col("leaf"), F.col("path"))).collect()
    assert len(proofs) == len(rows) and all(r["end"] == roots[r["g"]] for r in proofs)


def test_active_versions(spark):
    steps = [("promote", 1, None), ("publish", 1, None), ("promote", 1, 1), ("publish", 3, 1), ("publish", 2, 1), ("promote", 2, 1), ("promote", 3, 3), ("rollback", None, 1), ("rollback", None, 1), ("none", 9, 1), ("promote", 3, 3)]
    rows = [(t, i * 10, i, a, v) for t in (1, 2) for i, (a, v, _) in enumerate(steps)]
    got = further.active_versions(spark.createDataFrame(rows, "tenant long, micros long, event_id long, action string, version long").repartition(3)).orderBy("tenant", "event_id").collect()
    assert [r["active"] for r in got] == [want for _, _, want in steps] * 2


def test_pii_spans(spark):
    texts = [(1, "mail a.b@c.org or 555-123-4567; SSN 123-45-6789"), (2, "é 10.0.0.1 é MRN: 99"), (3, None), (4, "nothing")]
    got = {(r["k"], r["kind"], r["start"], r["end"]) for r in further.pii_spans(spark.createDataFrame(texts, "k int, t string"), "k", "t").collect()}
    want = {(k, kind, m.start(), m.end()) for k, t in texts if t for kind, p in safety.PII.items() for m in re.finditer(p, t)}
    assert got == want and {(1, "email", 5, 14), (1, "ssn", 36, 47)} <= got


def test_text_classes(spark):
    rng = random.Random(4)
    rows = [(i, "ab"[i % 2], rng.gauss(3.0 * (i % 2), 0.5), rng.gauss(-2.0 * (i % 2), 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, kind string, x double, y double")
    got = further.text_classes(df.where("k < 100"), df, ["x", "y"], "kind", "k", {"a": 0.7}, 0.6, gate=0.6).collect()
    assert sum(r["kind"] == "ab"[r["k"] % 2] for r in got) >= 195
    assert all(0.5 <= r["confidence"] <= 1 and r["threshold"] == (0.7 if r["kind"] == "a" and r["confidence"] >= 0.6 else 0.6) for r in got)


def test_echoes_against_all_pairs(spark):
    rng = random.Random(10)
    base = ["".join(rng.choices("abcd ", k=60)).strip() for _ in range(6)]
    rows = [(i, ("assistant", "user")[i % 3 == 0], base[rng.randrange(6)][: rng.randrange(15, 60)] + "".join(rng.choices("abxyz", k=rng.randrange(0, 12)))) for i in range(120)]
    got = {r["seq"]: (r["output"], r["likeness"]) for r in further.echoes(spark.createDataFrame(rows, "seq long, role string, text string"), within=40, least=0.5).collect()}
    grams = {i: {t.strip().lower()[k : k + 3] for k in range(len(t.strip()) - 2)} if len(t.strip(" ")) >= 20 else None for i, _, t in rows}
    want = {}
    for i, role, _ in rows:
        found = [(round(len(grams[i] & grams[j]) / len(grams[i] | grams[j]), 9), -j) for j, other, _ in rows if role == "user" and other == "assistant" and i - 40 <= j < i and grams[i] and grams[j]]
        if found and max(found)[0] >= 0.5:
            want[i] = (-max(found)[1], max(found)[0])
    assert got == want and len(want) > 5


def test_formulas_against_all_assignments(spark):
    rng = random.Random(5)
    rows = [(k, [[rng.choice((1, -1)) * rng.randrange(1, 6) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(0, 14))]) for k in range(200)] + [(900, [[]]), (901, None)]
    got = {r["formula"]: r for r in logic.formula_verdicts(spark.createDataFrame(rows, "formula int, clauses array<array<int>>")).collect()}
    for k, clauses in rows:
        true = lambda m, x: m[abs(x) - 1] == (x > 0)
        models = [m for m in itertools.product((True, False), repeat=5) if all(any(true(m, x) for x in c) for c in clauses or [])]
        assert got[k]["satisfiable"] == bool(models)
        if models:
            chosen = set(got[k]["model"])
            assert any(all(v + 1 in chosen for v in range(5) if m[v] and any(v + 1 in map(abs, c) for c in clauses or [])) for m in models)


def test_token_distance(spark):
    rng = random.Random(6)
    rows = [([rng.choice("abcdef") for _ in range(rng.randrange(0, 9))], [rng.choice("abcdef") for _ in range(rng.randrange(0, 9))]) for _ in range(80)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", logic.token_distance(F.col("a"), F.col("b")).alias("d")).collect()

    def distance(a, b):
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return table[-1][-1]

    assert all(r["d"] == distance(r["a"], r["b"]) for r in got)
    events = [("x", i, " ".join(a)) for i, (a, _) in enumerate(rows)] + [("y", 0, None), ("y", 1, "one"), ("y", 2, "ONE")]
    clusters = {(r["label"], r["leader"]): r["support"] for r in logic.leader_clusters(spark.createDataFrame(events, "label string, i int, prompt string")).collect()}
    leaders = []
    for _, _, p in events[:80]:
        t = p.split()
        if t:
            near = next((x for x in leaders if distance(t, x[0]) / max(len(t), len(x[0])) <= 0.35), None)
            if near:
                near[1] += 1
            else:
                leaders.append([t, 1])
    assert clusters == {("x", " ".join(t)): n for t, n in leaders if n >= 2} | {("y", "one"): 2}


def test_clusters_of_long_and_many_prompts(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(4000)]
    events = [("long", i, " ".join("x" if rng.random() < 0.05 * (i % 9) else w for w in base)) for i in range(60)]
    events += [("many", i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 15)))) for i in range(4000)] + [("many", 4000, events[-1][2])]
    begun = time.monotonic()
    found = logic.leader_clusters(spark.createDataFrame(events, "label string, i int, prompt string"))
    got = {(r["label"], r["leader"]): r["support"] for r in found.collect()}
    assert time.monotonic() - begun < 60  # the plain table of distances takes minutes
    near = sum(1 for i in range(60) if sum(a != b for a, b in zip(events[i][2].split(), base, strict=True)) <= 1400)
    assert got[("long", events[0][2])] == near
    assert {k[0] for k in got} <= {"long", "many"}


def test_labels_are_dealt_to_tasks(spark):
    events = spark.createDataFrame([(f"l{k % 40}", k, "a b c") for k in range(80)], "label string, i int, prompt string")
    placed = logic.leader_clusters(events).select(F.spark_partition_id().alias("p")).distinct().count()
    assert placed > 1


def test_causal_model(spark):
    model = logic.CausalModel({"c": (("a", "b"), lambda a, b: a + b), "b": (("a",), lambda a: a * 2)})
    rows = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, None)], "k int, a double")
    got = {r["k"]: r for r in model.counterfactuals(rows, {"as is": {}, "b zero": {"b": 0.0}, "a one": {"a": 1.0}}, F.col("c") < 4, "k").collect()}
    assert (got[1]["safe"], got[1]["unsafe_branches"]) == (3, [])
    assert (got[2]["safe"], got[2]["unsafe_branches"]) == (1, ["as is", "b zero"])
    assert got[3]["unsafe_branches"] == ["as is", "b zero"]
    with pytest.raises(ValueError):
        model.counterfactuals(rows, {}, F.lit(True), "k")
    with pytest.raises(Exception, match="cycle"):
        logic.CausalModel({"a": (("b",), lambda b: b), "b": (("a",), lambda a: a)})


def test_swarms(spark):
    ring = [("ring", f"n{i}", f"n{(i + 1) % 4}", 1) for i in range(4)]
    cliques = [("two", f"{g}{i}", f"{g}{j}", 3) for g in "ab" for i in range(3) for j in range(3) if i < j] + [("two", "a0", "b0", 1)]
    star = [("star", f"leaf{i}", "hub", 1) for i in range(9)]
    got = {r["swarm"]: r for r in logic.swarm_verdicts(spark.createDataFrame(ring + cliques + star, "swarm string, src string, dst string, weight int")).collect()}
    assert got["ring"]["cyclic"] and got["ring"]["attractor"] == pytest.approx(0, abs=1e-6)
    assert not got["two"]["cyclic"] and got["two"]["communities"] == 2 and got["two"]["imbalance"] == pytest.approx(0)
    assert got["star"]["attractor"] > got["ring"]["attractor"]
    with pytest.raises(Exception, match="more than 2 edges"):
        logic.swarm_verdicts(spark.createDataFrame(ring, "swarm string, src string, dst string, weight int"), 2).collect()


def test_a_swarm_of_over_a_million_edges(spark):
    # 1,100 hubs with an edge to each of 1,000 leaves: no cycle, and one community.
    edges = spark.range(1_100_000).select(F.lit(1).alias("swarm"), (F.col("id") % 1100).alias("src"), (F.floor(F.col("id") / 1100) + 2000).alias("dst"), F.lit(1).alias("weight"))
    got = logic.swarm_verdicts(edges).collect()
    assert [(r["nodes"], r["communities"], r["cyclic"]) for r in got] == [(2100, 1, False)]


def test_late_interaction_and_judges(spark):
    rng = random.Random(8)
    docs = [(i, [[rng.gauss(0, 1) for _ in range(3)] for _ in range(rng.randrange(0, 4))]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, vectors array<array<double>>")
    got = defaultdict(list)
    for r in search.late_interaction(df, df.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id"), 3, block=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["doc_id"])
    for q, qv in docs[::10]:
        if qv:
            score = {d: sum(max(sum(a * b for a, b in zip(x, y, strict=True)) for y in dv) for x in qv) for d, dv in docs if dv and d != q}
            assert got[q] == sorted(score, key=lambda d: (-round(score[d], 6), d))[:3]
    replies = [(0.5, '{"verdict": "YES", "confidence": 100}'), (0.5, "No way"), (0.95, "YES"), (0.5, None), (0.4, '{"verdict": "no", "confidence": "high"}'), (0.5, '["YES"]')]
    rows = [r["adjusted"] for r in search.judged(spark.createDataFrame(replies, "score double, reply string")).collect()]
    assert rows == pytest.approx([0.7 * 0.5 + 0.3 * 0.2, 0.85 * 0.5 + 0.15 * 0.8, 0.95, 0.5, 0.85 * 0.4 + 0.15 * 0.8, 0.85 * 0.5 + 0.15 * 0.2])


def test_scrubbed(spark, sf_dir):
    rows = [("a\x00b\tc\n",), ("ﬁne ① ​zero‮",), ("plain",), ("é\x07",), (None,), ("",)] + [(r["text"],) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(policies.scrubbed(F.col("t"))).collect()]
    clean = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t) if c in "\n\r\t" or unicodedata.category(c)[0] != "C")
    assert got == [None if t is None else clean(t) for (t,) in rows]


def test_adjusted_thresholds(spark):
    rows = [("a", i, alarm, mean, brier) for i, (alarm, mean, brier) in enumerate([(True, 0.9, False), (True, 0.9, False), (True, 0.1, False), (True, 0.1, False), (False, 0.5, True), (False, 0.5, True), (False, 0.5, False)])] + [("b", 0, True, 0.9, False)]
    got = [(r["tenant"], r["i"], round(r["warn"], 4), round(r["halt"], 4), r["moved"]) for r in calibration.adjusted_thresholds(spark.createDataFrame(rows, "tenant string, i int, alarm boolean, mean double, brier_alarm boolean"), 0.4, 0.6).orderBy("tenant", "i").collect()]
    assert got == [("a", 0, 0.4, 0.6, False), ("a", 1, 0.42, 0.62, True), ("a", 2, 0.42, 0.62, False), ("a", 3, 0.4, 0.6, True), ("a", 4, 0.4, 0.6, False), ("a", 5, 0.41, 0.59, True), ("a", 6, 0.41, 0.59, False), ("b", 0, 0.4, 0.6, False)]


def test_voice(spark):
    rows = [(1, i, 900 if i < 12 else 100, False) for i in range(20)] + [(2, i, 290, i % 7 == 6) for i in range(60)] + [(3, i, 900, True) for i in range(10)]
    got = {r["session"]: (r["spoken"], r["reason"]) for r in service.voice_sessions(spark.createDataFrame(rows, "session int, idx int, milli int, ends boolean").repartition(5)).collect()}
    # Session 2: eight scores by token 32; the first sentence end after it is token 35.
    assert got == {1: (15, "hard_limit"), 2: (35, "soft_halt_sentence_end"), 3: (10, None)}


def test_byte_bags(spark):
    blobs = [b"", b"abc" * 100, bytes(range(256)) * 3, b"x"]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in blobs], "b binary").select(service.byte_bag(F.col("b"))).collect()]

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    for blob, bag in zip(blobs, got, strict=True):
        want = [0.0] * 512
        for at in range(0, len(blob), 64):
            want[fnv(blob[at : at + 64]) % 512] += 1
        size = math.sqrt(sum(x * x for x in want))
        assert bag == pytest.approx([x / size if size else 0.0 for x in want])


def test_verified_bands_and_cycles(spark):
    df = spark.createDataFrame([(1, "The river is long and wide. It was cold then.", "The river is long and wide."), (2, "Alpha beta gamma delta.", "Zeta eta theta iota kappa.")], "pair_id int, premise string, hypothesis string")
    bands = {r["pair_id"]: r["band"] for r in service.verified_bands(df).collect()}
    assert bands[1] == "high" and set(bands.values()) <= {"high", "medium", "low"}
    edges = lambda e: spark.createDataFrame(e, "src int, dst int")
    assert service.has_cycle(edges([(1, 2), (2, 3), (3, 1), (9, 1)])) and not service.has_cycle(edges([(1, 2), (2, 3), (1, 3)]))
    assert service.has_cycle(edges([(4, 4)])) and not service.has_cycle(edges([]))


def test_formats(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith lines', None), (2, None, 2.5), (3, "ü | x", 0.0)]
    df = spark.createDataFrame(rows, "k int, t string, v double")
    formats.write_json_lines(df, f"file://{tmp_path}/j")
    assert sorted(map(tuple, formats.read_json_lines(spark, f"file://{tmp_path}/j", "k int, t string, v double").collect())) == rows
    formats.write_csv(df, f"file://{tmp_path}/c")
    assert sorted((r["k"], r["t"] or None, r["v"]) for r in formats.read_csv(spark, f"file://{tmp_path}/c", "k int, t string, v double").collect()) == rows
    files = [("a.csv", 'x, y ,,\n"p, q", "r"\n'), ("b.HTM", "<p>Hi <b>there</b></p>"), ("c.md", "# t"), ("none", None)]
    got = [r[0] for r in spark.createDataFrame(files, "n string, b string").select(formats.document_text(F.col("n"), F.col("b"))).collect()]
    lines = "\n".join(" | ".join(c.strip() for c in row if c.strip()) for row in csv.reader(io.StringIO(files[0][1])))
    assert got == [lines, "Hi there", "# t", None]


def test_scratch_tables(spark, monkeypatch):
    scratch = shared.Scratch(spark)
    a = scratch.bucketed(spark.range(100), "ids", "id")
    b = scratch.store(spark.range(10), "few")
    assert a.count() == 100 and b.count() == 10
    before = len(spark.catalog.listTables())
    scratch.drop("ids")
    assert len(spark.catalog.listTables()) == before - 1
    scratch.drop()
    assert not scratch.paths


def test_numeric_claims(spark):
    text = "Revenue grew 50% from $100 to $120. Born in 1980 and died in 1970. 120% probability. Total of 10 and total 20. Earth's population is 20 billion. In 2077, founded in 2050."
    (r,) = verification.numeric_claims(spark.createDataFrame([(text,)], "text string"), 2024).collect()
    assert [r[c] for c in ("bad_change", "bad_order", "bad_probability", "bad_total", "bad_magnitude", "far_future", "valid")] == [1, 2, 1, 1, 1, 2, False]
    fine = "It rose 20% from 100 to 120. Born in 1950, died in 2001; a 30% chance of a total of 5."
    assert verification.numeric_claims(spark.createDataFrame([(fine,)], "text string"), 2024).first()["valid"]


def test_spaced_words_helper(spark):
    (r,) = spark.createDataFrame([(" A  b\ta ",)], "t string").select(logic.spaced_tokens(F.col("t")), T.spaced_words(F.col("t"))).collect()
    assert r[0] == words(" A  b\ta ") and sorted(r[1]) == ["a", "b"]
