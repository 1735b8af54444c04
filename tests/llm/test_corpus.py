"""The corpus operators against brute force, and in edge cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact, language, lines, media, mixing, quality, simhash, substrings, tokens
from tidemark.llm.queries import QUERIES, SQL
from tidemark.llm.texts import LOWER

LONG = " ".join(f"wort{i % 700}é" for i in range(20_000))
#: Null and repeated ids, null, empty and blank texts, a very long one, ties, white-space variants; extra columns that clash.
EDGE = [(1, "a b\tc d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG), (None, "null id"), (8, "ÄÖ é\nÄÖ é"), (9, "日本語 テキスト"), (10, "A\na\n A \n\nb")]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("TEXT"), F.lit(2).alias("row"), F.lit(3).alias("size"), F.lit(4).alias("a.b"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    return (text or "").encode().translate(LOWER).split()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM read_parquet('{sf_dir}/documents.parquet')")
    want = db.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, sf_dir).select(*names).collect())) == sorted(want.fetchall())


def test_exact_edges(edge, nothing):
    got = exact.exact_dedup(edge, trie_bytes=200).collect()
    assert len(got) == len(EDGE) and exact.exact_dedup(nothing).count() == 0
    groups = defaultdict(list)
    for doc_id, text in EDGE:
        groups["".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")].append((doc_id, len(text or "")))
    sizes = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        own = sizes[r["text_sha256"]]
        assert r["group_size"] == len(own)
        assert r["keep_id"] == min(own, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
    assert sum(r["kept"] for r in got) == len(groups)


def test_trie_holds_prefixes_and_spills():
    trie, rng = exact.PatriciaTrie(), random.Random(1)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(300)]
    for t in texts:
        node, known = trie.terminal(t)
        node.payload = [(node.payload or [0])[0] + 1]
    found = list(trie.cut_largest()) + list(trie.drain())
    assert {t: p[0] for t, p in found} == Counter(texts)


def test_simhash_against_brute_force(docs, edge, nothing):
    def check(frame):
        rows = [(r[0], r[1]) for r in frame.collect()]
        prints = []
        for _, text in rows:
            w = words(text)
            runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
            h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
            prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
        parent = list(range(len(rows)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    parent[root(i)] = root(j)
        least = defaultdict(list)
        for i, (doc_id, _) in enumerate(rows):
            if doc_id is not None:
                least[root(i)].append(doc_id)
        want = sorted((str(d), f"{p:016x}", str(min(least[root(i)], default=None))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))
        got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.simhash_components(frame).collect())
        assert got == want

    check(docs)
    check(edge)
    assert simhash.simhash_components(nothing).count() == 0


def test_simhash_posting_lists_of_any_size():
    rng = np.random.default_rng(3)
    keys, prints, want = [], [], []
    for k, (anchor, n, spread) in enumerate([(a, n, s) for a in range(6) for n, s in ((1, 9), (2, 2), (6, 2), (300, 40), (900, 64))]):
        free = [p for p in range(4) if p not in simhash.ANCHORS[anchor]]
        fps = np.unique(sum((rng.integers(0, spread, n).astype(np.uint64) << np.uint64(16 * g) for g in free), np.zeros(n, np.uint64)))
        keys.append(np.full(len(fps), (anchor << 32) + k))
        prints.append(fps)
        want.append(fps)
    order = np.argsort(np.concatenate(keys), kind="stable")
    forest = simhash.linked(np.concatenate(keys)[order], np.concatenate(prints)[order])
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in forest.tolist():
        assert (a ^ b).bit_count() <= 2
        parent[root(a)] = root(b)
    for fps in want:
        for i, x in enumerate(fps):
            for y in fps[:i][np.bitwise_count(fps[:i] ^ x) <= 2]:
                assert root(int(x)) == root(int(y))


def test_mix(docs, edge, nothing):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    total, by = sum(r["size"] for r in rows), defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] <= 2 * r["size"] and again[r["doc_id"]] == r["taken"]
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        largest = max(r["size"] for r in v)
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(largest / 2, 1)
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE) and all(r["target"] == 1.5 * r["source_size"] for r in got)
    assert mixing.mix(nothing).count() == 0


def test_targets_reshare():
    assert mixing.source_targets([10, 1000, 1000], [5, 2, 1], 1.5, 2.0) == pytest.approx([20, 2995 * 2 / 3, 2995 / 3])
    assert mixing.source_targets([0, 0], [5, 2], 1.5, 2.0) == [0, 0]


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size, prob = rng.integers(1, 500, 400), np.full(400, 0.3)
    out = mixing.flight(size, prob, rng.random(400))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= mixing.RESERVE + 2
    assert out.sum() == pytest.approx(120) and (out * size).sum() == pytest.approx(0.3 * size.sum())


def test_bpe_agrees_with_tiktoken(docs, edge, nothing):
    path = public_tokenizers.path(bpe.RANKS_FILE)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.load(path), random.Random(2)
    texts = ["", "a" * 5000, "ab" * 700, "<|endoftext|>", "it's 'LL  \n\n x", LONG, "".join(chr(rng.randrange(1, 0xD000)) for _ in range(2000))]
    texts += ["".join(rng.choices("abcdeth", k=rng.randrange(400))) for _ in range(60)]
    for t in texts:
        assert coder.encode(t) == reference.encode_ordinary(t) and coder.decode(coder.encode(t)) == t.encode()
    for frame in (docs, edge):
        want = Counter((len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for i in (reference.encode_ordinary(r[1] or "") for r in frame.collect()))
        assert Counter((r["n_tokens"], r["ids_sha256"]) for r in bpe.bpe_digest(frame).collect()) == want
    back = bpe.bpe_decode(bpe.bpe_encode(docs)).join(docs, "doc_id").collect()
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in back)
    assert bpe.bpe_digest(nothing).count() == 0


def test_token_counts(docs, edge, nothing):
    path = public_tokenizers.path(tokens.MODEL_FILE)
    model, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    counter = tokens.load(path)
    for _ in range(200):
        t = rng.choice(["".join(rng.choices(" ab\n\t▁é日x ☃", k=rng.randrange(400))), "a" * rng.randrange(700), " " * rng.randrange(500), "the quick" * rng.randrange(80)])
        assert counter.count(t, rng.choice([16, 40, 100]), rng.choice([1, 4, 16])) == len(model.encode(t))
    for frame in (docs, edge):
        want = Counter((len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in frame.collect())
        assert Counter((r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(frame, chunk=3000).collect()) == want
    assert tokens.token_counts(nothing).count() == 0


def test_media_round_trip(docs, edge, nothing):
    for frame in (docs, edge):
        want = []
        for r in frame.collect():
            raw = (r[1] or "").encode()
            payload = raw + b"\xff" * (max(1, math.ceil(len(raw) / 576)) * 576 - len(raw))
            want.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
        got = media.media_columns(frame).collect()
        assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert media.media_columns(nothing).count() == 0


def test_media_of_every_byte_and_many_images(monkeypatch):
    monkeypatch.setattr(media, "ROWS_MOST", 2)
    rng = np.random.default_rng(4)
    payloads = [bytes(rng.integers(0, 256, 576 * k, dtype=np.uint8)) for k in (1, 2, 5)] + [b"\xff" * 576, b"\0\xff" * 288]
    stored = media.to_jpegs(payloads)
    assert [d[0] for d in media.describe(stored)] == payloads and len(media.describe(stored)[2][1]) == 3


def test_general_baseline_jpeg():
    """Two components, sampling 2x1 and 1x1, AC coefficients, 16-bit quantiser, one segment: written bit by bit here."""
    dc = media.canonical((0, 3, 1) + (0,) * 13, (0, 1, 2, 3))
    ac = media.canonical((0, 2, 1) + (0,) * 13, (0, 0x01, 0x12))
    bits, rng, pred, luma = "", random.Random(5), [0, 0], []
    for _ in range(2 * 3):  # MCUs of two luminance blocks and one of colour
        for c in (0, 0, 1):
            d = rng.randrange(-7, 8)
            size = abs(d).bit_length()
            pred[c] += d
            if c == 0:
                luma.append(pred[0])
            code, n = dc[size]
            bits += f"{code:0{n}b}" + (f"{d if d >= 0 else d + (1 << size) - 1:0{size}b}" if size else "")
            for symbol in rng.choices((0x01, 0x12), k=rng.randrange(4)):
                code, n = ac[symbol]
                bits += f"{code:0{n}b}" + "".join(rng.choices("01", k=symbol & 15))
            code, n = ac[0]
            bits += f"{code:0{n}b}"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")

    def part(marker, body):
        return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    data = b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, b"\x10" + (16).to_bytes(2, "big") * 64) + part(0xC0, bytes([8, 0, 24, 0, 32, 2, 7, 0x21, 0, 9, 0x11, 0]))
    data += part(0xC4, bytes([0, 0, 3, 1] + [0] * 13 + [0, 1, 2, 3])) + part(0xC4, bytes([16, 0, 2, 1] + [0] * 13 + [0, 1, 0x12])) + part(0xDA, bytes([2, 7, 0, 9, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (frame,) = media.parse_frames(data)
    (image,) = media.thumbnails([frame])
    assert image.shape == (3, 4) and image.ravel().tolist() == [128 + 2 * x for x in luma]


def test_lines_edges(spark, edge, nothing):
    many = spark.createDataFrame([(i, f"Common\n own {i}\n\n  cOMMON ") for i in range(12)] + [(20, "common")], SCHEMA)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.line_dedup(many).collect()}
    assert got[3] == (4, 2, " own 3\n") and got[20] == (1, 1, "")
    rows = lines.line_dedup(edge, min_docs=2).collect()
    assert len(rows) == len(EDGE) and lines.line_dedup(nothing).count() == 0
    assert {(r["n_lines"], r["n_dropped"]) for r in rows if r["doc_id"] in (3, 4)} == {(1, 0)}
    assert [(r["n_lines"], r["n_dropped"]) for r in rows if r["doc_id"] == 10] == [(5, 0)]
    plan = lines.line_dedup(many)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_passages(spark, nothing, edge):
    rng = random.Random(7)
    prose = lambda n: [rng.choice("kslmtrv") + "".join(rng.choices("aeiounrst", k=6)) for _ in range(n)]
    shared, near = prose(60), prose(120)
    changed = near[:60] + ["other"] + near[61:]
    rows = [(1, prose(200) + shared + prose(90)), (2, prose(30) + [w.upper() for w in shared] + prose(300)), (3, prose(400)), (4, near + prose(100)), (5, prose(80) + changed), (6, prose(49)), (7, shared[:49] + prose(200))]
    rows += [(8, rows[0][1])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(None, " ".join(shared)), (9, None), (10, "")], SCHEMA)
    rows = substrings.repeated_passages(df).collect()
    assert len(rows) == df.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert {k for k, r in got.items() if r["spans"]} == {k for k, r in got.items() if r["repeated"]} == {1, 2, 4, 5, 8}
    assert got[2]["class_id"] == got[8]["class_id"] == 1 and got[5]["class_id"] == 4
    assert all(r["class_id"] == k and r["n_repeated"] == 0 for k, r in got.items() if not r["spans"])
    (span,) = got[2]["spans"]
    assert span["start"] <= 30 and span["end"] >= 90 and got[2]["n_repeated"] <= 70
    (span,) = got[5]["spans"]
    assert span["start"] <= 80 and span["end"] >= 200
    (nobody,) = [r for r in rows if r["doc_id"] is None]  # a row without an id shares a passage like any other
    assert nobody["class_id"] == 1 and nobody["spans"]
    assert substrings.repeated_passages(nothing).count() == 0
    marked = substrings.repeated_passages(edge).collect()
    assert len(marked) == len(EDGE) and {r["doc_id"] for r in marked if r["spans"]} == {6, 7}


def exact_runs(rows, least=50):
    """For each row the words that lie in runs of ``least`` equal words found in a row of another text, and those pairs of rows."""
    split = [words(t) for _, t in rows]
    places = defaultdict(list)
    for k, w in enumerate(split):
        for i in range(len(w) - least + 1):
            places[tuple(w[i : i + least])].append((k, i))
    held, pairs = defaultdict(set), set()
    for found in places.values():
        owners = sorted({k for k, _ in found})
        if len({rows[k][1] for k in owners}) > 1:
            pairs |= set(zip(owners, owners[1:], strict=False))
            for k, i in found:
                held[k] |= set(range(i, i + least))
    return held, pairs


def test_passages_against_all_runs_of_50_words(spark, docs):
    """No run of 50 equal words and no link by one is lost: test table, frequent lines, quotes that overlap in part."""
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    hot, line, source = text(58), text(20), text(400)
    made = [(10**6 + k, " ".join(text(rng.randrange(5, 70)) + hot + text(rng.randrange(5, 70)))) for k in range(120)]
    made += [(2 * 10**6 + k, " ".join(text(40) + line + text(30) + line + text(40))) for k in range(120)]
    made += [(3 * 10**6 + k, " ".join(text(30) + source[at : at + rng.randrange(50, 90)] + text(30))) for k, at in enumerate(range(0, 320, 7))]
    made += [(4 * 10**6 + k, " ".join(line * rng.randrange(3, 40))) for k in range(10)]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + made
    got = substrings.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) == len(by)
    held, pairs = exact_runs(rows)
    for k, wanted in held.items():
        assert wanted <= {i for s in by[rows[k][0]]["spans"] for i in range(s["start"], s["end"])}
    for a, b in pairs:
        assert by[rows[a][0]]["class_id"] == by[rows[b][0]]["class_id"]
    alone = {d for d, _ in made[120:240]}
    assert not any(by[d]["spans"] for d in alone)  # a frequent line of 20 words makes no passage


def test_near_passages_in_frequent_company(spark):
    """Pairs of passages of similarity 0.8 to 0.9 within texts that all share a frequent line: nine in ten are found."""
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line, rows, pairs = text(12), [], []
    for k in range(200):
        n = rng.randrange(50, 120)
        one = text(n)
        one[20:32] = line  # inside the passage itself
        other = list(one)
        for at in rng.sample(range(4, n - 4), max(1, n // 60)):
            other[at] = f"x{at}"
        sets = [{tuple(w[i : i + 5]) for i in range(n - 4)} for w in (one, other)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(text(40) + one + text(30))), (2 * k + 1, " ".join(text(25) + other + text(50)))]
    by = {r["doc_id"]: r for r in substrings.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = [by[a]["class_id"] == by[b]["class_id"] and by[a]["n_repeated"] >= 45 for a, b in pairs]
    assert len(pairs) > 100 and sum(found) >= 0.9 * len(pairs)


def test_stretches_of_changed_words_against_brute_force():
    """One word changed, put in or left out at every position: a passage of similarity 0.8 is found whole.

    A passage begins and ends with equal words, so 49 equal words and a changed one are none.
    """
    rng = np.random.default_rng(5)
    sets = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for n in range(50, 121, 5):
        around = rng.integers(0, 1 << 62, (4, 30)).astype(np.uint64)
        one = rng.integers(0, 1 << 62, n).astype(np.uint64)
        for at in range(n):
            word = np.array([at + 7], np.uint64)
            for other in (np.concatenate([one[:at], word, one[at + 1 :]]), np.concatenate([one[:at], word, one[at:]]), np.concatenate([one[:at], one[at + 1 :]])):
                x, y = sets(one.tolist()), sets(other.tolist())
                if len(other) < 50 or len(x & y) < 0.8 * len(x | y) or len(other) == n == 50 and at in (0, 49):
                    continue
                got = substrings.near_stretches(np.concatenate([around[0], one, around[1]]), np.concatenate([around[2], other, around[3]]), 50, 0.8)
                held = {k for a0, a1, _, _ in got for k in range(a0, a1)}
                equal = {30 + k + d for k in range(n - 4) if tuple(one[k : k + 5].tolist()) in y for d in range(5)}
                assert equal <= held, (n, at, len(other), got)
                assert all(a1 - a0 >= 50 for a0, a1, _, _ in got)


def test_compact_windows_against_definition():
    rng = np.random.default_rng(2)
    for n, width in ((5, 6), (40, 7), (200, 26), (90, 46)):
        values = rng.integers(0, 1 << 63, n).astype(np.uint64)
        left, centre, right = substrings.compact_windows(values, width)
        want = []
        for c in range(n):
            lo, hi = c, c
            while lo > 0 and values[lo - 1] > values[c]:
                lo -= 1
            while hi < n - 1 and values[hi + 1] > values[c]:
                hi += 1
            if hi - lo + 1 >= width:
                want.append((lo, c, hi))
        assert list(zip(left.tolist(), centre.tolist(), right.tolist(), strict=True)) == want


def test_language(spark, docs, edge, nothing):
    model = language.train(docs, where=language.learnable())
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)
    got = language.identify(edge, model).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (3, 4, 5)} == {("und", 0.0)}
    assert language.identify(nothing, model).count() == 0
    empty = language.train(nothing)
    assert {r["lang_pred"] for r in language.identify(edge, empty).collect()} == {"und"}


def test_language_margins_and_decoding_by_hand(docs):
    """Margins gram by gram, and the codeword of least logistic loss by loops."""
    model = language.train(docs, where=language.learnable())
    for r in docs.limit(8).collect():
        data = (r["text"] or "").encode().translate(LOWER)
        if not data:
            continue
        filed = language.slots(np.frombuffer(data + b"   ", np.uint8), language.DIMS)[:, : len(data)]
        total = sum(model.weights[filed[k][i]].astype(float) for k in range(4) for i in range(len(data)))
        z = total / len(data) * model.scale + model.bias
        loss = [sum(math.log1p(math.exp(-float(m) * int(c))) for m, c in zip(z, code, strict=True)) for code in model.code]
        lang, score, _ = model.predict(pa.array([r["text"]]))
        assert lang[0] == model.langs[int(np.argmin(loss))]
        assert score[0] == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss), abs=1e-3)


def test_every_language_is_learned(spark):
    rows = [(k, f"{'abcdefghijklmnopqrstuvwxyz'[k % 26] * 3}{'qz'[k % 52 // 26]} " * 20, f"l{k % 52:02d}") for k in range(520)]
    df = spark.createDataFrame(rows, SCHEMA + ", lang string")
    model = language.train(df)
    assert len(model.langs) == 52
    got = language.identify(df, model).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % 52:02d}" for r in got) >= 0.95 * len(rows)


def test_language_of_many_codes():
    code = language.codewords(12, np.random.default_rng(0))
    assert len({tuple(c) for c in code.tolist()}) == 12 and language.codewords(4, np.random.default_rng(0)).shape == (4, 7)


def naive_quality(net, data):
    """The network by loops: every filter at every second place of every chunk, positions past the end silent."""
    step, pools = quality.CHUNK - quality.OVERLAP, []
    starts = [0]
    while starts[-1] + quality.CHUNK < len(data):
        starts.append(starts[-1] + step)
    for start in starts:
        chunk = data[start : start + quality.CHUNK]
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.STRIDE * quality.POSITIONS, quality.STRIDE):
            codes = [chunk[at + j] if at + j < len(chunk) else quality.PAD for j in range(quality.WIDTH)]
            best = np.maximum(best, sum(net.table[j][c] for j, c in enumerate(codes)))
        pools.append(np.maximum(best + net.bias, 0))
    z = np.mean(pools, axis=0) @ net.mean_w + np.max(pools, axis=0) @ net.max_w + net.out_bias
    return 1 / (1 + math.exp(-z))


def test_quality_of_rows_that_were_not_learned_from(spark):
    """Area under the curve over the held-out rows of the middle data set; the smallest has twenty of them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    net = quality.train(docs, labels, where=~quality.held_out())
    rows = quality.score(docs, net).join(labels, "doc_id").where(quality.held_out()).collect()
    bad, good = ([r["score"] for r in rows if r["quality"] == v] for v in (0, 1))
    assert len(rows) > 60 and np.mean([a < b for a in bad for b in good]) >= 0.9


def test_quality(spark, docs, edge, nothing, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality.train(docs, labels, where=~quality.held_out())
    rows = quality.score(docs, net).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in rows]) >= 0.85
    by = {r["doc_id"]: r["score"] for r in quality.score(docs, net).collect()}
    for r in sorted(docs.collect(), key=lambda r: len(r["text"] or ""))[::25]:
        assert by[r["doc_id"]] == pytest.approx(naive_quality(net, (r["text"] or "").encode()), abs=1e-4)
    got = quality.score(edge, net).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert quality.score(nothing, net).count() == 0
    blank = quality.train(nothing, labels)
    assert all(0 <= r["score"] <= 1 for r in quality.score(edge, blank).collect())


def test_quality_chunks_cover_everything():
    offsets = np.array([0, 0, 100, 512, 2000, 10_000])
    doc, start, end = quality.chunk_spans(offsets)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        own = [(s, e) for d, s, e in zip(doc, start, end, strict=True) if d == i]
        assert own and own[0][0] == a and own[-1][1] == b and all(p[1] >= q[0] for p, q in zip(own, own[1:], strict=False))


def test_passages_in_the_middle_of_a_group(spark):
    # All texts share 40 words, too few for a passage; two each go on alike, so that their pair is one in a large group.
    rng = random.Random(5)

    def own(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    stem, texts = [f"s{k}" for k in range(40)], []
    for _ in range(24):
        end = own(12)
        texts += [" ".join(own(60) + stem + own(1) + end + own(60)) for _ in range(2)]
    found = {r["doc_id"]: r["class_id"] for r in substrings.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert found == {i: i - i % 2 for i in range(48)}


def test_windows_that_share_a_line_only_are_no_candidates():
    # 200 rows share 16 words, two in ten of them a passage with one changed word: only such pairs remain, and all of them.
    rng = np.random.default_rng(6)
    line, rows = rng.integers(0, 1 << 32, 16), []
    for k in range(200):
        parts = [rng.integers(0, 1 << 32, 60), line, rng.integers(0, 1 << 32, 60)]
        if k % 10 == 1:
            passage = rows[k - 1][40:120].copy()
            passage[66] = k
            parts = [rng.integers(0, 1 << 32, 30), passage, rng.integers(0, 1 << 32, 30)]
        elif k % 10 == 2:
            parts[0] = np.tile(line[:9], 6)  # repeated words need few distinct shingles
        rows.append(np.concatenate(parts).astype(np.uint64))
    size, group = np.array([len(r) for r in rows]), np.zeros(200, np.int64)
    for one in (np.ones(200, bool), np.arange(200) % 10 != 1):
        two = one if one.all() else ~one
        i, j = substrings.sharing(np.concatenate(rows), size, group, one, two, lambda i, j: (i > j) | ~one[j], 46, 0.8)
        want = {(x, y) for x in np.flatnonzero(one).tolist() for y in np.flatnonzero(two).tolist() if (x > y or not one[y]) and substrings.near_stretches(rows[x], rows[y], 50, 0.8)}
        got = set(zip(i.tolist(), j.tolist(), strict=True))
        assert len(want) >= 20 and want <= got and len(got) <= 2 * len(want), (len(want), len(got))
