"""Sentences, claims and chunks of texts, and scores of long pairs chunk by chunk.

Null texts count as empty. Pairs that fit their budget are one chunk each; no text is cut short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import pairs

# Abbreviations after which a sentence goes on, and conjunctions that join two claims.
ABBREVIATIONS = r"(?i)((?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Inc|Ltd|Corp|vs|etc|e\.g|i\.e|U\.S|U\.K)\.) "
CONJUNCTIONS = r"(?i),?\s+(?:and|but|while|whereas|although|however|moreover|furthermore)\s+"
#: Words that a claim has at least.
LEAST_CLAIM = 4
MARK = "\u0001"


def trimmed(x: Column) -> Column:
    """Without white space at its ends."""
    return F.btrim(x, F.lit(" \t\n\r\f\u000b"))


def token_estimate(text: Column) -> Column:
    """Four characters a token, and one more."""
    return F.floor(F.char_length(text) / 4).cast("int") + 1


def nli_sentences(text: Column) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` and white space, but not after abbreviations.

    A point between digits stays with them, followed by a space.
    """
    held = F.regexp_replace(F.regexp_replace(trimmed(text), ABBREVIATIONS, f"$1{MARK}"), r"(\d)\.(\d)", f"$1.{MARK}$2")
    pieces = F.transform(F.split(held, r"(?<=[.!?])\s+"), lambda s: trimmed(F.translate(s, MARK, " ")))
    return F.filter(pieces, lambda s: s != "")


def point_sentences(text: Column) -> Column:
    """Pieces between points, each with one again; the whole text if there is none."""
    found = F.transform(F.filter(F.split(text, r"\."), lambda s: trimmed(s) != ""), lambda s: F.concat(trimmed(s), F.lit(".")))
    return F.when(F.size(found) > 0, found).when(trimmed(text) != "", F.array(trimmed(text))).otherwise(F.array().cast("array<string>"))


def atomic_claims(text: Column) -> Column:
    """Clauses of the sentences of at least three words, split at conjunctions.

    A clause of fewer than ``LEAST_CLAIM`` words joins the one before it; before the first it goes. Where no clause is long
    enough the sentences are the claims.
    """
    sentences = T.sentences(text)
    parts = F.transform(F.flatten(F.transform(sentences, lambda s: F.split(s, CONJUNCTIONS))), trimmed)
    joined = F.array_join(F.transform(parts, lambda p: F.when(F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= LEAST_CLAIM, F.concat(F.lit(MARK), p)).otherwise(F.concat(F.lit(" "), p))), "")
    claims = F.slice(F.split(joined, MARK), 2, 2**31 - 1)
    return F.when(F.size(claims) > 0, claims).otherwise(sentences)


def budget_chunks(sentences: Column, budget: int, sizes: Column | None = None) -> Column:
    """Sentences packed in order into chunks of at most ``budget`` estimated tokens; a chunk begins with the last sentence of the one before.

    A sentence over the budget is a chunk with the one before it. Both arrays are read once a step, so they should be columns,
    not expressions; ``sizes`` holds the sentences' estimates.
    """
    sizes = F.transform(sentences, token_estimate) if sizes is None else sizes
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(1).alias("a"), F.lit(0).alias("t"))

    def step(acc: Column, i: Column) -> Column:
        size = F.element_at(sizes, i)
        over = (i > 1) & (acc["t"] + size > budget)
        done = F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), (i - 1).alias("b"))))
        before = F.element_at(sizes, F.greatest(i - 1, F.lit(1)))
        return F.struct(F.when(over, done).otherwise(acc["done"]).alias("done"), F.when(over, i - 1).otherwise(acc["a"]).alias("a"), F.when(over, before + size).otherwise(acc["t"] + size).alias("t"))

    n = F.size(sentences)
    packed = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), n.alias("b")))))
    return F.transform(packed, lambda x: F.array_join(F.slice(sentences, x["a"], F.greatest(x["b"] - x["a"] + 1, F.lit(0))), " "))


def sliding_chunks(sentences: Column, budget: int, overlap: float, sizes: Column | None = None) -> Column:
    """Chunks of at most ``budget`` tokens, one sentence at least, each starting ``1 - overlap`` of the sentences of the one before further on."""
    sizes = F.transform(sentences, token_estimate) if sizes is None else sizes
    n = F.size(sentences)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    upto = F.transform(places, lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x))
    taken = F.transform(places, lambda i: F.greatest(F.lit(1), F.size(F.filter(F.slice(upto, i, n), lambda u: u - F.element_at(upto, i) + F.element_at(sizes, i) <= budget))))
    start = F.struct(F.array().cast("array<struct<a:int,k:int>>").alias("done"), F.lit(1).alias("next"))

    def step(acc: Column, i: Column) -> Column:
        k = F.element_at(taken, i)
        stride = F.greatest(F.lit(1), F.floor(k * (1.0 - overlap)).cast("int"))
        here = acc["next"] == i
        return F.struct(F.when(here, F.concat(acc["done"], F.array(F.struct(i.alias("a"), k.alias("k"))))).otherwise(acc["done"]).alias("done"), F.when(here, i + stride).otherwise(acc["next"]).alias("next"))

    return F.transform(F.aggregate(places, start, step, lambda acc: acc["done"]), lambda x: F.array_join(F.slice(sentences, x["a"], x["k"]), " "))


def chunked(df: DataFrame, key: str, premise: str = "premise", hypothesis: str = "hypothesis", inner: str = "max", outer: str = "max", premise_ratio: float = 0.4, overlap: float = 0.0, max_length: int = 512) -> DataFrame:
    """``key, divergence, n_premise, n_hypothesis``: heuristic divergence of each pair, chunk by chunk.

    The token budget ``max_length`` is shared by ``premise_ratio``. A side over its budget with several sentences is split.
    ``inner`` (max, min, mean) combines the premise's chunks for each chunk of the hypothesis, ``outer`` (max, mean,
    trimmed_mean: without the largest quarter, weighted_mean: by confidence, equal for this scorer) these.
    """
    prem_budget, hyp_budget = int(max_length * premise_ratio), int(max_length * (1 - premise_ratio))

    def pieces(side: str, budget: int) -> Column:
        many = (token_estimate(F.col(side)) > budget) & (F.size(f"{side}s") > 1)
        sentences, sizes = F.col(f"{side}s"), F.col(f"{side}t")
        packed = sliding_chunks(sentences, budget, overlap, sizes) if overlap > 0 else budget_chunks(sentences, budget, sizes)
        return F.when(many, packed).otherwise(F.array(F.col(side)))

    # Sentences and sizes are columns before the folds read them: an expression in a lambda runs again at every step.
    texts = df.select(F.col(key).alias("k"), F.coalesce(F.col(premise), F.lit("")).alias("p"), F.coalesce(F.col(hypothesis), F.lit("")).alias("h"))
    texts = texts.select("k", "p", "h", nli_sentences(F.col("p")).alias("ps"), nli_sentences(F.col("h")).alias("hs"))
    texts = texts.select("*", F.transform("ps", token_estimate).alias("pt"), F.transform("hs", token_estimate).alias("ht"))
    split = texts.select("k", pieces("p", prem_budget).alias("ps"), pieces("h", hyp_budget).alias("hs"))
    # No list is empty. The outer forms keep Spark from filtering on the lists' sizes below the folds, which would run them anew.
    rows = split.select("k", F.size("ps").alias("n_premise"), F.size("hs").alias("n_hypothesis"), "ps", F.posexplode_outer("hs").alias("i", "hypothesis")).select("k", "n_premise", "n_hypothesis", "i", "hypothesis", F.explode_outer("ps").alias("premise"))
    scored = pairs.heuristic_nli(rows).select("k", "n_premise", "n_hypothesis", "i", F.round("nli", 9).alias("d"))
    combine = {"max": F.max, "min": F.min, "mean": lambda c: F.sum(F.round(F.col(c) * 1e9).cast("bigint")) / 1e9 / F.count(F.lit(1))}
    by_chunk = scored.groupBy("k", "n_premise", "n_hypothesis", "i").agg(combine[inner]("d").alias("d"))
    if outer == "trimmed_mean":
        w = Window.partitionBy("k").orderBy("d", "i")
        by_chunk = by_chunk.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("n_hypothesis") * 0.75)))
    last = combine["max" if outer == "max" else "mean"]
    return by_chunk.groupBy("k", "n_premise", "n_hypothesis").agg(last("d").alias("divergence")).select(F.col("k").alias(key), "divergence", "n_premise", "n_hypothesis")


def both_ways(df: DataFrame, key: str, inner: str, outer: str, premise_ratio: float = 0.4) -> DataFrame:
    """``key, raw``: the smaller of the chunked divergence forwards and, best evidence and mean, backwards."""
    forward = chunked(df, key, inner=inner, outer=outer, premise_ratio=premise_ratio).select(key, F.col("divergence").alias("f"))
    back = chunked(df, key, premise="hypothesis", hypothesis="premise", inner="min", outer="mean", premise_ratio=premise_ratio).select(key, F.col("divergence").alias("b"))
    return forward.join(back, key).select(key, F.least("f", "b").alias("raw"))


def dialogue_divergence(df: DataFrame, key: str, baseline: float = 0.8) -> DataFrame:
    """``key, divergence``: both ways, above the divergence that sound dialogue has anyway."""
    return both_ways(df, key, "min", "mean").select(key, F.greatest(F.lit(0.0), (F.col("raw") - baseline) / (1 - baseline)).alias("divergence"))


def coverage(df: DataFrame, key: str, sentences: Column, least: float, inner: str = "min", outer: str = "mean", premise_ratio: float = 0.85) -> DataFrame:
    """``key, n_claims, coverage``: the share of sentences of ``hypothesis`` with a divergence below ``least``."""
    claims = df.select(F.col(key).alias("own"), "premise", F.posexplode(sentences).alias("i", "hypothesis")).withColumn("claim", F.struct("own", "i"))
    scored = chunked(claims, "claim", inner=inner, outer=outer, premise_ratio=premise_ratio)
    found = scored.groupBy(F.col("claim.own").alias(key)).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("divergence") < least).alias("s"))
    return found.select(key, "n_claims", (F.col("s") / F.col("n_claims")).alias("coverage"))


def summary_divergence(df: DataFrame, key: str, baseline: float = 0.2, least: float = 0.6, alpha: float = 0.4, source: int = 3000, by_points: bool = False) -> DataFrame:
    """``key, layer_a, coverage, divergence`` of summaries (``hypothesis``) of ``premise``.

    Layer A is the divergence both ways above the baseline; coverage is that of the claims by the first ``source``
    characters of the premise, weighing ``alpha``. ``by_points`` takes sentences between points, covered below 0.5, weighing 0.6.
    Without claims coverage is that of the whole summary, or 1 by points.
    """
    raw = both_ways(df, key, "max", "max").select(key, F.greatest(F.lit(0.0), (F.col("raw") - baseline) / (1 - baseline)).alias("layer_a"))
    short = df.withColumn("premise", F.substring("premise", 1, source))
    if by_points:
        found = coverage(short, key, F.transform(F.filter(F.split("hypothesis", r"\."), lambda s: trimmed(s) != ""), lambda s: F.concat(trimmed(s), F.lit("."))), 0.5, outer="max", inner="max")
        alpha = 0.6
    else:
        sentences = nli_sentences(F.col("hypothesis"))
        found = coverage(short, key, F.when(F.size(sentences) > 0, sentences).otherwise(F.array("hypothesis")), least)
    out = raw.join(found, key, "left").withColumn("coverage", F.coalesce("coverage", F.lit(1.0)))
    return out.select(key, "layer_a", "coverage", (alpha * (1 - F.col("coverage")) + (1 - alpha) * F.col("layer_a")).alias("divergence"))


def grounded_divergence(df: DataFrame, key: str, least: float = 0.6, alpha: float = 0.4, longer: int = 100) -> DataFrame:
    """``key, score``: chunked divergence from the retrieved ``premise``, blended with claim coverage.

    Only answers over ``longer`` characters with two claims or more are blended.
    """
    whole = chunked(df, key).select(key, F.col("divergence").alias("score"))
    long = df.where(F.char_length("hypothesis") > longer)
    found = coverage(long, key, nli_sentences(F.col("hypothesis")), least, outer="max", premise_ratio=0.4).where("n_claims > 1")
    out = whole.join(found, key, "left")
    return out.select(key, F.coalesce(alpha * (1 - F.col("coverage")) + (1 - alpha) * F.col("score"), F.col("score")).alias("score"))


def rescaled(score: Column, w_logic: float = 0.6, w_fact: float = 0.4, neutral: float = 0.5) -> Column:
    """A coherence without retrieved facts, from the band that the neutral fact term leaves to [0, 1]."""
    low = 1 - w_logic - w_fact * neutral
    return T.clamp((score - low) / w_logic)


def recursive_chunks(df: DataFrame, key: str, column: str = "text", size: int = 512, overlap: int = 64, separators: tuple[str, ...] = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")) -> DataFrame:
    """``key, i, chunk``: texts split at the first separator they hold, packed up to ``size`` characters, and again below.

    Pieces without a separator are cut every ``size - overlap`` characters. Each level carries the last ``overlap`` characters
    of a chunk into the next. Null and empty texts have no chunk. A fold of folds: one Arrow pass, text by text.
    """
    import pyarrow as pa

    step = max(1, size - overlap)

    def packed(parts: list[str], joint: str, rest: tuple[str, ...]) -> list[str]:
        out, open_parts, length = [], [], 0
        for part in parts:
            grown = length + len(joint) + len(part) if length else len(part)
            if grown <= size:
                # An empty start leaves nothing to join to.
                open_parts, length = ([*open_parts, part] if length else [part]), grown
                continue
            if length:
                out.append(joint.join(open_parts))
            if len(part) > size:
                out += cut(part, rest)
                open_parts, length = [], 0
            else:
                open_parts, length = [part], len(part)
        if length:
            out.append(joint.join(open_parts))
        if overlap <= 0:
            return out
        return out[:1] + [a[-overlap:] + b for a, b in zip(out, out[1:], strict=False)]

    def cut(text: str, left: tuple[str, ...]) -> list[str]:
        if len(text) <= size:
            return [text]
        joint = next((s for s in left if s and s in text), "")
        if not joint:
            return [text[at : at + size] for at in range(0, len(text), step)]
        return packed(text.split(joint), joint, tuple(s for s in left if s != joint))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys, place, chunks = [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    found = cut(text, separators) if text else []
                    keys += [row] * len(found)
                    place += range(len(found))
                    chunks += found
                yield pa.record_batch([part.column(0).take(pa.array(keys, pa.int64())), pa.array(place, pa.int32()), pa.array(chunks, pa.string())], [key, "i", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"{key} {kind}, i int, chunk string")


def topic_chunks(sentences: DataFrame, size: int = 512, least: float = 0.3) -> DataFrame:
    """``doc_id, chunk, n_sentences, n_chars``: neighbouring sentences (``doc_id, i, sentence, vector``) by topic.

    A topic ends where the cosine of two neighbours falls below ``least``; topics are packed in order into chunks of at
    most ``size`` characters, one topic at least. Vectors come with the rows, from any encoder.
    """
    w = Window.partitionBy("doc_id").orderBy("i")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(F.col("vector"), F.col("vector")))
    s = sentences.withColumns({"before": F.lag("vector").over(w), "n": F.greatest(norm, F.lit(1e-10))}).withColumn("n_before", F.lag("n").over(w))
    fresh = F.when(F.col("before").isNull() | (F.round(dot(F.col("vector"), F.col("before")) / F.col("n") / F.col("n_before"), 9) < least), 1).otherwise(0)
    s = s.withColumn("topic", F.sum(fresh).over(w))
    topics = s.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.char_length("sentence")) + F.count(F.lit(1)) - 1).alias("chars"))
    listed = topics.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("topic", "n", "chars"))).alias("t"))
    start = F.array().cast("array<struct<n:bigint,chars:bigint>>")

    def grow(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (last["chars"] + 1 + x["chars"] <= size)
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["n"] + x["n"]).alias("n"), (last["chars"] + 1 + x["chars"]).alias("chars"))))
        return F.when(fits, wider).otherwise(F.concat(acc, F.array(F.struct(x["n"].alias("n"), x["chars"].alias("chars")))))

    chunks = listed.select("doc_id", F.posexplode(F.aggregate("t", start, grow)).alias("chunk", "c"))
    return chunks.select("doc_id", "chunk", F.col("c.n").alias("n_sentences"), F.col("c.chars").alias("n_chars"))
