"""Language identification with error-correcting output codes.

Each language has a codeword. For each code bit a linear classifier over hashed byte n-grams (one to four bytes) tells the
languages whose bit is 1 from the others. A text's n-gram weights give one margin per bit; decoding sums the logistic
loss of every language's bits against the margins and takes the nearest codeword. The score is the softmax of the
negative losses; a text is flagged ambiguous when the two nearest codewords are about as near.

Training is a sum: executors add up the n-gram frequencies of a bounded sample of rows for each language, and the driver
gets one vector a language, whatever the number of rows. A bit's weights are the logarithms of how much more frequent an
n-gram is on one side of the bit than on the other, languages weighing alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import id_type, map_batches, packed, remainder
from tidemark.sources.tables import pick

DIMS = 1 << 14
#: Labelled rows that a language contributes to training, about.
ROWS_PER_LANG = 500
UNKNOWN = "und"
#: How much of an even spread of n-grams each language's frequencies are mixed with.
SMOOTHING = 0.05
#: The margin that a language's own mean has for its bits, on average.
TYPICAL = 2.0
#: Bytes that are hashed at once.
BLOCK_BYTES = 1 << 20
#: Languages that are sent to all tasks at most, some dozen bytes each.
MOST_BROADCAST = 1_000_000
#: Languages whose sums a task holds at once, 128 KB each.
HELD_LANGS = 256
#: Spaces between texts: one fewer than the longest n-gram.
GAP = 3


def codewords(n: int, rng: np.random.Generator) -> np.ndarray:
    """An (n, bits) matrix of -1 and 1: exhaustive codes for few classes, the best-spread of random codes for many."""
    if n <= 2:
        return np.array([[1], [-1]][:n], np.int8)
    if n <= 5:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, np.int8).T
    bits = int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(50)]
    apart = [min((a != b).sum() for i, a in enumerate(c) for b in c[:i]) for c in tries]
    return tries[int(np.argmax(apart))]


def slots(block: np.ndarray, dims: int) -> np.ndarray:
    """Hashed n-gram slots of a block of bytes, one row for each length 1 to 4; an n-gram is filed under its first byte."""
    padded = np.concatenate([block, np.full(3, 32, np.uint8)]).astype(np.uint32)
    n, out, value = len(block), [], np.zeros(len(block), np.uint32)
    for k in range(4):
        value = value * np.uint32(257) + padded[k : k + n] + np.uint32(1)
        h = (value ^ value >> np.uint32(15)) * np.uint32(2654435761 + 2 * k)
        out.append(h >> np.uint32(32 - int(dims).bit_length() + 1))
    return np.stack(out)


def lowered(flat: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their codewords, and one weight column per code bit."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: float

    def margins(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, bits): mean n-gram weight of each whole text, by bit. Texts are set apart, so neighbours don't matter."""
        n, bits = len(offsets) - 1, self.weights.shape[1]
        starts = offsets[:-1] + GAP * np.arange(n)
        ends = starts + np.diff(offsets)
        apart = np.full(int(offsets[-1]) + GAP * n, 32, np.uint8)
        for i in range(n):
            apart[starts[i] : ends[i]] = flat[offsets[i] : offsets[i + 1]]
        apart = lowered(apart)
        total = np.zeros((n, bits))
        step = max(1 << 12, (BLOCK_BYTES << 3) // bits)
        for at in range(0, len(apart), step):
            own = min(step, len(apart) - at)
            s = slots(apart[at : at + own + GAP], DIMS)[:, :own]
            each = reduce(np.add, (self.weights[row] for row in s))
            first, last = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, at + own, "left"))
            if first < last:
                cuts = np.stack([np.clip(starts[first:last] - at, 0, own - 1), np.clip(ends[first:last] - at, 0, own)], axis=1).ravel()
                each = np.concatenate([each, np.zeros((1, bits), each.dtype)])
                total[first:last] += np.add.reduceat(each, cuts, axis=0, dtype=np.float64)[::2] * (cuts[1::2] > cuts[::2])[:, None]
        return total / np.maximum(np.diff(offsets), 1)[:, None] * self.scale + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the nearest codeword, its share of the softmax, and the lead over the second in loss per bit."""
        z = margins[:, None, :] * self.code[None]
        loss = np.logaddexp(0, -z).sum(axis=2)
        near = loss.argmin(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        order = np.sort(loss, axis=1)
        lead = (order[:, 1] - order[:, 0]) / self.code.shape[1] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return near, 1 / share.sum(axis=1), lead

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and lead of each whole text; ``und``, 0 and 0 for null and for texts without a letter."""
        named = np.array([bool(self.langs) and t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
        if not named.any():
            return [UNKNOWN] * len(named), np.zeros(len(named)), np.zeros(len(named))
        near, score, lead = self.decode(self.margins(*packed(texts)))
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(near, named, strict=True)], np.where(named, score, 0.0), np.where(named, lead, 0.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None, rows_per_lang: int = ROWS_PER_LANG, seed: int = 11) -> LanguageModel:
    """Learn from a bounded sample of labelled rows.

    ``where`` (over the column ``doc_id``) says which rows may be learned from. About ``rows_per_lang`` rows of each
    language are drawn by a hash of their id (all rows of an id, or none); their whole texts become n-gram frequencies,
    which are added up by language on the executors. Every language that has a row is learned. Rows without text,
    label or id teach nothing.
    """
    rows = pick(docs, [(id_col, "doc_id"), (text_col, "text"), (lang_col, "lang")])
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if where is None else where))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003))
    # One row a language; a language whose few rows were all missed is drawn whole by its smallest draw.
    least = rows.groupBy("lang").agg(F.min(draw).alias("low"), F.count(F.lit(1)).alias("n"))
    limits = [(r["lang"], max(r["low"] + 1, int(rows_per_lang / r["n"] * 1_000_003))) for r in least.collect()]
    if not limits:
        return LanguageModel([], np.zeros((0, 1), np.int8), np.zeros((DIMS, 1), np.float32), np.zeros(1), 1.0)
    known = docs.sparkSession.createDataFrame(limits, "lang string, most bigint")
    # One row a language, counted just now; texts must not travel by language, which a third of them may share.
    drawn = rows.join(F.broadcast(known) if len(limits) <= MOST_BROADCAST else known, "lang").where(draw < F.col("most")).select("lang", "text")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the rows' n-gram frequencies; a vector is given out when the language changes or the batches end."""
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            names = sorted(total)
            made = pa.record_batch([pa.array(names, pa.string()), pa.array([seen[k] for k in names], pa.int64()), pa.array([total[k].tobytes() for k in names], pa.binary())], ["lang", "n", "sums"])
            total.clear()
            seen.clear()
            return made

        for batch in batches:
            flat, offsets = packed(batch.column(1))
            for lang, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                if len(total) >= HELD_LANGS and lang not in total:
                    yield out()
                count = np.zeros(DIMS)
                for at in range(a, b, BLOCK_BYTES):
                    count += np.bincount(slots(lowered(flat[at : min(b, at + BLOCK_BYTES)]), DIMS).ravel(), minlength=DIMS)
                total[lang] = total.get(lang, 0.0) + count / max(1, b - a)
                seen[lang] = seen.get(lang, 0) + 1
        if total:
            yield out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One vector for each language, from those of the tasks, sorted by language."""
        lang, n, total = None, 0, None
        for batch in batches:
            for name, k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != lang and lang is not None:
                    yield one_language(lang, n, total)
                    n, total = 0, None
                lang, n = name, n + k
                total = np.frombuffer(raw, np.float64) + (0.0 if total is None else total)
        if lang is not None:
            yield one_language(lang, n, total)

    schema = "lang string, n bigint, sums binary"
    sums = drawn.mapInArrow(summed, schema).repartition("lang").sortWithinPartitions("lang", F.xxhash64("sums")).mapInArrow(merged, schema)
    found = sorted(sums.collect(), key=lambda r: r["lang"])
    langs = [r["lang"] for r in found]
    means = np.stack([np.frombuffer(r["sums"], np.float64) / r["n"] for r in found])
    code = codewords(len(langs), np.random.default_rng(seed))
    spread = means / means.sum(axis=1, keepdims=True) * (1 - SMOOTHING) + SMOOTHING / DIMS
    ones = code.T == 1  # (bits, languages)
    sides = [side @ spread / np.maximum(side.sum(axis=1, keepdims=True), 1) + (side.sum(axis=1, keepdims=True) == 0) / DIMS for side in (ones.astype(float), (~ones).astype(float))]
    weights = np.log(sides[0] / sides[1]).T  # (slots, bits)
    own = means @ weights  # (languages, bits): the margins of the languages' means
    middle = [np.where(side, own.T, np.nan) for side in (ones, ~ones)]
    bias = -np.array([(np.nanmin(a) + np.nanmax(b)) / 2 if s.any() and (~s).any() else 0.0 for a, b, s in zip(*middle, ones, strict=True)])
    scale = TYPICAL / max(1e-9, float(np.abs(own + bias).mean()))
    return LanguageModel(langs, code, weights.astype(np.float32), bias * scale, scale)


def one_language(lang: str, n: int, total: np.ndarray) -> pa.RecordBatch:
    """A row of the summed frequencies."""
    return pa.record_batch([pa.array([lang]), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["lang", "n", "sums"])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", least_lead: float = 0.01) -> DataFrame:
    """The language of every whole text.

    Returns one row per input row: ``doc_id, lang_pred, score, ambiguous``. Texts that are null, empty or have no
    letter are ``und`` with score 0; so is everything under a model that has learned no language. ``ambiguous`` marks
    a lead over the second codeword below ``least_lead``. Repeated rows repeat; an empty table gives an empty result;
    other columns are ignored.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, lead = model.predict(batch.column(1))
        return pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(lead < least_lead)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return map_batches(pick(docs, [(id_col, "doc_id"), (text_col, "text")]), each, f"doc_id {id_type(docs, id_col)}, lang_pred string, score double, ambiguous boolean")


def relabelled(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns; ``lang_col`` becomes the predicted language.

    Rows without a letter go. Under a model that has learned no language nothing is known against the others: they stay
    as they are. Columns are taken by position, so extra columns may repeat or clash.
    """
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at)
        lang, _, _ = model.predict(texts)
        if not model.langs:
            keep, lang = [t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], batch.column(lang_at)
        else:
            keep, lang = [x != UNKNOWN for x in lang], pa.array(lang, pa.string())
        columns = [lang if k == lang_at else c for k, c in enumerate(batch.columns)]
        return pa.record_batch(columns, [f"c{k}" for k in range(len(columns))]).filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return map_batches(plain, each, plain.schema).toDF(*docs.columns)


def learnable(column: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return remainder(F.col(column), 3) != 1
