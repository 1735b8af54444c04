"""A byte-level convolutional quality classifier in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover the whole document. Learned filters of ``WIDTH``
bytes slide over each chunk (every second position); a filter is a table of one weight per position and byte value, so
a response is a sum of table look-ups. Rectified responses are max-pooled within each chunk; the pooled values are
combined over the chunks, as their mean and their maximum, and one logistic unit makes a probability of them.

Training keeps the network small and its sample bounded: ``SAMPLE_DOCS`` labelled documents at most, whole. Scoring
reads every byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import id_type, map_batches, packed, remainder
from tidemark.sources.tables import pick

CHUNK, OVERLAP, WIDTH, STRIDE, FILTERS = 512, 32, 6, 2, 16
#: Bound of the training sample, in rows.
SAMPLE_DOCS = 2400
#: Stands for positions past a document's end; its weights stay zero.
PAD = 256
#: Chunks that go through the filters at once.
BLOCK = 256
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunk_matrix(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) byte codes; positions at or past a chunk's end are PAD."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    codes = flat[np.minimum(at, len(flat) - 1)].astype(np.uint16) if len(flat) else np.zeros(at.shape, np.uint16)
    return np.where(inside, codes, np.uint16(PAD))  # in 16 bits from the start: PAD would wrap round to byte 0


def chunk_spans(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of overlapping chunks that cover every document; an empty one has one empty chunk."""
    step = CHUNK - OVERLAP
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - OVERLAP) // step))
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[:-1][doc] + k * step
    return doc, starts, np.minimum(starts + CHUNK, offsets[1:][doc])


@dataclass
class ByteConvNet:
    """Filter tables (WIDTH, 257, FILTERS), filter biases, and the logistic unit over mean and maximum."""

    table: np.ndarray
    bias: np.ndarray
    mean_w: np.ndarray
    max_w: np.ndarray
    out_bias: float

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(chunks, positions, filters) before rectification."""
        last = STRIDE * (POSITIONS - 1) + 1
        out = self.table[0][x[:, 0:last:STRIDE]]
        for j in range(1, WIDTH):
            out += self.table[j][x[:, j : j + last : STRIDE]]
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(chunks, filters): rectified maximum over positions."""
        return np.maximum(self.responses(x).max(axis=1) + self.bias, 0)

    def score(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability for each document, from all of its chunks."""
        doc, starts, ends = chunk_spans(offsets)
        pools = np.empty((len(doc), len(self.bias)), np.float32)
        for at in range(0, len(doc), BLOCK):
            pools[at : at + BLOCK] = self.pooled(chunk_matrix(flat, starts[at : at + BLOCK], ends[at : at + BLOCK]))
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        mean = np.add.reduceat(pools, first, axis=0) / np.diff(first, append=len(doc))[:, None]
        z = mean @ self.mean_w + np.maximum.reduceat(pools, first, axis=0) @ self.max_w + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def fit(texts: list[list[bytes]], labels: np.ndarray, epochs: int = 8, seed: int = 5) -> ByteConvNet:
    """Train by Adam on documents given as chunks; the gradient of a maximum goes to the position that holds it.

    Responses are kept for ``BLOCK`` chunks at a time, so a long document costs time, not memory.
    """
    rng = np.random.default_rng(seed)
    net = ByteConvNet(rng.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS), rng.normal(0, 0.3, FILTERS), 0.0)
    net.table[:, PAD] = 0
    params = [net.table, net.bias, net.mean_w, net.max_w, np.zeros(1)]
    moment, square, step = [np.zeros(p.shape, np.float32) for p in params], [np.zeros(p.shape, np.float32) for p in params], 0
    if not texts or labels.min() == labels.max():
        net.out_bias = 3.0 * (1 if len(labels) and labels.max() else -1)
        net.mean_w[:], net.max_w[:] = 0, 0
        return net
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            chunks = [c for i in batch for c in texts[i]]
            doc = np.repeat(np.arange(len(batch)), [len(texts[i]) for i in batch])
            offsets = np.cumsum([0, *map(len, chunks)])
            x = chunk_matrix(np.frombuffer(b"".join(chunks), np.uint8), offsets[:-1], offsets[1:])
            where, tops = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), np.float32)
            for k in range(0, len(x), BLOCK):
                r = net.responses(x[k : k + BLOCK])
                where[k : k + BLOCK] = r.argmax(axis=1)
                tops[k : k + BLOCK] = np.take_along_axis(r, where[k : k + BLOCK, None], 1)[:, 0]
            pool = np.maximum(tops + net.bias, 0)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            n = np.diff(first, append=len(doc))[:, None]
            mean, most = np.add.reduceat(pool, first, axis=0) / n, np.maximum.reduceat(pool, first, axis=0)
            z = mean @ net.mean_w + most @ net.max_w + params[4][0]
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            back = (slope[:, None] * net.mean_w / n)[doc] + (pool == most[doc]) * (slope[:, None] * net.max_w)[doc]
            back = back * (pool > 0)
            grads = [np.zeros_like(net.table), back.sum(axis=0), slope @ mean, slope @ most, np.array([slope.sum()])]
            rows = np.arange(len(x))[:, None]
            for j in range(WIDTH):
                np.add.at(grads[0][j], (x[rows, where * STRIDE + j], np.arange(FILTERS)[None]), back)
            grads[0][:, PAD] = 0
            step += 1
            rate = 0.02 / (1 + 0.5 * epoch)
            for p, g, m, s in zip(params, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    net.out_bias = float(params[4][0])
    net.mean_w, net.max_w = net.mean_w.astype(np.float32), net.max_w.astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where: Column | None = None, sample_docs: int = SAMPLE_DOCS, seed: int = 5) -> ByteConvNet:
    """Learn from a bounded sample of labelled documents.

    ``where`` (over the column ``doc_id``) says which rows may be learned from. At most half of ``sample_docs`` rows of
    either label are drawn by a hash of their id, from the narrow label table; their chunks reach the driver. Rows with a
    null id, label or text teach nothing; of an id with both labels the smaller counts, of an id with several texts all. Label 0 is rarer as a rule, so the two are drawn alike
    and the output bias is moved to the labels' true shares afterwards.
    """
    marked = pick(labels, [(id_col, "doc_id"), (label_col, "label")]).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (F.lit(True) if where is None else where))
    counts = {int(r["label"]): r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [marked.where(F.col("label") == v).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_docs // 2) for v in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1]).groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = pick(docs, [(id_col, "doc_id"), (text_col, "text")]).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", F.xxhash64("text").alias("h"))  # at most sample_docs ids

    def sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, offsets = packed(batch.column(1))
        doc, starts, ends = chunk_spans(offsets)
        out = []
        for i in range(batch.num_rows):
            out.append([flat[starts[k] : ends[k]].tobytes() for k in np.flatnonzero(doc == i)])
        return pa.record_batch([batch.column(0).cast(pa.string()), batch.column(2).cast(pa.int32()), batch.column(3), pa.array(out, pa.list_(pa.binary()))], ["key", "label", "h", "chunks"])

    # Ids that repeat are bounded too: the same rows whenever it runs.
    sample = map_batches(rows, sampled, "key string, label int, h bigint, chunks array<binary>").orderBy("key", "h").limit(2 * sample_docs).collect()
    y = np.array([r["label"] for r in sample], float)
    net = fit([[bytes(c) for c in r["chunks"]] for r in sample], y, seed=seed)
    if 0 < y.sum() < len(y):
        net.out_bias += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return net


def score(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """Quality of every whole text: ``doc_id, score, predicted`` (1 if the score is ``cut`` or more).

    Null texts count as empty; an empty text is one empty chunk and has a score. Repeated rows repeat; an empty table
    gives an empty result; other columns are ignored. Equal texts have equal scores.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        value = net.score(*packed(batch.column(1)))
        return pa.record_batch([batch.column(0), pa.array(value), pa.array((value >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(pick(docs, [(id_col, "doc_id"), (text_col, "text")]), each, f"doc_id {id_type(docs, id_col)}, score double, predicted int")


def held_out(column: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0; rows without id are among them."""
    return F.coalesce(remainder(F.col(column), 5) == 0, F.lit(True))
