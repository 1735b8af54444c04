"""SimHash near-duplicates through an inverted index on byte positions, with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most two bits differ in at most two bytes, so they
share at least six positional bytes. Seen as four two-byte groups, at least two whole groups are among the shared
ones: the index posts each distinct fingerprint under its six pairs of groups (four positional bytes, 32 bits each).
Within a posting list pairs are never listed all with all: two further shared positional bytes split it, after which only
16 bits are free, and partners are looked up under the 136 masks of one or two bits. The shared positional bytes of each
pair so found are tallied, pairs with six or more are retained, and those are verified by their differing bits. Lists of
any size go the same way, all those of a batch at once.

Copies meet before any of this: only distinct fingerprints are indexed, each with its smallest id. A posting list
leaves as a spanning forest of its verified links, so no group turns into all its pairs. Components come from
large-star and small-star rounds over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import LOWER, id_type, map_batches, marked, utf8
from tidemark.sources.shared import store

#: Words handled at once within a document.
BLOCK_WORDS = 1 << 18
#: The 16-bit values with one or two bits set, and zero left out.
MASKS16 = np.array(sorted({1 << a | 1 << b for a in range(16) for b in range(16)}), np.uint64)
#: Pairs of the four two-byte groups: the anchors of the index.
ANCHORS = list(combinations(range(4), 2))


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; see ``simhash_components``."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK_WORDS):
        block = words[at : at + BLOCK_WORDS + width - 1]
        shingles = map(b" ".join, zip(*(block[k:] for k in range(width)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(block) - width + 1)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, row_col: str | None = None) -> DataFrame:
    """``doc_id, fp, mark``: the fingerprint of each row as a signed long, and the row's key (null without ``row_col``).

    One row for each row, repeated ones and null ids included; null texts are empty and have fingerprint zero. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, width) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(fp), batch.column(2)], ["doc_id", "fp", "mark"])

    return map_batches(marked(docs, row_col, [(id_col, "doc_id"), (text_col, "text")]), each, f"doc_id {id_type(docs, id_col)}, fp bigint, mark bigint")


def linked(keys: np.ndarray, fps: np.ndarray, bits: int = 2) -> np.ndarray:
    """Spanning forests, as (n, 2) rows, of the links within posting lists.

    ``keys`` are sorted, ``fps`` distinct within a key; a key's upper half is the anchor.
    """
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(keys)))
    many = np.repeat(size > 1, size)
    if not many.any():
        return np.zeros((0, 2), np.uint64)
    lists, fps, anchors = np.cumsum(new)[many].astype(np.uint64), fps[many], (keys[many] >> 32).astype(np.int64)
    free = np.array([[p for p in range(8) if p // 2 not in pair] for pair in ANCHORS])[anchors]  # (rows, 4) byte positions
    parts = fps[:, None] >> (8 * free).astype(np.uint64) & np.uint64(255)
    found = []
    for a, b in combinations(range(4), 2):  # four anchor bytes and these two are the six shared ones
        c, d = (p for p in range(4) if p not in (a, b))
        split = lists << np.uint64(32) | parts[:, a] << np.uint64(24) | parts[:, b] << np.uint64(16)
        order = np.argsort(split, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], split[order][1:] != split[order][:-1]]))
        size = np.diff(np.append(first, len(order)))
        rows = order[np.repeat(size > 1, size)]
        key = split[rows] | parts[rows, c] << np.uint64(8) | parts[rows, d]
        rows, key = rows[np.argsort(key)], np.sort(key)
        for mask in MASKS16 if len(rows) else ():
            probe = key ^ mask
            at = np.minimum(np.searchsorted(key, probe), len(key) - 1)
            hit = np.flatnonzero((key[at] == probe) & (key < probe))
            found.append(np.stack([rows[hit], rows[at[hit]]], axis=1))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    differ = fps[pairs[:, 0]] ^ fps[pairs[:, 1]]
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    pairs = pairs[(tally >= 8 - bits) & (np.bitwise_count(differ) <= bits)]
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    kept = []
    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            kept.append((i, j))
    return fps[np.array(kept, np.int64)] if kept else np.zeros((0, 2), np.uint64)


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect all within two differing bits.

    Not every such pair is a link, but its two are connected by links. ``fp`` is not null and, as a rule, distinct: repeats only
    cost work. An empty table gives no links; other columns are ignored.
    """

    def posted(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        u = fp.view(np.uint64)
        groups = [u >> np.uint64(16 * g) & np.uint64(0xFFFF) for g in range(4)]
        keys = [np.uint64(k) << np.uint64(32) | groups[a] << np.uint64(16) | groups[b] for k, (a, b) in enumerate(ANCHORS)]
        return pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, len(ANCHORS)))], ["key", "fp"])

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within posting lists; the last list of a batch waits for the next batch."""
        held, waiting = [], None

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
            e = linked(rows[:, 0], rows[:, 1].view(np.uint64)).view(np.int64)
            return pa.record_batch([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            last = rows[-1, 0]
            if waiting is None or last != waiting:
                cut = int(np.searchsorted(rows[:, 0], last))
                held.append(rows[:cut])
                if sum(map(len, held)):
                    yield out()
                held, waiting = [rows[cut:].copy()], last
            else:
                held.append(rows.copy())
        if held:
            yield out()

    postings = map_batches(distinct.select("fp"), posted, "key bigint, fp bigint")
    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(tallied, "a bigint, b bigint").distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``node, root``: the smallest node of each component, for every node of the edges ``a, b``.

    Nodes are longs. Edges may repeat and point either way; an edge of a node with itself is no edge, and a node without another has no
    row. Null ends are no edge. Large-star and small-star rounds alternate until a round changes nothing. Each round is two aggregations and two
    joins over the edges and ends in a written table; nothing is gathered by node, so a hub costs no task its size.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs: child, parent with parent < child."""
        both = pairs.select(F.col("child").alias("u"), F.col("parent").alias("v"))
        if large:
            both = both.unionByName(pairs.select(F.col("parent").alias("u"), F.col("child").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u").where(F.col("v") > F.col("u") if large else F.lit(True)).select(F.col("v").alias("child"), F.col("m").alias("parent"))
        if not large:
            moved = moved.unionByName(least.select(F.col("u").alias("child"), F.col("m").alias("parent")))
        return moved.where(F.col("child") > F.col("parent")).distinct()

    pairs = edges.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).where(F.col("child") > F.col("parent")).distinct()
    pairs = store(pairs, tag)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first())

    seen = mark(pairs)
    while seen[0]:
        pairs = store(star(star(pairs, True), False), tag)
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("child").alias("node"), F.col("parent").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Fingerprints and their connected components.

    Returns one row per input row: ``doc_id, fingerprint, component_id``. Words are ``[^\\x20\\x09-\\x0D]+`` after
    lower-casing A-Z; each run of ``width`` words, repeats included, is hashed with XXH64 (seed 42); a bit is set if
    more than half of the hashes set it. Shorter texts hash their whole sequence; texts without words (null and empty
    too) have fingerprint zero and link like any other. Fingerprints link at two or fewer differing bits;
    ``component_id`` is the smallest id that can be reached. Null ids keep their row and never name a component that
    has another id. An empty table gives an empty result; other columns are ignored.
    """
    placed = in_components(docs, id_col, text_col, width)
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``row_col`` of one row of each component: of the rows with its smallest id (null if it has no other) the first."""
    placed = in_components(docs, id_col, text_col, width, row_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return placed.groupBy("root").agg(F.min("mark").alias(row_col)).select(row_col)


def in_components(docs: DataFrame, id_col: str, text_col: str, width: int, row_col: str | None = None) -> DataFrame:
    """``doc_id, fp, mark, component_id, root``: each row's component by its smallest id and by a fingerprint in it."""
    prints = store(fingerprints(docs, id_col, text_col, width, row_col), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct), "simhash-components")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = named.join(tops, "root").select("fp", "component_id", "root")
    return prints.join(owner, "fp").select("doc_id", "fp", "mark", "component_id", "root")
