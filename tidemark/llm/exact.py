"""Exact duplicates with Patricia-trie owners.

Texts are equal when they are identical after deleting ASCII white space. The work has two trie levels:

1. Every input task inserts the full normalised byte strings of its rows into a compressed radix trie. A terminal
   node keeps its owner (most code points, then smallest id) and a count, so a group of copies leaves a task as one
   row, however large it is. When the trie outgrows its memory budget its largest subtree is written out and cut.
2. The terminals are dealt by (length, content hash). Each bucket's byte strings go into a trie again, which tells
   true copies from hash collisions and names the global owner. A bucket holds equal texts, or colliding ones, so
   the trie lives only as long as its bucket.

Rows that stand for documents carry no text past level 1. The level-1 result is a written table: both later reads
see the same rows even if an executor is lost between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.texts import SPACE_BYTES, id_type, marked, utf8
from tidemark.sources.shared import Scratch, store

#: Bytes of labels that a level-1 trie holds before it spills a subtree.
TRIE_BYTES = 48_000_000


def common_length(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``, by comparing halves."""
    lo, hi = 0, min(len(a), len(b) - at)
    if a[:hi] == b[at : at + hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid
    return lo


@dataclass(slots=True)
class Node:
    """An edge label, the children by first byte, and the payload if a string ends here."""

    label: bytes
    children: dict[int, Node] = field(default_factory=dict)
    payload: list | None = None


class PatriciaTrie:
    """A compressed radix trie over byte strings with one mutable payload per string."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.held: dict[int, int] = {}

    @property
    def size(self) -> int:
        """Bytes held in labels, with an allowance for each string."""
        return sum(self.held.values())

    def terminal(self, text: bytes) -> tuple[Node, bool]:
        """The node at which ``text`` ends, and whether it was a terminal before."""
        node, at, top = self.root, 0, text[0] if text else -1
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                leaf = node.children[text[at]] = Node(text[at:])
                self.held[top] = self.held.get(top, 0) + len(text) - at + 300
                return leaf, False
            same = common_length(child.label, text, at)
            if same < len(child.label):
                middle = Node(child.label[:same], {child.label[same]: child})
                child.label = child.label[same:]
                node.children[text[at]] = middle
                self.held[top] = self.held.get(top, 0) + 300
                child = middle
            node, at = child, at + same
        return node, node.payload is not None

    def cut_largest(self) -> Iterator[tuple[bytes, list]]:
        """Remove the largest subtree under the root and yield its strings with their payloads."""
        top = max(self.held, key=self.held.get)
        child = self.root.children.pop(top, None)
        del self.held[top]
        if child is not None:
            yield from walk(child, b"")

    def drain(self) -> Iterator[tuple[bytes, list]]:
        """Yield every string with its payload, and empty the trie."""
        root, self.root, self.held = self.root, Node(b""), {}
        yield from walk(root, b"")


def walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
    """The strings under ``node``, in byte order."""
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        text = prefix + node.label
        if node.payload is not None:
            yield text, node.payload
        stack.extend((node.children[b], text) for b in sorted(node.children, reverse=True))


def rank(points: int, doc_id: object, row: int) -> tuple:
    """Sort key of an owner: most code points, then the smallest id (null last), then the first row."""
    return (-points, doc_id is None, doc_id if doc_id is not None else 0, row)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES, row_col: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Classes of texts that are equal without ASCII white space.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Of equal texts the row with the
    most code points in its original text stays, then the one with the smallest id; of rows that repeat an id and a
    length, one stays. Null texts count as empty; a null id sorts last; an empty table gives an empty result; other
    columns are ignored. ``row_col`` names a long that tells rows apart; it is returned as a last column. The result reads
    a table in ``scratch``, which its owner may drop once the result is written.
    """
    kind = id_type(docs, id_col)
    scratch = scratch or Scratch(docs.sparkSession)
    rows = marked(docs, row_col, [(id_col, "doc_id"), (text_col, "text")])
    id_arrow = to_arrow_type(next(f.dataType for f in docs.schema.fields if f.name == id_col))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        trie, row, terms = PatriciaTrie(), part, part

        def spilled(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
            block, held = [], 0
            for text, payload in found:
                block.append((text, payload))
                held += len(text)
                if held > 4_000_000:
                    yield terminals(block)
                    block, held = [], 0
            if block:
                yield terminals(block)

        def terminals(block: list) -> pa.RecordBatch:
            n = len(block)
            best = [p[0] for _, p in block]
            return pa.record_batch([
                pa.array([b[2] for b in best], id_arrow), pa.array([b[3] for b in best], pa.int64()), pa.array([p[2] for _, p in block], pa.int64()), pa.array([-b[0] for b in best], pa.int64()), pa.array([p[1] for _, p in block], pa.int64()),
                pa.array([len(t) for t, _ in block], pa.int64()), pa.array([p[3] for _, p in block], pa.binary()), pa.array([t for t, _ in block], pa.binary()), pa.nulls(n, pa.int64()),
            ], names)

        names = ["doc_id", "row", "term", "points", "copies", "n_bytes", "sha", "body", "mark"]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            points = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            out_term, out_len, out_sha = [], [], []
            first = row
            for doc_id, n, raw in zip(ids, points, utf8(batch.column(1)), strict=True):
                body = raw.translate(None, SPACE_BYTES)
                node, known = trie.terminal(body)
                mine = (*rank(n, doc_id, row)[:2], doc_id, row)
                if not known:
                    node.payload = [mine, 0, terms, hashlib.sha256(body).digest()]
                    terms += 1
                elif rank(n, doc_id, row) < rank(-node.payload[0][0], node.payload[0][2], node.payload[0][3]):
                    node.payload[0] = mine
                node.payload[1] += 1
                out_term.append(node.payload[2])
                out_len.append(len(body))
                out_sha.append(node.payload[3])
                row += 1
                while trie.size > trie_bytes:
                    yield from spilled(trie.cut_largest())
            n = len(ids)
            empty = pa.nulls(n, pa.int64())
            yield pa.record_batch([pa.array(ids, id_arrow), pa.array(range(first, row), pa.int64()), pa.array(out_term, pa.int64()), empty, empty, pa.array(out_len, pa.int64()), pa.array(out_sha, pa.binary()), pa.nulls(n, pa.binary()), batch.column(2)], names)
        yield from spilled(trie.drain())

    level1 = scratch.store(rows.mapInArrow(local, f"doc_id {kind}, row bigint, term bigint, points bigint, copies bigint, n_bytes bigint, sha binary, body binary, mark bigint"), "exact-terms")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named() -> pa.RecordBatch:
            out = []
            for _, (best, copies, members) in trie.drain():
                out += [(m, best[2], best[3], copies) for m in members]
            return pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], id_arrow), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64())], ["term", "keep_id", "keep_row", "group_size"])

        trie, bucket = PatriciaTrie(), None
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_id, row, term, points, copies, n_bytes, sha, body = x
                if (n_bytes, sha) != bucket:
                    if bucket is not None:
                        yield named()
                    bucket = (n_bytes, sha)
                node, known = trie.terminal(body)
                if not known:
                    node.payload = [(-points, 0, doc_id, row), 0, []]
                elif rank(points, doc_id, row) < rank(-node.payload[0][0], node.payload[0][2], node.payload[0][3]):
                    node.payload[0] = (-points, 0, doc_id, row)
                node.payload[1] += copies
                node.payload[2].append(term)
        if bucket is not None:
            yield named()

    owners = (
        level1.where(F.col("body").isNotNull())
        .drop("mark")
        .repartition("n_bytes", "sha")
        .sortWithinPartitions("n_bytes", "sha")
        .mapInArrow(merge, f"term bigint, keep_id {kind}, keep_row bigint, group_size bigint")
    )
    members = level1.where(F.col("body").isNull()).select("doc_id", "row", "term", "sha", "mark")
    return members.join(owners, "term").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *([F.col("mark").alias(row_col)] if row_col else []))


def kept_rows(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_col`` of the rows that stay, in a table of their own; what led to them is dropped."""
    scratch = Scratch(docs.sparkSession)
    kept = store(exact_dedup(docs, id_col, text_col, row_col=row_col, scratch=scratch).where("kept").select(row_col), "exact-kept")
    scratch.drop()
    return kept
