"""Byte-level BPE with a rank queue of hierarchical bitmaps.

The pre-tokens of the public pattern are encoded one by one. Within a pre-token the parts form a linked list of byte
positions. Each mergeable pair waits in the bucket of its merge rank; a hierarchical bitmap over the ranks finds the
lowest bucket that is not empty with two find-first-set steps, so a merge costs the same in a pre-token of a million
bytes as in a word. Entries are not deleted when a neighbour changes: an entry whose pair no longer has the bucket's
rank is stale and skipped.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from tidemark.llm.texts import id_type, map_batches
from tidemark.sources.tables import pick

RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Distinct pre-tokens in each of the two generations of encodings that a worker keeps, and the longest that it keeps.
KEPT, KEPT_BYTES = 350_000, 64


#: Above every rank: the pair can't merge.
NEVER = 1 << 60


class RankQueue:
    """Positions in buckets by merge rank, under a two-level bitmap of 256-bit words."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        """Let a position wait in the bucket of its rank."""
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.put(rank, [position])
        else:
            bucket.append(position)

    def put(self, rank: int, positions: list[int]) -> None:
        """Fill the bucket of a rank that has none, or add to one that has."""
        if rank in self.buckets:
            self.buckets[rank] += positions
        else:
            self.buckets[rank] = positions
            self.low[rank >> 8] |= 1 << (rank & 255)
            self.top |= 1 << (rank >> 8)

    def take(self) -> tuple[int, list[int]]:
        """Remove the bucket of the lowest rank; its positions come rightmost first, to be popped leftmost first."""
        top = self.top
        word = (top & -top).bit_length() - 1
        bits = self.low[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.low[word] = bits
        if not bits:
            self.top = top & (top - 1)
        positions = self.buckets.pop(rank)
        if len(positions) > 1:
            positions.sort(reverse=True)
        return rank, positions


class ByteBPE:
    """Encoder and decoder for a table of byte strings and ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_ids = [ranks.get(bytes([b])) for b in range(256)]
        #: (left id, right id) -> rank of the token that their bytes make together.
        self.pairs = {left << 32 | right: rank for token, rank in ranks.items() for k in range(1, len(token)) if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None}
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, queue, pair = len(piece), self.queue, self.pairs.get
        push, take = queue.push, queue.take
        ids = [self.byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank[i]: of the pair that begins at part i. Only a pair that no neighbour precedes can be next, so only those wait.
        rank = [pair(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        rank.append(NEVER)
        left = NEVER
        for i in range(n - 1):
            r = rank[i]
            if r < left and r <= rank[i + 1]:
                push(r, i)
            left = r
        while queue.top:
            lowest, positions = take()
            while positions:
                i = positions.pop()
                if rank[i] != lowest:
                    continue  # stale
                j = after[i]
                after[i] = k = after[j]
                ids[i], ids[j] = lowest, -1
                old_j, rank[j] = rank[j], NEVER
                new, beyond = NEVER, NEVER
                if k < n:
                    before[k] = i
                    new, beyond = pair(lowest << 32 | ids[k], NEVER), rank[k]
                rank[i] = new
                again = False
                if (h := before[i]) >= 0:
                    old_h = rank[h]
                    rank[h] = back = pair(ids[h] << 32 | lowest, NEVER)
                    hh = before[h]
                    r = rank[hh] if hh >= 0 else NEVER
                    if back < r and back <= new and back < NEVER:
                        push(back, h)
                        again = back <= lowest
                    elif old_h < r <= back and r < NEVER and (hh == 0 or r < rank[before[hh]]):
                        push(r, hh)
                        again = r <= lowest
                else:
                    back = NEVER
                if new < back and new <= beyond:
                    push(new, i)
                    again |= new <= lowest
                elif old_j <= beyond < new and beyond <= rank[after[k]]:
                    push(beyond, k)
                    again |= beyond <= lowest
                if again and positions:  # a new pair may go before the rest of this bucket
                    queue.put(lowest, positions)
                    break
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, each match of the pattern on its own."""
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def entry(self, piece: str) -> tuple[int, str, bytes]:
        """Count, ids in decimal and decoded bytes of a pre-token; short ones that were seen lately are kept."""
        if (known := self.young.get(piece)) is None:
            if (known := self.old.pop(piece, None)) is None:
                ids = self.encode_piece(piece.encode())
                known = (len(ids), " ".join(map(str, ids)), self.decode(ids))
                if len(known[2]) > KEPT_BYTES:
                    return known
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[piece] = known
        return known


@lru_cache(maxsize=4)
def load(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    """The encoder of a rank file, once per process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBPE(ranks, pattern)


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: ``doc_id, ids array<int>, n_tokens``, one row for each row.

    Null texts count as empty and have no ids; null and repeated ids, and repeated rows, are returned as they come. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    path = path or public_tokenizers.path(RANKS_FILE)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = load(path)
        ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return map_batches(pick(docs, [(id_col, "doc_id"), (text_col, "text")]), each, f"doc_id {id_type(docs, id_col)}, ids array<int>, n_tokens bigint")


def bpe_decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of id lists: ``doc_id, bytes``. Null lists count as empty; an id outside the table is an error."""
    path = path or public_tokenizers.path(RANKS_FILE)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = load(path)
        return pa.record_batch([batch.column(0), pa.array([encoder.decode(i or []) for i in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return map_batches(pick(encoded, [(id_col, "doc_id"), (ids_col, "ids")]), each, f"doc_id {id_type(encoded, id_col)}, bytes binary")


def bpe_digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding every whole text and decoding it again.

    Returns one row per input row: ``doc_id, n_tokens, ids_sha256`` (of the decimal ids joined by one space) and
    ``decoded_sha256``. Null texts count as empty. Repeated rows repeat; an empty table gives an empty result; other
    columns are ignored. Encodings of short pre-tokens are kept per worker, up to a bound.
    """
    path = path or public_tokenizers.path(RANKS_FILE)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = load(path)
        findall, entry = encoder.pattern.findall, encoder.entry
        counts, ids, decoded = [], [], []
        for text in batch.column(1).to_pylist():
            found = [entry(piece) for piece in findall(text or "")]
            counts.append(sum([x[0] for x in found]))
            ids.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(pick(docs, [(id_col, "doc_id"), (text_col, "text")]), each, f"doc_id {id_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
