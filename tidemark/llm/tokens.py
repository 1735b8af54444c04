"""Token counts of whole texts by a SentencePiece model, with overlap resynchronisation for huge documents.

A text up to ``chunk_bytes`` long is encoded in one call. A longer one is encoded in overlapping chunks with offsets.
Two neighbouring encodings are spliced at a boundary in their overlap that is proven stable: no piece of the
vocabulary holds the two characters around it next to each other, so no merge can cross it whatever the context, and
both sides are encoded as they would be in the whole text. Both encodings must show that boundary. If the overlap has
none, it is doubled until it has, at worst to the end of the document.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm.texts import id_type, map_batches
from tidemark.sources.tables import pick

MODEL_FILE = "piece_bpe_32k.model"
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 256
SPACE = "▁"


#: Texts that normalisers change: compatibility forms, runs of spaces, composed letters, control characters.
PROBES = ("\ufb01 \uff21\u3000x", "  a  b ", "\u00e9 e\u0301", "a\tb\nc", "A\u00ad\u2126")


class PieceCounter:
    """Counts and boundaries of a SentencePiece BPE model.

    Chunks need a normaliser that only turns spaces into U+2581, which is tried on ``PROBES``; under any other a text is
    encoded in one call, however long.
    """

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        plain = [self.model.id_to_piece(i) for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.chunks = all(self.untouched(t) for t in PROBES)
        self.inside = {a + b for p in plain for a, b in zip(p, p[1:], strict=False)}

    def untouched(self, text: str) -> bool:
        """Whether the pieces of a text are the text itself, with U+2581 for spaces and perhaps one in front."""
        made = []
        for k, piece in enumerate(self.model.encode(text, return_type="proto").pieces):
            if not self.model.is_byte(piece.id) and piece.piece not in (piece.surface.replace(" ", SPACE), SPACE * (k == 0) + piece.surface.replace(" ", SPACE)):
                return False
            made.append(piece.surface)
        return "".join(made) == text

    def boundaries(self, chunk: str) -> list[int]:
        """Character offsets at which a token of the chunk's encoding ends, in order, with repeats within a character."""
        found = self.model.encode(chunk, return_type="proto").pieces
        ends, at, done = [], 0, 0
        raw = chunk.encode()
        for piece in found:
            at += len(raw[done : piece.end].decode(errors="ignore")) if piece.end > done else 0
            done = max(done, piece.end)
            ends.append(at)
        return ends

    def stable(self, text: str, at: int) -> bool:
        """Whether no merge can cross the boundary before ``text[at]``."""
        a, b = text[at - 1], text[at]
        return (SPACE if a == " " else a) + (SPACE if b == " " else b) not in self.inside

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        """Number of tokens of the whole text."""
        n = len(text)
        if n <= chunk or not self.chunks:
            return len(self.model.encode(text))
        total, start, splice = 0, 0, -1  # tokens before `splice` are counted; the chunk from `start` is being read
        stop = min(n, start + chunk)
        ends = self.boundaries(text[start:stop])
        while stop < n:
            lap = overlap
            while True:
                left = max(splice, stop - lap, 0)
                right = min(n, left + max(chunk, 2 * lap))
                there = self.boundaries(text[left:right])
                known = {start + e for e in ends}
                common = [left + e for e in there if left < left + e < stop and left + e in known and left + e > splice and self.stable(text, left + e)]
                if common:
                    break
                if left <= max(splice, 0) and right == n:
                    break
                if left <= max(splice, 0):  # no splice in the whole chunk: let it grow
                    stop = min(n, stop + lap)
                    ends = self.boundaries(text[start:stop])
                    if stop == n:
                        break
                lap *= 2
            if not common:
                # Everything from the last splice on goes through the model as one piece.
                stop = n
                ends = self.boundaries(text[start:n])
                break
            cut = common[len(common) // 2]
            total += sum(splice < start + e <= cut for e in ends)
            start, splice, stop, ends = left, cut, right, there
        return total + sum(start + e > splice for e in ends)


@lru_cache(maxsize=4)
def load(path: str) -> PieceCounter:
    """The counter of a model file, once per process."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Token counts of every whole text.

    Returns one row per input row: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens), without
    begin, end or other added tokens; strings of special tokens inside texts are ordinary text. Null texts count as
    empty: 0 bytes, 0 tokens. Repeated rows repeat; an empty table gives an empty result; other columns are ignored.
    """
    path = path or public_tokenizers.path(MODEL_FILE)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = load(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        short = [i for i, t in enumerate(texts) if len(t) <= chunk]
        counts = [0] * len(texts)
        for i, ids in zip(short, counter.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            counts[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > chunk:
                counts[i] = counter.count(t, chunk, overlap)
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        return pa.record_batch([batch.column(0), size, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(pick(docs, [(id_col, "doc_id"), (text_col, "text")]), each, f"doc_id {id_type(docs, id_col)}, n_bytes bigint, n_tokens bigint, over_limit boolean")
