"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import pick

#: The six ASCII white-space bytes of ``[\x20\x09-\x0D]``.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Rows that a Python function sees at once: bounds what it holds beside the Arrow batch.
STEP = 1024
#: Byte table that lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8 bytes; null becomes empty."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    return pc.fill_null(column, b"").to_pylist()


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one uint8 array, and each row's (start, end) offsets as n + 1 values."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to every batch, ``STEP`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                yield each(batch.slice(at, STEP))

    return df.mapInArrow(run, schema)


def marked(df: DataFrame, row_col: str | None, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """``pick`` with a last column ``mark``: the key in ``row_col`` that tells rows apart, null without one."""
    return pick(df, [*columns, (row_col, "mark")]) if row_col else pick(df, columns).withColumn("mark", F.lit(None).cast("bigint"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def id_type(df: DataFrame, name: str) -> str:
    """The DDL type of a column, by exact name."""
    return next(f.dataType.simpleString() for f in df.schema.fields if f.name == name)
