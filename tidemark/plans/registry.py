"""The register of named queries and their SQL, which the catalog's modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: 2024-01-01 and 2024-02-01, UTC.
SINCE, UNTIL = 1_704_067_200_000_000, 1_706_745_600_000_000


def query(sql: str | None = None, longs: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one.

    ``longs`` names columns whose sums DuckDB makes wider than a long.
    """
    if sql and longs:
        sql = f"SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in longs.split())}) FROM ({sql})"

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    """Columns rounded to 6 digits."""
    return [F.round(n, 6).alias(n) for n in names]


def longs(*names: str) -> list:
    """Counts as longs."""
    return [F.col(n).cast("bigint").alias(n) for n in names]
