"""Reading tables and picking columns safely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data set at ``sf_dir`` (any path that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Select ``(name, alias)`` pairs by exact name.

    Columns are addressed by position, so extra columns whose names differ only in case, hold dots or
    repeat do not make the selection ambiguous; the first exact match wins.
    """
    names = list(df.columns)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(name)}").alias(alias) for name, alias in columns])
