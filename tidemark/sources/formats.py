"""Sources and sinks beside Parquet: JSON lines, CSV, text; Prometheus text; documents of several formats."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import documents


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode("errorifexists").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines under a schema; a line that does not parse is a row of nulls, missing fields are null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, so any text comes back as it was."""
    df.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("nullValue", None).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under a schema; quoted line breaks belong to their field."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def prometheus_lines(buckets: DataFrame, name: str) -> DataFrame:
    """``line`` for each bucket (``le, n``), the total and the sum of a histogram, in Prometheus' text format.

    ``buckets`` also has the columns ``count`` and ``sum``, the same in every row; ``at`` orders the lines.
    """
    number = F.regexp_replace(F.col("le").cast("string"), r"\.0$", "")
    rows = buckets.select(F.col("le").alias("at"), F.concat(F.lit(f'{name}_bucket{{le="'), number, F.lit('"} '), F.col("n").cast("string")).alias("line"))
    total = buckets.select("count", "sum").distinct()
    ends = total.select(F.explode(F.array(
        F.struct(F.lit(1e300).alias("at"), F.concat(F.lit(f'{name}_bucket{{le="+Inf"}} '), F.col("count").cast("string")).alias("line")),
        F.struct(F.lit(1.1e300).alias("at"), F.concat(F.lit(f"{name}_sum "), F.format_string("%.3f", "sum")).alias("line")),
        F.struct(F.lit(1.2e300).alias("at"), F.concat(F.lit(f"{name}_count "), F.col("count").cast("string")).alias("line")),
    )).alias("x")).select("x.at", "x.line")
    return rows.unionByName(ends)


def csv_text(content: Column) -> Column:
    """A CSV file as lines of its non-blank cells, trimmed, joined by `` | ``."""

    def read(files: pd.Series) -> pd.Series:
        return files.map(lambda t: "\n".join(" | ".join(c.strip() for c in row if c.strip()) for row in csv.reader(io.StringIO(t))), na_action="ignore")

    read.__annotations__ = {"files": pd.Series, "return": pd.Series}
    return F.pandas_udf(read, "string")(content)


def document_text(name: Column, content: Column) -> Column:
    """The text of a document by its file name's extension: CSV and HTML are read, all else is text already.

    ``content`` is a string; bytes that are no UTF-8 became replacement characters when it was made. Null stays null.
    """
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(kind == "csv", csv_text(content)).when(kind.isin("html", "htm"), documents.html_text(content)).otherwise(content)
