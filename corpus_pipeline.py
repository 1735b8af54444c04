"""A corpus pipeline: language ID, exact dedup, SimHash near-dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact, language, mixing, simhash
from tidemark.sources.shared import store
from tidemark.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: The key of a stage's input rows; ids may be null or repeat.
ROW = "pipeline_row"


def at(docs: DataFrame, name: str) -> str:
    """The name in ``keyed`` of the first column with exactly this name."""
    return f"c{docs.columns.index(name)}"


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` by position, ``c0`` and so on, with a key for every row.

    Written once, so that all reads of a stage see the same keys. Names that repeat or differ in case only cannot clash.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return store(plain.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def only(rows: DataFrame, kept: DataFrame, names: list[str]) -> DataFrame:
    """Rows of a keyed table whose key is in ``kept``, under their own names.

    Keys compress to little, so Spark would take millions for a small table: they are merged, not broadcast.
    """
    return rows.join(kept.select(ROW).hint("merge"), ROW, "left_semi").drop(ROW).toDF(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is ``und`` (no letter at all, null and empty texts too) go; the others carry the predicted language.

    Repeated rows have one fate. Where no language can be learned, texts with letters stay and keep their label. An
    empty table stays empty; extra columns stay, whatever their names.
    """
    return language.relabelled(docs, language.train(docs, where=language.learnable()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty ones are equal) one row stays: the longest original, then the smallest id, a null id last.

    Of rows that repeat in all of that one stays. Rows are told apart by a key, so ids may repeat. An empty table stays
    empty; extra columns stay, whatever their names.
    """
    rows = keyed(docs)
    return only(rows, exact.kept_rows(rows, ROW, id_col=at(docs, "doc_id"), text_col=at(docs, "text")), docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row with the smallest id stays; a component of null ids keeps one row.

    Texts without words (null and empty too) are one component with what lies near fingerprint zero. Rows are told apart
    by a key, so ids may repeat. An empty table stays empty; extra columns stay, whatever their names.
    """
    rows = keyed(docs)
    return only(rows, simhash.kept_rows(rows, ROW, id_col=at(docs, "doc_id"), text_col=at(docs, "text")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice.

    Every row is a unit of its own, also when its id is null or repeats; a null source is a source, the last. Rows
    without words, null texts too, are taken like the others of their source but count for nothing. An empty table stays
    empty; extra columns stay, whatever their names.
    """
    rows = keyed(docs)
    times = mixing.mix(rows, id_col=at(docs, "doc_id"), text_col=at(docs, "text"), source_col=at(docs, "source"), row_col=ROW)
    times = times.select(ROW, F.col("times").cast("int").alias("times")).where("times > 0")
    taken = rows.join(times.hint("merge"), ROW).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.drop(ROW, "times", "copy").toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, one row for each row; null texts are empty."""
    return bpe.bpe_digest(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("mix_sources", mix_sources), ("bpe", encode)]
#: Language ID, SimHash components and the cube method are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
