"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is hashed to 128 bits. Documents come in batches. A batch's run holds its keys with the number of its
documents that have them, sorted and bucketed by hash. Keys known to be frequent live in runs of their own: each new
batch merge-anti-joins those and adds only the rest. Keys that a run proves frequent move over at once. When a level
holds ``FAN`` runs they are compacted into one run of the next level, and sums that reach the threshold move over.
All runs share their bucketing, so these joins and compactions move no rows between machines.

Afterwards the lines of all documents meet the frequent keys. That set is broadcast when it has been counted to be
small, and joined by hash otherwise. What comes back are positions to drop, gathered per distinct text, from which
the kept stretches of each text are sliced.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import drop_path, fresh_path, store
from tidemark.sources.tables import pick

#: Batches at least, the bytes of input (as Spark estimates them) that one takes, and runs of a level that are compacted.
BATCHES, BATCH_BYTES, FAN = 4, 1 << 38, 2
#: Frequent keys up to this number (16 bytes each) are broadcast.
BROADCAST_KEYS = 200_000
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case. ``lower`` does the same for texts that are all ASCII, far faster than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bare(line: Column) -> Column:
    """The line without ASCII white space at its ends."""
    return F.btrim(line, F.lit(STRIPPED))


def hashed(key: Column) -> Column:
    """128 bits of a string as a struct of two longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def batches_for(docs: DataFrame) -> int:
    """How many batches a table takes: by its size, so that no run outgrows ``BATCH_BYTES``; few where it is not known."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return BATCHES if size >= 1 << 60 else max(BATCHES, -(-size // BATCH_BYTES))


class LineRuns:
    """The runs of one job, in the shared folder."""

    def __init__(self, spark, min_docs: int) -> None:
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.frequent: list[DataFrame] = []
        self.tables: dict[str, str] = {}

    def _run(self, df: DataFrame) -> DataFrame:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        writer = df.repartition(self.buckets, "h1").sortWithinPartitions("h1", "h2").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2")
        self.tables[name] = fresh_path(self.spark, "line-run")
        writer.option("compression", "zstd").option("path", self.tables[name]).saveAsTable(name)
        return self.spark.table(name)

    def _settle(self, level: int, counts: DataFrame) -> None:
        """Write counts as a run of a level; keys that reach the threshold go to a frequent run instead."""
        run = self._run(counts)
        self.frequent.append(run.where(F.col("n") >= self.min_docs).select("h1", "h2"))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run.where(F.col("n") < self.min_docs))

    def _compact(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Take in a batch's counts ``h1, h2, n``."""
        for known in self.frequent:
            counts = counts.join(known.hint("merge"), ["h1", "h2"], "left_anti")
        self._settle(0, counts)
        level = 0
        while len(self.levels[level]) >= FAN:
            runs, self.levels[level] = self.levels[level], []
            self._settle(level + 1, self._compact(runs))
            level += 1

    def finish(self) -> DataFrame:
        """All frequent keys ``h1, h2``, each once."""
        left = [run for level in self.levels for run in level]
        if len(left) > 1:
            self.levels = []
            self._settle(0, self._compact(left))
        return reduce(DataFrame.unionByName, self.frequent).distinct()

    def drop(self) -> None:
        """Remove all runs, once nothing reads them any more."""
        for name, path in self.tables.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)
        self.tables.clear()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_points: int = 1, batches: int | None = None) -> DataFrame:
    """Drop lines whose key is found in at least ``min_docs`` documents, in every document.

    Returns one row per input row: ``doc_id, n_lines, n_dropped, kept_text``. Keys shorter than ``min_points`` code
    points are never dropped. Null and empty texts are one empty line. Every row counts as a document, also when an id
    is null or repeats; a key counts once per document. An empty table gives an empty result; other columns are
    ignored.
    """
    spark, batches = docs.sparkSession, batches or batches_for(docs)
    rows = pick(docs, [(id_col, "doc_id"), (text_col, "text")]).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.split("text", "\n")
    # Distinct as strings: Spark hashes those within a row, but compares structs pair by pair. Arrays are made in a step
    # before they are exploded: what stands beside an explode is evaluated again for every line.
    listed = rows.select(F.pmod(F.xxhash64("doc_id", F.char_length("text")), F.lit(batches)).alias("batch"), F.array_distinct(F.transform(F.split(folded(F.col("text")), "\n"), bare)).alias("keys"))
    keys = listed.select("batch", F.explode_outer("keys").alias("key"))
    keys = keys.where(F.char_length("key") >= min_points).select("batch", hashed(F.col("key")).alias("h"))
    staged = store(keys.groupBy("batch", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n")), "line-counts")
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        runs.add(staged.where(F.col("batch") == batch).select("h1", "h2", "n"))
    frequent = store(runs.finish(), "line-frequent")
    runs.drop()

    text_hash = hashed(F.col("text"))
    placed = rows.select(text_hash.alias("t"), F.split(folded(F.col("text")), "\n").alias("folded")).select("t", F.posexplode_outer("folded").alias("at", "line")).select("t", "at", hashed(bare(F.col("line"))).alias("h"))
    placed = placed.select("t", "at", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    small = frequent.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    hits = placed.join(F.broadcast(frequent) if small else frequent, ["h1", "h2"])
    drops = hits.groupBy("t").agg(F.array_sort(F.collect_set("at")).alias("drops"))
    joined = rows.withColumn("t", text_hash).join(drops, "t", "left").select("doc_id", lines.alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    starts = F.concat(F.array(F.lit(0)), F.transform("drops", lambda x: x + 1))
    ends = F.concat("drops", F.array(F.size("lines")))
    parts = F.zip_with(starts, ends, lambda s, e: F.slice("lines", s + 1, e - s))
    kept = F.when(F.size("drops") > 0, F.array_join(F.flatten(parts), "\n")).otherwise(F.array_join("lines", "\n"))
    return joined.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.size("drops").cast("bigint").alias("n_dropped"), kept.alias("kept_text"))
