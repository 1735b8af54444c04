"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Plans that reuse a result write it there as Parquet and read it
back: lineage ends at durable files, so a lost executor costs only the tasks that read them, and the shuffle files
behind a written table go at once. Where the setting is absent and all runs in one process (tests on one machine), a
temporary folder is made and used; on a cluster that is an error, as executors could not read each other's files.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
#: Spark's own switch: shuffle files of a finished execution are removed.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share; the master is {master}")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_here(spark: SparkSession) -> Iterator[None]:
    """Within: shuffle files of an execution go when it ends. For executions whose result is in files."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def store(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or ``path``) and read it back with the same schema."""
    spark = df.sparkSession
    path = path or fresh_path(spark, tag)
    with shuffles_end_here(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one job that can be dropped by name before the job ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, tuple[str, str | None]] = {}

    def store(self, df: DataFrame, tag: str) -> DataFrame:
        """A plain table."""
        path = fresh_path(self.spark, tag)
        self.paths[tag] = (path, None)
        return store(df, tag, path)

    def bucketed(self, df: DataFrame, tag: str, by: str, sort: Sequence[str] = ()) -> DataFrame:
        """A table bucketed by a column, so that joins and groups on it move no rows of the table."""
        name, path = f"tidemark_{uuid.uuid4().hex}", fresh_path(self.spark, tag)
        self.paths[tag] = (path, name)
        writer = df.write.bucketBy(self.buckets, by).sortBy(*(sort or (by,)))
        with shuffles_end_here(self.spark):
            writer.option("compression", "zstd").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def drop(self, *tags: str) -> None:
        """Remove these tables, or all, once nothing reads them any more."""
        for tag in tags or tuple(self.paths):
            path, name = self.paths.pop(tag)
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)
