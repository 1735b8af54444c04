"""Live forms: event-time windows with watermarks, and the halting monitor with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.shared import fresh_path


def windowed_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Events and errors by event-time window and type; rows later than ``late`` are past their window."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = stamped.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def live_halts(tokens: DataFrame, hard: int = 200) -> DataFrame:
    """One row per session and trigger: tokens emitted so far and whether the session has halted for good.

    A session halts at its first token below ``hard``; nothing after it is emitted, in whatever trigger it comes. Tokens
    of a trigger count in the order of ``idx``, however Arrow cuts them and in whatever order the pieces come: the places
    of those not yet beyond a halt are kept until the session's pieces are read, 8 bytes each.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        emitted, halted = state.get if state.exists else (0, False)
        first, before = None, []
        for rows in batches:
            if halted:
                continue
            at, low = rows["idx"].to_numpy(), (rows["milli"] < hard).to_numpy()
            if low.any() and (first is None or at[low].min() < first):
                first = at[low].min()
                before = [x[x < first] for x in before]
            before.append(at if first is None else at[at < first])
        emitted, halted = emitted + sum(map(len, before)), bool(halted or first is not None)
        state.update((emitted, halted))
        yield pd.DataFrame({"session": [key[0]], "n_emitted": [emitted], "halted": [halted]})

    return tokens.groupBy("session").applyInPandasWithState(run, "session bigint, n_emitted bigint, halted boolean", "n_emitted bigint, halted boolean", "update", GroupStateTimeout.NoTimeout)


def run_to_files(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now, and read back the rows that it put out.

    Each micro-batch is written under its number, over what an earlier try of the same batch left, so a batch that is
    repeated after a loss counts once. State and progress live in the shared folder.
    """
    spark = stream.sparkSession
    root = fresh_path(spark, tag)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows/batch=*")


def reviewed(pairs_stream: DataFrame, review: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """A review queue: every micro-batch of pairs is scored in one pass, whatever tenants are in it.

    ``review`` takes and returns rows of a batch; with a processing-time trigger on the stream it would run as often.
    """
    return run_to_files(review(pairs_stream), tag)
