"""Operators whose state feeds back: folds over sorted rows, one Arrow pass, state carried from batch to batch.

Rows are dealt by tenant and sorted on disk if need be; a task holds one batch of rows and one tenant's state, never a
tenant's rows. A tenant with a third of all rows makes one long task, as its state is one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def folded(events: DataFrame, columns: list[str], start: Callable[[], Callable[..., tuple]], made: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``tenant, event_id`` and the columns of ``made``: what a tenant's step function gives for each row, in time order.

    ``start`` makes the step function of a tenant; it keeps the tenant's state and sees ``columns`` of one row at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, step, begun = None, None, False
        for batch in batches:
            tenants, values = batch.column(0).to_pylist(), [batch.column(k).to_pylist() for k in range(2, batch.num_columns)]
            out = []
            for name, *row in zip(tenants, *values, strict=True):
                if not begun or name != tenant:
                    tenant, step, begun = name, start(), True
                out.append(step(*row))
            made_columns = zip(*out, strict=True) if out else [()] * len(made)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, kind) for c, (_, kind) in zip(made_columns, made.values(), strict=True))], ["tenant", "event_id", *made])

    types = {c: events.schema[c].dataType.simpleString() for c in ("tenant", "event_id")}
    rows = events.repartition("tenant").sortWithinPartitions("tenant", "micros", "event_id").select("tenant", "event_id", *columns)
    return rows.mapInArrow(run, ", ".join([f"{c} {t}" for c, t in types.items()] + [f"{c} {t}" for c, (t, _) in made.items()]))


def risk_budget(events: DataFrame, allowance: int, window_micros: int) -> DataFrame:
    """``tenant, event_id, accepted, spent``: an event is accepted if the accepted ones of the window leave room for it."""

    def start() -> Callable[..., tuple]:
        taken: deque[tuple[int, int]] = deque()
        spent = 0

        def step(now: int, points: int) -> tuple[bool, int]:
            nonlocal spent
            while taken and taken[0][0] <= now - window_micros:
                spent -= taken.popleft()[1]
            ok = spent + points <= allowance
            if ok:
                taken.append((now, points))
                spent += points
            return ok, spent

        return step

    return folded(events, ["micros", "points"], start, {"accepted": ("boolean", pa.bool_()), "spent": ("bigint", pa.int64())})


def token_bucket(events: DataFrame, per_minute: float, burst: float) -> DataFrame:
    """``tenant, event_id, allowed`` under a bucket that refills at ``per_minute`` / 60 a second up to ``burst``."""

    def start() -> Callable[..., tuple]:
        level, last = burst, None

        def step(now: int) -> tuple[bool]:
            nonlocal level, last
            if last is not None:
                level = min(burst, level + (now - last) / 1e6 * per_minute / 60)
            last = now
            allowed = level >= 1
            level -= allowed
            return (allowed,)

        return step

    return folded(events, ["micros"], start, {"allowed": ("boolean", pa.bool_())})


def smoothed(events: DataFrame, alpha: float = 0.4) -> DataFrame:
    """``tenant, event_id, level``: exponential moving average of ``points`` in time order."""

    def start() -> Callable[..., tuple]:
        level = None

        def step(points: float) -> tuple[float]:
            nonlocal level
            level = float(points) if level is None else alpha * points + (1 - alpha) * level
            return (level,)

        return step

    return folded(events, ["points"], start, {"level": ("double", pa.float64())})


def forecasts(events: DataFrame, alpha: float = 0.4, window: int = 90, coverage: float = 0.9) -> DataFrame:
    """``tenant, event_id, forecast, width``: what the moving average foretells for each row, and the width of its interval.

    The width is the order statistic int(c (n + 1) - 1) of the last ``window`` residuals' sizes; the first row of a tenant has
    neither, the second no width.
    """

    def start() -> Callable[..., tuple]:
        level, residuals = None, deque(maxlen=window)

        def step(points: float) -> tuple[float | None, float | None]:
            nonlocal level
            if level is None:
                level = float(points)
                return None, None
            told, ordered = level, sorted(residuals)
            width = ordered[max(0, min(len(ordered) - 1, int(coverage * (len(ordered) + 1) - 1)))] if ordered else None
            residuals.append(abs(points - level))
            level = alpha * points + (1 - alpha) * level
            return told, width

        return step

    return folded(events, ["points"], start, {"forecast": ("double", pa.float64()), "width": ("double", pa.float64())})
