"""Streams of the stateful operators: counters by window, lockouts, queue transitions, new content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(requests: DataFrame, scope: list[str], time: str = "ts", unit: str = "1 minute", late: str = "10 minutes", most: int | None = None) -> DataFrame:
    """Requests by scope and tumbling window, with over_limit if ``most`` is given.

    Time must be a timestamp; one without a zone is taken as UTC.
    """
    timed = requests.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    counts = timed.groupBy(F.window("_time", unit), *scope).agg(F.count("*").alias("n"))
    out = counts.select(F.col("window.start").alias("window_start"), *scope, "n")
    return out.withColumn("over_limit", F.col("n") > most) if most is not None else out


def _attempts(most: int, seconds: float, idle_ms: int | None) -> Callable:
    def step(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, n = state.get if state.exists else (0.0, 0)
        rows = []
        for at in sorted(at for page in pages for at in page["ts"]):  # one key's times in one micro-batch
            now = at.timestamp()
            if n == 0 or now - first >= seconds:
                first, n = now, 0
            n += 1
            rows.append((key[0], at, n, n >= most))
        state.update((first, n))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["key", "ts", "attempt", "locked"])

    return step


def lockouts(attempts: DataFrame, most: int = 5, seconds: float = 900, idle_seconds: float | None = None) -> DataFrame:
    """key, ts, attempt, locked of each attempt, counted from a key's first one in a window.

    Attempts of a micro-batch are counted in order of time. With ``idle_seconds``, for queries
    that run on and on, a key that sends nothing for so long is forgotten.
    """
    idle_ms = int(1000 * max(idle_seconds, seconds)) if idle_seconds else None
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    step = _attempts(most, seconds, idle_ms)
    return attempts.groupBy("key").applyInPandasWithState(
        step, "key long, ts timestamp, attempt int, locked boolean", "first double, n int", "append", timeout
    )


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a pure transition on every micro-batch of what is there now, once each."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Rows whose key was not seen within the watermark: an enqueue by idempotency key."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within)
    return timed.dropDuplicatesWithinWatermark([key])
