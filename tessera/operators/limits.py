"""Rate limits and lockouts over logs of requests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_limit(requests: DataFrame, scope: list[str], time: str, unit: str, most: int, order: list[Column], name: str = "allowed") -> DataFrame:
    """The first ``most`` requests of each scope and calendar minute, hour or day are allowed.

    Only the place of the last one allowed is found - Spark keeps ``most`` rows a window in every
    task before it deals them out - and then joined back, so a busy scope is not sorted as a
    whole. ``order`` must tell rows apart; rows that it can't are allowed together.
    """
    keyed = requests.withColumn("_window", F.date_trunc(unit, time)).withColumn("_place", F.struct(*order))
    own = Window.partitionBy(*scope, "_window").orderBy("_place")
    first = keyed.select(*scope, "_window", "_place").withColumn("_rank", F.row_number().over(own)).filter(F.col("_rank") <= most)
    keys = [*scope, "_window"]
    last = first.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.max("_place").alias("_last"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    joined = keyed.join(last, same, "left").withColumn(name, F.coalesce(F.col("_place") <= F.col("_last"), F.lit(False)))
    return joined.select(*requests.columns, name)


def budget_limit(requests: DataFrame, scope: list[str], time: str, unit: str, cost: str, budget: float, order: list[Column], name: str = "within_budget") -> DataFrame:
    """Requests whose scope and window have not spent more than ``budget`` with them."""
    own = Window.partitionBy(*scope, F.date_trunc(unit, time)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return requests.withColumn(name, F.sum(F.col(cost).cast("decimal(18,4)")).over(own) <= F.lit(budget).cast("decimal(18,4)"))


def _fold(most: int, seconds: float):
    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first, n = object(), None, 0  # rows of a key follow each other: one counter is open
        for page in pages:
            counts = []
            for key, ts in zip(page["key"], page["ts"], strict=True):
                if key != last or (ts - first).total_seconds() >= seconds:
                    last, first, n = key, ts, 0
                n += 1
                counts.append((n, n >= most))
            page[["attempt", "locked"]] = pd.DataFrame(counts, index=page.index, columns=["attempt", "locked"])
            yield page[["key", "id", "ts", "attempt", "locked"]]

    return run


def lockout(attempts: DataFrame, most: int = 5, seconds: float = 900) -> DataFrame:
    """key, id, ts, attempt, locked: attempts counted in windows that start with a key's first one.

    A window starts with the first attempt outside the last window, so its place depends on
    all attempts before. Keys are dealt to partitions, rows stream through by key and time and one
    counter is open at a time.
    """
    dealt = attempts.select("key", "id", "ts").repartition("key").sortWithinPartitions("key", "ts", "id")
    return dealt.mapInPandas(_fold(most, seconds), "key long, id long, ts timestamp_ntz, attempt int, locked boolean")


def active_seconds(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The length of the union of each key's spans, in seconds."""
    order = Window.partitionBy(key).orderBy(start, end)
    seen = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = spans.withColumn("_new", F.coalesce(F.col(start) > seen, F.lit(True)).cast("int"))
    island = gap.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = island.groupBy(key, "_island").agg(F.min(start).alias("s"), F.max(end).alias("e"))
    seconds = (F.unix_micros(F.col("e").cast("timestamp")) - F.unix_micros(F.col("s").cast("timestamp"))) / F.lit(1e6)
    return merged.groupBy(key).agg(F.sum(seconds.cast("decimal(20,3)")).cast("double").alias("active_seconds"), F.count("*").alias("islands"))
