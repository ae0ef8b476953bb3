"""A leased work queue as pure transitions: (state, ...) -> new state.

State columns: id, status (queued, processing, done, failed, cancelled), priority,
available_at, created_at, attempts, max_attempts, owner, lease_until, cancel_requested,
finished_at. Nothing is locked: one writer applies one transition at a time, in batch
or inside ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import backoff

TERMINAL = ("done", "failed", "cancelled")


def expired(as_of: Column) -> Column:
    return (F.col("status") == "processing") & (F.col("lease_until") <= as_of)


def reap(state: DataFrame, as_of: Column) -> DataFrame:
    """Jobs that were asked to stop, and expired jobs without attempts left, end."""
    stop = F.col("cancel_requested") & (F.col("status").isin("queued") | expired(as_of))
    spent = expired(as_of) & (F.col("attempts") >= F.col("max_attempts"))
    ended = F.when(stop, "cancelled").when(spent, "failed")
    return state.withColumns(
        {
            "finished_at": F.when(ended.isNotNull(), as_of).otherwise(F.col("finished_at")),
            "owner": F.when(ended.isNull(), F.col("owner")),
            "lease_until": F.when(ended.isNull(), F.col("lease_until")),
            "status": F.coalesce(ended, F.col("status")),
        }
    )


def claimable(as_of: Column) -> Column:
    ready = (F.col("status") == "queued") & (F.col("available_at") <= as_of)
    return (ready | expired(as_of)) & (F.col("attempts") < F.col("max_attempts")) & ~F.col("cancel_requested")


def claim(state: DataFrame, as_of: Column, owner: str, most: int, lease: str = "90 seconds") -> DataFrame:
    """The first ``most`` claimable jobs by priority and age go to ``owner``, one attempt on.

    The pick is a top-k, so only ``most`` ids meet the state again.
    """
    order = [F.desc("priority"), F.col("available_at"), F.col("created_at"), F.col("id")]
    picked = state.filter(claimable(as_of)).orderBy(*order).limit(most).select("id", F.lit(True).alias("picked"))
    joined = state.join(picked, "id", "left")
    got = F.coalesce("picked", F.lit(False))
    out = joined.withColumns(
        {
            "status": F.when(got, "processing").otherwise(F.col("status")),
            "attempts": F.col("attempts") + got.cast("int"),
            "owner": F.when(got, owner).otherwise(F.col("owner")),
            "lease_until": F.when(got, as_of + F.expr(f"interval {lease}")).otherwise(F.col("lease_until")),
        }
    )
    return out.select(*state.columns)


def owned(as_of: Column) -> Column:
    """Whether an event (owner ``by``) may still change its job."""
    return (F.col("status") == "processing") & (F.col("owner") == F.col("by")) & (F.col("lease_until") > as_of)


def apply_events(state: DataFrame, events: DataFrame, as_of: Column, lease: str = "90 seconds") -> DataFrame:
    """heartbeat, complete, fail and cancel, one an id (columns id, op, by).

    The first three count only from the owner under a valid lease. A failed job is queued
    again after min(300, 5 * 2 ** (attempts - 1)) seconds while it has attempts left; a cancel
    ends a queued job and asks a running one to stop.
    """
    joined = state.join(events, "id", "left")
    own = F.coalesce(owned(as_of), F.lit(False))
    op = lambda name: F.coalesce(F.col("op") == name, F.lit(False))
    done, fail, beat = own & op("complete"), own & op("fail"), own & op("heartbeat")
    retry = fail & (F.col("attempts") < F.col("max_attempts")) & ~F.col("cancel_requested")
    dropped = op("cancel") & (F.col("status") == "queued")
    ended = F.when(done, "done").when(fail & F.col("cancel_requested"), "cancelled").when(fail & ~retry, "failed").when(dropped, "cancelled")
    leaves = ended.isNotNull() | retry
    out = joined.withColumns(
        {
            "available_at": F.when(retry, as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff(F.col("attempts")))).otherwise(F.col("available_at")),
            "cancel_requested": F.col("cancel_requested") | (op("cancel") & (F.col("status") == "processing")),
            "finished_at": F.when(ended.isNotNull(), as_of).otherwise(F.col("finished_at")),
            "lease_until": F.when(leaves, F.lit(None)).when(beat, as_of + F.expr(f"interval {lease}")).otherwise(F.col("lease_until")),
            "owner": F.when(~leaves, F.col("owner")),
            "status": F.when(ended.isNotNull(), ended).when(retry, "queued").otherwise(F.col("status")),
        }
    )
    return out.select(*state.columns)


def enqueue(state: DataFrame, jobs: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """New jobs join the state once a key; keys that are there already change nothing."""
    fresh = jobs.dropDuplicates([key]).join(state.select(key), key, "left_anti")
    return state.unionByName(fresh, allowMissingColumns=True)


def mirrored(domain: DataFrame, queue: DataFrame) -> DataFrame:
    """Domain rows (task_id, status) with the final state of their queue row, if it has one."""
    final = queue.filter(F.col("status").isin(*TERMINAL)).select(F.col("id").cast("string").alias("task_id"), F.col("status").alias("final"))
    out = domain.join(final, "task_id", "left")
    return out.withColumn("status", F.when(~F.col("status").isin(*TERMINAL) & F.col("final").isNotNull(), F.col("final")).otherwise(F.col("status"))).drop("final")


def swept(df: DataFrame, time: str, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """What is kept, and one row with how many rows older than ``days`` go."""
    old = F.coalesce(F.col(time) < as_of - F.expr(f"interval {days} days"), F.lit(False))
    return df.filter(~old), df.agg(F.count_if(old).alias("deleted"))
