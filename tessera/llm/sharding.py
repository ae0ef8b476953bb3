"""Weighted rendezvous sharding of records by a stable key.

Every (key, shard) pair gets a pseudo-random number u in (0, 1); a record goes to the
shard with the largest ``-weight / ln(u)``. The choice depends on the key and the shard
weights alone, so a shard added later takes records only into itself, and a shard
removed gives away only its own.

Only DataFrame functions are used. Slots are numbered without sending a shard to one
task: records are ranked inside (shard, cell), and cells get running offsets from
their counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import copies

#: Records per cell, on average, when slots are numbered.
ROWS_PER_CELL = 4096


def draw(key: Column, shard: int, seed: str = "") -> Column:
    """u in (0, 1) for a key and a shard: 52 bits of md5 over ``seed|key|shard``."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key, F.lit(f"|{shard}")))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float], seed: str = "") -> Column:
    """The number of the shard that wins ``key``; equal scores go to the smaller number.

    A weight of zero gives its shard nothing. A null key is the key ``''``.
    """
    if not weights or all(w <= 0 for w in weights):
        raise ValueError("at least one shard needs a weight above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scored = [
        F.struct((-F.lit(float(w)) / F.ln(draw(text, i, seed))).alias("score"), F.lit(-i).alias("shard"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["shard"]).cast("int")


def with_slots(df: DataFrame, group: str, order: Sequence[Column], slot: str = "slot", cells: int | None = None) -> DataFrame:
    """Number the rows of each group from 0 without a gap, in the order of cells and ``order``.

    Rows that ``order`` cannot tell apart are interchangeable. The number of cells follows
    the row count, so no window partition grows with the table. Rows equal in all columns are
    counted before they meet and get their numbers afterwards.
    """
    if cells is None:
        cells = max(1, df.count() // ROWS_PER_CELL)
    names = df.columns
    rows = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells))).groupBy(*names, "_cell").agg(F.count("*").alias("_m"))
    counts = rows.groupBy(group, "_cell").agg(F.sum("_m").alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_g"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_rank", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    joined = ranked.join(offsets, ranked[group].eqNullSafe(offsets["_g"]) & (ranked["_cell"] == offsets["_c"]), "left")
    return copies(joined, "_m", "_i").select(*names, (F.col("_before") + F.col("_rank") + F.col("_i")).alias(slot))


def shard(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    grown: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    seed: str = "",
) -> DataFrame:
    """Place every record: the key, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard.

    ``grown`` is the weight list with shards added; by default one more of the last weight.
    Null text has size 1 and the checksum of no bytes; a null key is placed as ``''``;
    repeated rows land together, each with its own slot; an empty table gives no rows.
    Other columns of ``docs`` play no part.
    """
    grown = [*weights, weights[-1]] if grown is None else list(grown)
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights, seed).alias("shard"),
        rendezvous(F.col(key), grown, seed).alias("grown_shard"),
    )
    order = [F.col(key), F.col("text_crc32"), F.col("size")]
    numbered = with_slots(placed, "shard", order, cells=max(1, docs.count() // ROWS_PER_CELL))
    return numbered.select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
