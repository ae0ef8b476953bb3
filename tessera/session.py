"""A Spark session with the settings the operators expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "tessera", **settings: str) -> SparkSession:
    """``settings`` use underscores for dots and win over SETTINGS."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder the cluster shares, so that loops don't grow its plan."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


#: Bytes up to which a table is sent to all executors.
SENT_BYTES = 16 << 20


def sent(df: DataFrame) -> DataFrame:
    """``df`` to be joined: broadcast if its rows have SENT_BYTES at most, else sorted and merged.

    The planner's own guess does not know how many rows a list spreads into, so without a word
    from here it may broadcast the side that grows.
    """
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if size + 64 * rows <= SENT_BYTES else df.hint("merge")
