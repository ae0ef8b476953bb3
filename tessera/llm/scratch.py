"""Tables that cut lineage, kept in the folder the cluster shares.

A lost executor must not cost more than its own tasks, so every intermediate that a
job reads twice is written as Parquet below ``spark.checkpoint.dir`` and read back.
The folders are removed when the interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only under a local master."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_folder, "local"):
        shared_folder.local = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return shared_folder.local


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the shared folder and read back with its own schema."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes up to which a written table is sent to all executors.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of numbers and digests, to be broadcast if it has BROADCAST_BYTES at most.

    A column of such a table takes 16 bytes.
    """
    return F.broadcast(df) if df.count() * 16 * len(df.columns) <= BROADCAST_BYTES else df


#: Copies of a row that are listed at once.
COPIES = 4096


def copies(df: DataFrame, count: str, number: str) -> DataFrame:
    """Every row ``count`` times, with ``number`` from 0 on instead of the count; lists of COPIES at most are made."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {COPIES}"))).alias("_part")
    cut = F.sequence(F.col("_part") * COPIES, F.least(F.col(count), (F.col("_part") + 1) * COPIES) - 1)
    return df.select("*", part).withColumn(number, F.explode(cut)).drop("_part", count)


#: Bytes of texts in one Arrow batch.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lets this session's Arrow batches end at BATCH_BYTES where it has Spark's default of 64 MiB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session is gone; whoever owns the folder clears it
            return
