"""Scrape runs as a stream: each micro-batch once, whatever is repeated.

A batch writes its tenders and its log below folders named after the batch, replacing what an
earlier try of it left, and then a line in the ledger. Only batches in the ledger are seen, and a batch
looks at batches before it alone, so one that is tried again, after its ledger line or before, finds
what it found the first time and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.scraping import outcomes, run_log
from tessera.streaming.limits import each_batch

TENDERS, LOG, LEDGER = "tenders", "log", "ledger"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def committed(spark: SparkSession, folder: str, table: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of ``table`` of all batches in the ledger, or of those before one."""
    if not _exists(spark, f"{folder}/{LEDGER}"):
        return spark.createDataFrame([], schema)
    done = spark.read.schema("batch long").parquet(f"{folder}/{LEDGER}")
    done = done.filter(F.col("batch") < before) if before is not None else done
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{folder}/{table}").parquet(f"{folder}/{table}")
    return rows.join(F.broadcast(done.distinct()), "batch", "left_semi").drop("batch")


def apply_batch(found: DataFrame, batch: int, sources: DataFrame, folder: str, kinds: str) -> None:
    """One micro-batch of listed tenders (columns of outcomes(); ``kinds`` their types) into the tables below ``folder``."""
    spark = found.sparkSession
    stored = committed(spark, folder, TENDERS, kinds, before=batch)
    judged = outcomes(found, sources, stored)
    judged.filter("outcome = 'created'").select(*found.columns).write.mode("overwrite").parquet(f"{folder}/{TENDERS}/batch={batch}")
    log = run_log(judged)
    log.write.mode("overwrite").parquet(f"{folder}/{LOG}/batch={batch}")
    spark.range(batch, batch + 1).select(F.col("id").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{LEDGER}/of={batch}")


def scrape(stream: DataFrame, sources: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs over all that ``stream`` lists until now; ``sources`` are read anew for every batch."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    return each_batch(stream, lambda df, n: apply_batch(df, n, sources, folder, kinds), checkpoint)
