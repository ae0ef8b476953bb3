"""Runs over listed tenders: what becomes of each, the log of each run, the counters of each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcomes(found: DataFrame, sources: DataFrame, stored: DataFrame) -> DataFrame:
    """``found`` with outcome: ``no-source``, ``inactive``, ``existing``, ``failed``, ``filtered`` or ``created``.

    ``found`` has source, run, place (runs and places follow one another), lot_id, fetched (whether its
    page could be read) and fits (whether the source wants it); ``sources``: source, is_active; ``stored``:
    source, lot_id of tenders there already. A lot that an earlier row of its source creates exists for the
    rows behind it. Null flags are false; a null lot is never stored, so each is created anew.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    known = sources.groupBy("source").agg(F.max(flag("is_active")).alias("_active"))
    old = stored.select("source", "lot_id").distinct().withColumn("_old", F.lit(True))
    rows = found.join(known, "source", "left").join(old, ["source", "lot_id"], "left")
    good = F.coalesce(F.col("_active"), F.lit(False)) & F.col("_old").isNull() & flag("fetched") & flag("fits")
    before = Window.partitionBy("source", "lot_id").orderBy("run", "place").rowsBetween(Window.unboundedPreceding, -1)
    made = F.col("lot_id").isNotNull() & F.coalesce(F.max(good).over(before), F.lit(False))
    what = (
        F.when(F.col("_active").isNull(), "no-source").when(~F.col("_active"), "inactive").when(F.col("_old").isNotNull() | made, "existing")
        .when(~flag("fetched"), "failed").when(~flag("fits"), "filtered").otherwise("created")
    )
    return rows.withColumn("outcome", what).drop("_active", "_old")


def run_log(judged: DataFrame) -> DataFrame:
    """source, run, status, found, done, failed, created of each run of an active source; error names the failed lots.

    ``done`` counts all that did not fail, stored before or not. A run with failures is ``partial``.
    """
    of = lambda name: F.count_if(F.col("outcome") == name)
    failed = F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == "failed", F.struct("place", "lot_id")))), lambda x: F.concat(F.lit("Tender "), F.coalesce(x.lot_id.cast("string"), F.lit("?")), F.lit(": Failed to fetch tender detail")))
    log = judged.filter(~F.col("outcome").isin("no-source", "inactive")).groupBy("source", "run").agg(F.count("*").alias("found"), of("failed").alias("failed"), of("created").alias("created"), failed.alias("_errors"))
    status = F.when(F.col("failed") > 0, "partial").otherwise("success")
    return log.select("source", "run", status.alias("status"), "found", (F.col("found") - F.col("failed")).alias("done"), "failed", "created", F.nullif(F.array_join("_errors", "\n"), F.lit("")).alias("error"))


def counters(log: DataFrame) -> DataFrame:
    """source, total_scrapes, successful_scrapes, failed_scrapes, last_run, last_status over all logged runs."""
    good: Column = F.col("status") == "success"
    last = F.max(F.struct("run", "status"))
    out = log.groupBy("source").agg(F.count("*").alias("total_scrapes"), F.count_if(good).alias("successful_scrapes"), F.count_if(~good).alias("failed_scrapes"), last.alias("l"))
    return out.select("source", "total_scrapes", "successful_scrapes", "failed_scrapes", F.col("l.run").alias("last_run"), F.col("l.status").alias("last_status"))
