"""Named tables below one folder, tolerant of missing tables and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_or_empty(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> tuple[DataFrame, bool]:
    """The table, or no rows of ``schema`` and True if it has not been set up."""
    try:
        return table(spark, folder, name), False
    except AnalysisException:
        return spark.createDataFrame([], schema), True


def first_present(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """The first non-null of those ``names`` that ``df`` has; null if it has none."""
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*present).cast(kind) if present else F.lit(None).cast(kind)


def missing(spark: SparkSession, folder: str, required: dict[str, Sequence[str]]) -> DataFrame:
    """table_name, column_name of every required table (column null) or column that is not there."""
    gone: list[tuple[str, str | None]] = []
    for name, columns in required.items():
        try:
            have = set(table(spark, folder, name).columns)
        except AnalysisException:
            gone.append((name, None))
            continue
        gone += [(name, c) for c in columns if c not in have]
    return spark.createDataFrame(gone, "table_name string, column_name string")


def append_valid(rows: DataFrame, path: str, identifier: str) -> None:
    """Appends rows whose identifier is a whole number above 0; the others are left out, as logging must not fail."""
    whole = F.when(F.trim(F.col(identifier).cast("string")).rlike(r"^\d{1,18}$"), F.trim(F.col(identifier).cast("string")).cast("long"))
    rows.withColumn(identifier, whole).filter(F.col(identifier) > 0).write.mode("append").parquet(path)
