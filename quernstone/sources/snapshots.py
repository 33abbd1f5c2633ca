"""Snapshots by date, partition index, retention, and partitioned writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import period_key

#: Smaller datasets are written in one piece.
PARTITION_ROWS = 10_000
RECENT_DAYS = 90


def as_of_snapshot(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """Rows of the newest snapshot up to a date; a scalar first, so that partitions are pruned."""
    newest = df.filter(F.col(column) <= F.lit(as_of).cast("date")).agg(F.max(column)).first()[0]
    return df.filter(F.col(column) == F.lit(newest)) if newest is not None else df.limit(0)


def partition_index(df: DataFrame, date: str) -> DataFrame:
    """Rows, first and last date of each quarter."""
    return df.filter(F.col(date).isNotNull()).groupBy(period_key(F.col(date), "quarter").alias("quarter")).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last")
    )


def pruned_snapshots(df: DataFrame, column: str, keep: int = 30) -> DataFrame:
    """Snapshots beyond the newest ``keep``."""
    rank = F.row_number().over(Window.orderBy(F.desc(column)))
    dates = df.select(column).distinct()
    return dates.withColumn("__n", rank).filter(F.col("__n") > keep).select(F.col(column).alias("snapshot"))


def write_partitioned(df: DataFrame, path: str, date: str = "date", least: int = PARTITION_ROWS) -> None:
    """By quarter from ``least`` rows on, else in one piece."""
    quartered = df.withColumn("quarter", period_key(F.col(date), "quarter"))
    if df.limit(least).count() >= least:
        quartered.write.mode("overwrite").partitionBy("quarter").parquet(path)
    else:
        df.coalesce(1).write.mode("overwrite").parquet(path)


def recent(df: DataFrame, as_of: str, date: str = "date", days: int = RECENT_DAYS) -> DataFrame:
    return df.filter(F.col(date) > F.date_sub(F.lit(as_of).cast("date"), days))


def write_snapshot(df: DataFrame, path: str, day: str) -> None:
    """A full copy under ``snapshot_date``; a day written twice is replaced."""
    df.withColumn("snapshot_date", F.lit(day).cast("date")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("snapshot_date").parquet(path)


def read_snapshot(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    return as_of_snapshot(spark.read.parquet(path), "snapshot_date", as_of).drop("snapshot_date")
