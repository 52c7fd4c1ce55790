"""Writing tables, records and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_market(df: DataFrame, path: str, mode: str = "overwrite", by_month: bool = True) -> None:
    """Parquet (zstd), one folder per flight month.

    The rebalance hint gives each month few, evenly sized files: adaptive execution
    splits a month that holds much of the data and merges small ones.
    """
    writer_input = df
    if by_month:
        month = F.date_format("flightDate", "yyyy-MM")
        writer_input = df.withColumn("flight_month", month).hint("rebalance", "flight_month")
    writer = writer_input.write.mode(mode).option("compression", "zstd")
    if by_month:
        writer = writer.partitionBy("flight_month")
    writer.parquet(path)


def refresh_months(df: DataFrame, path: str) -> None:
    """Replace the flight months that ``df`` holds, and no others; writing the same rows again changes nothing."""
    month = F.date_format("flightDate", "yyyy-MM")
    rows = df.withColumn("flight_month", month).hint("rebalance", "flight_month")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "zstd").partitionBy("flight_month").parquet(path)


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The flight months from ``first`` to ``last`` ("2022-05"); other months' folders are not read."""
    # months stay text: a folder name that looks like a date would be read as one
    stored = spark.read.parquet(path)
    return stored.filter(F.col("flight_month").cast("string").between(first, last)).drop("flight_month")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet (zstd) without partition folders: pairs, lookups."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_decisions(decisions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; files are written in parallel."""
    decisions.write.mode(mode).option("header", True).csv(path)


def write_record(record: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small result (a profile, figures per policy) as one JSON-lines file."""
    record.coalesce(1).write.mode(mode).json(path)
