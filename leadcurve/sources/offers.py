"""Reading quote tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadcurve.constants import BACKTEST_COLUMNS, OFFER_COLUMNS

BROKEN = "_broken_line"  # a line that does not fit the header, as it stands in the file


def require_columns(
    columns: Iterable[str],
    required: Iterable[str] = OFFER_COLUMNS,
    subject: str = "Raw dataset",
) -> list[str]:
    """The sorted columns; raises if a required one is missing. Looks at the schema only."""
    present = set(columns)
    missing = sorted(set(required) - present)
    if missing:
        raise ValueError(f"{subject} is missing required columns: {', '.join(missing)}")
    return sorted(present)


def require_backtest_columns(columns: Iterable[str]) -> list[str]:
    return require_columns(columns, BACKTEST_COLUMNS, "Backtest data")


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a CSV table as text columns by its header, and ``BROKEN``: the line itself where it does not fit.

    The parser marks such lines while it reads, so good and broken ones come from one pass.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, BROKEN)])
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", BROKEN).csv(path)


def fitting(lines: DataFrame) -> DataFrame:
    """The lines that have a value, or an empty one, for each column."""
    # Spark refuses a query of the broken lines alone, so a count must read a column as well; this holds for every line
    read = [F.coalesce(F.length(c), F.lit(0)) >= 0 for c in lines.columns if c != BROKEN][:1]
    return lines.filter(reduce(and_, read, F.col(BROKEN).isNull())).drop(BROKEN)


def broken_count() -> Column:
    return F.count_if(F.col(BROKEN).isNotNull())


def rejected_lines(lines: DataFrame) -> DataFrame:
    """``line`` and ``reason`` of the lines that do not fit: an open quote, too few or too many values."""
    width = len(lines.columns) - 1
    line = F.col(BROKEN)
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    values = F.size(F.split(F.regexp_replace(line, '"[^"]*"', ""), ","))
    reason = F.when(quotes % 2 == 1, "open quote").when(values < width, "short").when(values > width, "long").otherwise("unreadable")
    # Spark tells broken lines only to queries that read a column as well; this holds for every line
    read = F.length(F.concat_ws("", *[c for c in lines.columns if c != BROKEN])) >= 0
    return lines.filter(line.isNotNull() & read).select(line.alias("line"), reason.alias("reason"))


def load_offers(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Quotes from Parquet or CSV, by suffix unless ``fmt`` says which.

    CSV columns are found by header and stay text: typing happens in cleaning, so
    the file is not read once more to guess types. Lines that do not fit the header are
    left out; ``rejected_lines`` of ``csv_lines`` has them.
    """
    kind = fmt or kind_of(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return fitting(csv_lines(spark, path))
    raise ValueError(f"unknown format: {kind}")


def kind_of(path: str) -> str:
    return "parquet" if path.rstrip("/").endswith(".parquet") else "csv"
