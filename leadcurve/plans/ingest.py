"""Ingest: raw quotes to the stored clean table, daily table and profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadcurve.operators import clean, market
from leadcurve.session import owned_stages, stage
from leadcurve.sources import offers as source
from leadcurve.sources import sinks


def ingest(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    profile_path: str | None = None,
    rejects_path: str | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """Write the cleaned quotes and their profile; returns the profile row.

    Lines of a CSV file that do not fit its header are counted as ``broken_lines`` and, with
    ``rejects_path``, written there with the reason.

    The raw file is parsed once. The accepted quotes are stored typed, the profile is
    counted on the way, and what follows reads the stored columns. That first step has
    no shuffle, so a lost executor repeats whole tasks and no row is counted twice.
    """
    lines = None
    if (fmt or source.kind_of(input_path)) == "csv":
        lines, broken = source.csv_lines(spark, input_path), Observation("broken")
        raw = source.fitting(lines.observe(broken, source.broken_count().alias("broken_lines")))
    else:
        raw = source.load_offers(spark, input_path, fmt)
    source.require_columns(raw.columns)
    seen = Observation("profile")
    typed = clean.typed_offers(raw).observe(seen, *clean.profile_counts())
    with owned_stages(spark):
        kept = stage(clean.accepted(typed), "accepted")
        sinks.write_market(clean.finish_clean(kept), output_path)
    found = {**seen.get, **(broken.get if lines is not None else {"broken_lines": 0})}
    if lines is not None and rejects_path:
        sinks.write_table(source.rejected_lines(lines), rejects_path)
    counts = [F.lit(value).cast("bigint").alias(name) for name, value in found.items()]
    profile = spark.range(1).select(
        F.lit(input_path).alias("source"), F.lit(output_path).alias("output"), *counts
    )
    where = profile_path or f"{output_path.rstrip('/').removesuffix('.parquet')}.profile"
    sinks.write_record(profile, where)
    return spark.read.json(where)


def build_daily_table(spark: SparkSession, input_path: str, output_path: str) -> DataFrame:
    """Write the daily table of a stored clean table; returns its size, routes and dates."""
    sinks.write_market(market.daily_best_fare(spark.read.parquet(input_path)), output_path)
    return market.table_stats(spark.read.parquet(output_path))
