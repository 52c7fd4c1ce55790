"""Chronological splits by distinct dates.

Distinct dates are bounded by the calendar, so ranking them in one task is safe
at any data size; the rows themselves are only filtered. A bound reaches the
filter as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadcurve.constants import SEED, TRAIN_FRACTION, VALIDATION_FRACTION
from leadcurve.functions.keys import decision_id
from leadcurve.operators.market import with_market_columns
from leadcurve.operators.sampling import hash_sample


def ranked_dates(df: DataFrame, column: str) -> DataFrame:
    """Distinct dates with their 0-based position and their number."""
    everything = Window.partitionBy(F.lit(0))
    dates = df.select(F.col(column).alias("day")).dropna().distinct()
    return dates.select(
        "day",
        (F.row_number().over(everything.orderBy("day")) - 1).alias("position"),
        F.count(F.lit(1)).over(everything).alias("dates"),
    )


def _date_at(position: Column) -> Column:
    return F.max(F.when(F.col("position") == position, F.col("day")))


def split_cutoffs(
    df: DataFrame, column: str, train: float = TRAIN_FRACTION, validation: float = VALIDATION_FRACTION
) -> DataFrame:
    """One row: the first validation date and the first test date."""
    place = lambda f: F.floor(F.col("dates") * F.lit(f))
    return ranked_dates(df, column).agg(
        _date_at(place(train)).alias("train_cutoff"),
        _date_at(place(validation)).alias("test_cutoff"),
    )


def period_bounds(daily: DataFrame, start: float, end: float) -> DataFrame:
    """One row: first date of a period and the date it ends before (null if open)."""
    first = F.least(F.col("dates") - 1, F.floor(F.col("dates") * F.lit(start)))
    return ranked_dates(with_market_columns(daily), "searchDate").agg(
        _date_at(first).alias("period_start"),
        _date_at(F.floor(F.col("dates") * F.lit(end))).alias("period_end"),
        F.count(F.lit(1)).alias("dates"),
    )


def within(day: Column, bounds: DataFrame, start: str, end: str) -> Column:
    """Condition that ``day`` lies in the half-open period of a one-row table."""
    last = bounds.select(end).scalar()
    return (day >= bounds.select(start).scalar()) & (last.isNull() | (day < last))


def chrono_split(pairs: DataFrame, cutoffs: DataFrame, column: str = "as_of_date") -> DataFrame:
    """Label each pair ``train``, ``validation`` or ``test`` by its as-of date."""
    day = F.col(column)
    train, test = cutoffs.select("train_cutoff").scalar(), cutoffs.select("test_cutoff").scalar()
    part = F.when(day < train, "train").when(day < test, "validation").otherwise("test")
    return pairs.filter(day.isNotNull()).withColumn("part", part)


def validation_days(daily: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Daily rows searched between the two cutoffs."""
    daily = with_market_columns(daily)
    return daily.filter(within(F.col("searchDate"), cutoffs, "train_cutoff", "test_cutoff"))


def held_out_days(daily: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Daily rows searched from the second cutoff on."""
    daily = with_market_columns(daily)
    return daily.filter(F.col("searchDate") >= cutoffs.select("test_cutoff").scalar())


def pair_sample(pairs: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """At most ``size`` pairs, the same ones on every run."""
    ties = ["route", "flightDate", "isNonStop", "as_of_days", "days_before_departure"]
    name = decision_id(F.col("route"), F.col("flightDate"), F.col("isNonStop"), F.col("as_of_days"))
    key = F.concat_ws("|", name, F.col("days_before_departure").cast("string"), F.lit(str(seed)))
    return hash_sample(pairs, F.md5(key), size, ties)


def curve_sample(lengths: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """At most ``size`` curves of a curve-length table."""
    stop = F.when(F.col("isNonStop"), "True").otherwise("False")
    key = F.concat_ws("|", "route", F.date_format("flightDate", "yyyy-MM-dd"), stop, F.lit(str(seed)))
    return hash_sample(lengths, F.md5(key), size, ["route", "flightDate", "isNonStop"])


def rows_of_curves(daily: DataFrame, curves: DataFrame) -> DataFrame:
    """Daily rows that belong to the given curves."""
    keys = ["route", "flightDate", "isNonStop"]
    return with_market_columns(daily).join(curves.select(*keys), keys, "left_semi")

