"""Remaining pairs: every as-of day of a curve with each same or later day.

Each curve is gathered once and unfolded, instead of joining the daily table to
itself. A curve has one point per lead day, so the number of pairs is bounded by
the booking horizon.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadcurve.constants import CURVE_KEYS, DECISION_DAYS
from leadcurve.functions.dates import day_of_week
from leadcurve.functions.fares import relative_fare
from leadcurve.functions.keys import route_key
from leadcurve.operators.curves import build_curves, remaining


def first_or_target_days(days: Sequence[int] = DECISION_DAYS) -> Callable[[Column, Column], Column]:
    """Anchor rule: the earliest observation of the curve, or one of the given lead days."""
    return lambda points, p: (p["day"] == points[0]["day"]) | p["day"].isin(*days)


def strided_days(stride: int = 2) -> Callable[[Column, Column], Column]:
    """Anchor rule: every ``stride``-th lead day, and each of the last seven."""
    if stride <= 1:
        return lambda points, p: F.lit(True)
    return lambda points, p: (p["day"] % stride == 0) | (p["day"] <= 7)


def asof_anchors(daily: DataFrame, rule: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row per curve and as-of day chosen by ``rule``, with the curve's points."""
    rule = rule or first_or_target_days()
    points = F.col("points")
    anchors = F.filter(points, lambda p: rule(points, p))
    unfolded = build_curves(daily).withColumn("anchor", F.explode(anchors))
    return unfolded.select(
        route_key().alias("route"),
        *CURVE_KEYS,
        F.date_sub("flightDate", F.col("anchor.day")).alias("as_of_date"),
        F.col("anchor.day").alias("as_of_days"),
        F.col("anchor.fare").alias("current_fare"),
        F.col("anchor.distance").alias("totalTravelDistance"),
        "points",
    )


def remaining_pairs(daily: DataFrame, rule: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Training pairs with the later fare relative to the as-of fare, clipped."""
    anchors = asof_anchors(daily, rule).filter(F.col("current_fare") > 1)
    later = remaining(F.col("points"), F.col("as_of_days"))
    rows = anchors.withColumn("later", F.explode(later))
    return rows.select(
        "route",
        *CURVE_KEYS,
        "as_of_date",
        "as_of_days",
        F.col("later.day").alias("days_before_departure"),
        "current_fare",
        F.col("later.fare").alias("future_fare"),
        relative_fare(F.col("later.fare"), F.col("current_fare")).alias("rel_fare"),
        day_of_week(F.col("flightDate")).alias("departure_day_of_week"),
        F.month("flightDate").alias("departure_month"),
        day_of_week(F.date_sub("flightDate", F.col("later.day"))).alias("search_day_of_week"),
        "totalTravelDistance",
    )


def strided_pairs(daily: DataFrame, as_of_stride: int = 2) -> DataFrame:
    """Pairs from every ``as_of_stride``-th lead day, without route and as-of date."""
    return remaining_pairs(daily, strided_days(as_of_stride)).drop("route", "as_of_date")
