"""Curves as rows: one row per (route, flight date, stop type) with its points in an array.

A daily table holds one row per curve and lead day, so the array is bounded by
the booking horizon, not by the number of quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadcurve.constants import CURVE_KEYS
from leadcurve.operators.market import complete_curves


def build_curves(daily: DataFrame) -> DataFrame:
    """Points sorted by lead day, largest first (time order)."""
    point = F.struct(
        F.col("days_before_departure").alias("day"),
        F.col("best_fare").alias("fare"),
        F.col("totalTravelDistance").alias("distance"),
    )
    points = F.sort_array(F.collect_list(point), asc=False)
    return complete_curves(daily).groupBy(*CURVE_KEYS).agg(points.alias("points"))


def nearest_day(points: Column, target: int | Column, prefer_larger: bool) -> Column:
    """Observed lead day closest to ``target``; ``prefer_larger`` decides between equals."""
    sign = -1 if prefer_larger else 1
    gaps = F.transform(
        points,
        lambda p: F.struct(
            F.abs(p["day"] - target).alias("gap"), (p["day"] * sign).alias("order"), p["day"].alias("day")
        ),
    )
    return F.array_min(gaps)["day"]


def point_at(points: Column, day: Column) -> Column:
    return F.try_element_at(F.filter(points, lambda p: p["day"] == day), F.lit(1))


def remaining(points: Column, as_of: Column) -> Column:
    """The part of the curve from the as-of day to departure."""
    return F.filter(points, lambda p: p["day"] <= as_of)


def median_so_far(points: Column, as_of: Column) -> Column:
    """Median fare of everything seen up to and including the as-of day."""
    fares = F.array_sort(
        F.transform(F.filter(points, lambda p: p["day"] >= as_of), lambda p: p["fare"])
    )
    n = F.size(fares)
    low = F.try_element_at(fares, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(fares, F.floor(n / 2).cast("int") + 1)
    return (low + high) / 2
