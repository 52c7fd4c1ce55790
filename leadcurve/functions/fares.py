"""Fare expressions: relative fare, log fare, clipping, money rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadcurve.constants import FARE_CEILING, FARE_FLOOR, RELATIVE_MAX, RELATIVE_MIN


def fare_in_range(fare: Column) -> Column:
    return (fare > F.lit(FARE_FLOOR)) & (fare < F.lit(FARE_CEILING))


def clip_relative(rel: Column) -> Column:
    return F.least(F.lit(RELATIVE_MAX), F.greatest(F.lit(RELATIVE_MIN), rel))


def relative_fare(future: Column, current: Column) -> Column:
    """Later fare as a multiple of today's. ``current`` must be positive."""
    return clip_relative(F.try_divide(future, current))


def log_fare(fare: Column) -> Column:
    return F.log(F.greatest(fare.cast("double"), F.lit(1.0)))


def cents(amount: Column) -> Column:
    """Two decimals: the nearest whole number of cents, ties to even."""
    return F.rint(amount * 100) / 100
