"""Exploration of cleaned quotes: busiest routes and dates, averages, correlations.

``route_day_rollup`` folds the quotes once; the other operators read the rollup,
so the quotes are not scanned again for every question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUTE = ["startingAirport", "destinationAirport"]


def route_day_rollup(cleaned: DataFrame) -> DataFrame:
    fare = F.col("totalFare")
    return cleaned.groupBy(*ROUTE, "flightDate", "days_before_departure").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(fare).alias("fare_sum"),
        F.sum(fare * fare).alias("fare_square_sum"),
        F.min(fare).alias("min_fare"),
        F.max(fare).alias("max_fare"),
    )


def top_routes(rollup: DataFrame, count: int = 5) -> DataFrame:
    """Routes with the most quotes; equal counts go by route name."""
    totals = rollup.groupBy(*ROUTE).agg(F.sum("n").alias("n"))
    return totals.orderBy(F.desc("n"), *ROUTE).limit(count)


def lead_day_average(rollup: DataFrame, routes: DataFrame, max_lead: int = 60) -> DataFrame:
    """Average fare per lead day of the given routes."""
    chosen = rollup.join(routes.select(*ROUTE), ROUTE, "left_semi")
    near = chosen.filter(F.col("days_before_departure").between(0, max_lead))
    return near.groupBy(*ROUTE, "days_before_departure").agg(
        (F.sum("fare_sum") / F.sum("n")).alias("avg_fare")
    )


def busiest_flight_dates(rollup: DataFrame) -> DataFrame:
    """Per route the flight date with the most quotes; the earliest wins a tie."""
    per_date = rollup.groupBy(*ROUTE, "flightDate").agg(F.sum("n").alias("n"))
    return per_date.groupBy(*ROUTE).agg(
        F.max(F.struct("n", (-F.unix_date("flightDate")).alias("k"))).alias("top")
    ).select(*ROUTE, F.date_from_unix_date(-F.col("top.k")).alias("flightDate"), F.col("top.n").alias("n"))


def flight_trajectory(rollup: DataFrame, flights: DataFrame) -> DataFrame:
    """Cheapest fare per lead day of the given flights (route and date)."""
    keys = [*ROUTE, "flightDate"]
    chosen = rollup.join(flights.select(*keys), keys, "left_semi")
    return chosen.groupBy(*keys, "days_before_departure").agg(F.min("min_fare").alias("min_fare"))


def lead_fare_correlation(rollup: DataFrame, routes: DataFrame) -> DataFrame:
    """Correlation of lead day and fare per route; null where either does not vary."""
    chosen = rollup.join(routes.select(*ROUTE), ROUTE, "left_semi")
    lead, n = F.col("days_before_departure").cast("double"), F.col("n")
    sums = chosen.groupBy(*ROUTE).agg(
        F.sum(n).cast("double").alias("n"),
        F.sum(n * lead).alias("x"),
        F.sum(n * lead * lead).alias("xx"),
        F.sum("fare_sum").alias("y"),
        F.sum("fare_square_sum").alias("yy"),
        F.sum(lead * F.col("fare_sum")).alias("xy"),
        (F.min("min_fare") < F.max("max_fare")).alias("fare_varies"),
        (F.min(lead) < F.max(lead)).alias("lead_varies"),
    )
    covariance = F.expr("n * xy - x * y")
    spread = F.sqrt(F.expr("n * xx - x * x")) * F.sqrt(F.expr("n * yy - y * y"))
    defined = F.col("fare_varies") & F.col("lead_varies")
    return sums.select(*ROUTE, F.when(defined, F.try_divide(covariance, spread)).alias("corr"))
