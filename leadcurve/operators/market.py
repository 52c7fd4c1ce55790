"""Daily market: the cheapest quote per route, flight date, lead day and stop type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.constants import CURVE_KEYS, MIN_CURVE_DAYS
from leadcurve.functions.dates import day_of_week
from leadcurve.functions.keys import route_key
from leadcurve.operators import clean
from leadcurve.operators.quantiles import ranked_quantiles, weighted_quantiles

DAILY_KEYS = ["startingAirport", "destinationAirport", "flightDate", "searchDate", "isNonStop"]


def _precounted(quotes: DataFrame) -> DataFrame:
    """Equal-distance quotes of a daily group folded together, mostly before the shuffle."""
    return quotes.groupBy(*DAILY_KEYS, "totalTravelDistance").agg(
        F.min("totalFare").alias("low"), F.count(F.lit(1)).alias("n")
    )


def _collapsed(counted: DataFrame) -> DataFrame:
    return weighted_quantiles(
        counted,
        DAILY_KEYS,
        "totalTravelDistance",
        "n",
        {"totalTravelDistance": 0.5},
        extra=[F.min("low").alias("best_fare"), F.sum("n").alias("offers_observed")],
    )


def _shaped(daily: DataFrame) -> DataFrame:
    return daily.select(
        "startingAirport",
        "destinationAirport",
        "flightDate",
        F.datediff("flightDate", "searchDate").alias("days_before_departure"),
        day_of_week(F.col("flightDate")).alias("departure_day_of_week"),
        F.month("flightDate").alias("departure_month"),
        day_of_week(F.col("searchDate")).alias("search_day_of_week"),
        "isNonStop",
        "totalTravelDistance",
        "best_fare",
        "offers_observed",
    )


def daily_best_fare(cleaned: DataFrame) -> DataFrame:
    """Daily table of an already cleaned quote table. A missing stop type is a group of its own."""
    return _shaped(_collapsed(_precounted(cleaned)))


def daily_from_offers(offers: DataFrame) -> DataFrame:
    """Daily table straight from raw quotes.

    Quotes are folded per distance before missing distances are filled, so the
    raw rows meet no join: they are aggregated where they are read.
    """
    kept = clean.accepted(clean.typed_offers(offers))
    medians = clean.route_distances(kept)
    filled = clean.impute_distance(_precounted(kept), medians)
    upper = filled.withColumns({c: F.upper(c) for c in clean.ROUTE_ENDS})
    return _shaped(_collapsed(upper))


def daily_market(offers: DataFrame) -> DataFrame:
    """Daily table of the backtest: lenient reading, rows with a missing key left out."""
    kept = clean.lenient_offers(offers).dropna(subset=DAILY_KEYS)
    daily = _collapsed(_precounted(kept))
    return daily.select(
        *DAILY_KEYS,
        F.datediff("flightDate", "searchDate").alias("days_before_departure"),
        "best_fare",
        "totalTravelDistance",
        route_key().alias("route"),
        day_of_week(F.col("flightDate")).alias("departure_day_of_week"),
        F.month("flightDate").alias("departure_month"),
        day_of_week(F.col("searchDate")).alias("search_day_of_week"),
    )


def with_market_columns(daily: DataFrame) -> DataFrame:
    """Add ``searchDate`` and ``route`` to a daily table that lacks them."""
    if "searchDate" not in daily.columns:
        daily = daily.withColumn("searchDate", F.date_sub("flightDate", F.col("days_before_departure")))
    if "route" not in daily.columns:
        daily = daily.withColumn("route", route_key())
    return daily


def table_stats(daily: DataFrame) -> DataFrame:
    daily = with_market_columns(daily)
    return daily.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("route").alias("routes"),
        F.min("searchDate").alias("search_date_min"),
        F.max("searchDate").alias("search_date_max"),
    )


def stop_counts(daily: DataFrame) -> DataFrame:
    rows, nonstop = F.count(F.lit(1)), F.count_if(F.col("isNonStop"))
    return daily.agg(
        rows.alias("rows"), nonstop.alias("nonstop_rows"), (rows - nonstop).alias("connecting_rows")
    )


def lookup_counts(daily: DataFrame) -> DataFrame:
    """How often each best fare and each distance occurs per route.

    Both lookups need only this table; store it to read the daily table once.
    """
    measures = F.expr(
        "inline(array(named_struct('measure', 'fare', 'value', best_fare),"
        " named_struct('measure', 'distance', 'value', totalTravelDistance)))"
    )
    known = with_market_columns(daily).select("route", measures)
    return known.dropna().groupBy("route", "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def route_lookups(counts: DataFrame) -> DataFrame:
    """Per route: median distance and median best fare, for serving."""
    medians = ranked_quantiles(counts, ["route", "measure"], "value", "n", {"median": 0.5})
    return medians.groupBy("route").agg(
        F.expr("max(CASE WHEN measure = 'distance' THEN median END) AS route_distance"),
        F.expr("max(CASE WHEN measure = 'fare' THEN median END) AS route_median_fare"),
    )


def global_lookups(counts: DataFrame) -> DataFrame:
    """One row with the two global medians."""
    totals = counts.groupBy("measure", "value").agg(F.sum("n").alias("n"))
    medians = ranked_quantiles(totals, ["measure"], "value", "n", {"median": 0.5})
    return medians.agg(
        F.expr("max(CASE WHEN measure = 'fare' THEN median END) AS global_median_fare"),
        F.expr("max(CASE WHEN measure = 'distance' THEN median END) AS global_median_distance"),
    )


def curve_lengths(daily: DataFrame, at_least: int = MIN_CURVE_DAYS) -> DataFrame:
    """Number of observed lead days per curve, for curves long enough to score."""
    daily = with_market_columns(daily).dropna(subset=["route", "flightDate", "isNonStop"])
    sizes = daily.groupBy("route", "flightDate", "isNonStop").agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("n") >= at_least)


def stop_collapse(daily: DataFrame) -> DataFrame:
    """Cheapest of the stop types per route, flight date and lead day.

    The distance is that of the cheapest row. As in the default panel the result
    counts as a connecting curve.
    """
    row = F.min(F.struct("best_fare", F.col("isNonStop").alias("stop"), "totalTravelDistance"))
    keys = [
        "startingAirport",
        "destinationAirport",
        "flightDate",
        "days_before_departure",
        "departure_day_of_week",
        "departure_month",
        "search_day_of_week",
    ]
    return daily.groupBy(*keys).agg(row.alias("row")).select(
        *keys,
        F.lit(False).alias("isNonStop"),
        F.col("row.best_fare").alias("best_fare"),
        F.col("row.totalTravelDistance").alias("totalTravelDistance"),
    )


def complete_curves(daily: DataFrame) -> DataFrame:
    """Rows whose curve keys are all known; joins and curves see only these."""
    return daily.dropna(subset=list(CURVE_KEYS))
