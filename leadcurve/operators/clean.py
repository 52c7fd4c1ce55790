"""Quote cleaning: typing, acceptance rules, distance imputation, quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leadcurve.functions.dates import day_of_week
from leadcurve.functions.fares import fare_in_range
from leadcurve.operators.quantiles import exact_median
from leadcurve.session import stage

ROUTE_ENDS = ["startingAirport", "destinationAirport"]


def typed_offers(offers: DataFrame) -> DataFrame:
    """The nine quote columns in their types. A value that cannot be read becomes null.

    Airports keep the source's letter case here; see ``impute_distance``.
    """
    return offers.select(
        F.col("searchDate").try_cast("date").alias("searchDate"),
        F.col("flightDate").try_cast("date").alias("flightDate"),
        F.col("startingAirport").cast("string").alias("startingAirport"),
        F.col("destinationAirport").cast("string").alias("destinationAirport"),
        F.col("totalFare").try_cast("double").alias("totalFare"),
        F.col("isNonStop").try_cast("boolean").alias("isNonStop"),
        # a count written as a decimal number is rounded, half to even
        F.bround(F.col("seatsRemaining").try_cast("double")).try_cast("int").alias("seatsRemaining"),
        F.col("totalTravelDistance").try_cast("double").alias("totalTravelDistance"),
        F.col("isBasicEconomy").try_cast("boolean").alias("isBasicEconomy"),
    )


def bad_fare() -> Column:
    return F.coalesce(~fare_in_range(F.col("totalFare")), F.lit(True))


def bad_dates(same_day: bool = False) -> Column:
    search, flight = F.col("searchDate"), F.col("flightDate")
    if same_day:
        return F.coalesce(flight < search, F.lit(False))
    return F.coalesce(flight <= search, F.lit(True))


def accepted(typed: DataFrame, same_day: bool = False) -> DataFrame:
    """Quotes with a usable fare, a flight after (or, if asked, on) the search day, and sane seats."""
    seats, search, flight = F.col("seatsRemaining"), F.col("searchDate"), F.col("flightDate")
    return typed.filter(
        fare_in_range(F.col("totalFare"))
        & ((flight >= search) if same_day else (flight > search))
        & (seats.isNull() | (seats >= 0))
    )


def route_distances(quotes: DataFrame) -> DataFrame:
    """Median distance per route, staged, so that joining it is broadcast only if small."""
    medians = exact_median(quotes, ROUTE_ENDS, "totalTravelDistance", "route_distance")
    return stage(medians, "route-distances")


def impute_distance(quotes: DataFrame, medians: DataFrame) -> DataFrame:
    """Fill missing distances with the median of the route as the source spells it."""
    filled = F.coalesce("totalTravelDistance", "route_distance")
    return (
        quotes.join(medians, ROUTE_ENDS, "left")
        .withColumn("totalTravelDistance", filled)
        .drop("route_distance")
    )


def with_calendar(quotes: DataFrame) -> DataFrame:
    return quotes.select(
        "*",
        F.datediff("flightDate", "searchDate").alias("days_before_departure"),
        day_of_week(F.col("flightDate")).alias("departure_day_of_week"),
        F.month("flightDate").alias("departure_month"),
        day_of_week(F.col("searchDate")).alias("search_day_of_week"),
    )


def finish_clean(kept: DataFrame, upper: bool = True) -> DataFrame:
    """Accepted quotes with imputed distance and calendar columns."""
    filled = impute_distance(kept, route_distances(kept))
    if upper:
        filled = filled.withColumns({c: F.upper(c) for c in ROUTE_ENDS})
    return with_calendar(filled.select(*kept.columns))


def clean_offers(offers: DataFrame, same_day: bool = False, upper: bool = True) -> DataFrame:
    """Accepted, typed quotes with imputed distance and calendar columns.

    Rows are needed twice: for the route medians (a small table) and themselves, unshuffled
    while the medians are small. Text is parsed once: its rows are stored typed before the
    rules apply, as Spark would parse a value again for each rule that names it. A typed
    source is read twice, the first time three columns of it and those of the rules, which
    costs less than a copy.
    """
    typed = typed_offers(offers)
    text = isinstance(offers.schema["totalFare"].dataType, StringType)
    return finish_clean(accepted(stage(typed, "typed") if text else typed, same_day), upper)


def quality_profile(offers: DataFrame, same_day: bool = False) -> DataFrame:
    """One row of counts from a single pass. Categories may overlap."""
    return typed_offers(offers).agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(bad_fare()).alias("invalid_fares"),
        F.count_if(bad_dates(same_day)).alias("invalid_dates"),
        F.count_if(F.col("seatsRemaining") < 0).alias("invalid_seats"),
        F.count_if(F.col("totalTravelDistance").isNull()).alias("missing_distance"),
    )


def _accepted_count(same_day: bool) -> Column:
    seats = F.col("seatsRemaining")
    ok = ~bad_fare() & (seats.isNull() | (seats >= 0))
    dated = F.col("searchDate").isNotNull() & F.col("flightDate").isNotNull()
    return F.count_if(ok & dated & ~bad_dates(same_day))


def profile_counts() -> list[Column]:
    """The profile's aggregates over typed quotes."""
    total, kept = F.count(F.lit(1)), _accepted_count(False)
    return [
        total.alias("input_rows"),
        kept.alias("accepted_rows"),
        (total - kept).alias("rejected_rows"),
        F.count_if(bad_fare()).alias("invalid_fares"),
        F.count_if(bad_dates()).alias("invalid_dates"),
        F.count_if(F.col("seatsRemaining") < 0).alias("invalid_seats"),
        F.count_if(F.col("totalTravelDistance").isNull()).alias("missing_distance_imputed"),
    ]


def clean_profile(offers: DataFrame) -> DataFrame:
    """The quality counts with accepted and rejected rows, in one pass."""
    return typed_offers(offers).agg(*profile_counts())


def cleaning_impact(offers: DataFrame) -> DataFrame:
    """Effect of each same-day cleaning rule, rows kept and the share dropped."""
    total, kept = F.count(F.lit(1)), _accepted_count(True)
    return typed_offers(offers).agg(
        total.alias("total_rows"),
        F.count_if(bad_fare()).alias("bad_fare_rows"),
        F.count_if(bad_dates(same_day=True)).alias("bad_date_rows"),
        F.count_if(F.col("seatsRemaining") < 0).alias("bad_seats_rows"),
        F.count_if(F.col("totalTravelDistance").isNull()).alias("missing_distance_rows"),
        kept.alias("rows_after"),
        (total - kept).alias("rows_dropped"),
        (F.try_divide(total - kept, total) * 100).alias("dropped_percent"),
    )


def lenient_offers(offers: DataFrame) -> DataFrame:
    """The backtest's reading of quotes: unreadable values become null, then bad rows go.

    Airports keep their letter case and seats are not looked at.
    """
    text = F.lower(F.col("isNonStop").cast("string"))
    read = offers.select(
        F.col("searchDate").try_cast("date").alias("searchDate"),
        F.col("flightDate").try_cast("date").alias("flightDate"),
        "startingAirport",
        "destinationAirport",
        F.col("totalFare").try_cast("double").alias("totalFare"),
        F.when(text == "true", True).when(text == "false", False).alias("isNonStop"),
        F.col("totalTravelDistance").try_cast("double").alias("totalTravelDistance"),
    )
    return read.filter(
        fare_in_range(F.col("totalFare")) & (F.col("searchDate") < F.col("flightDate"))
    )
