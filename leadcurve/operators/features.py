"""Model features; one set of expressions for training, backtest and serving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.functions.dates import day_of_week, is_weekend, near_holiday
from leadcurve.functions.fares import log_fare
from leadcurve.functions.keys import route_key


def departure_features(rows: DataFrame) -> DataFrame:
    """Features of the flight alone: worked out once, before its lead days unfold."""
    dow = day_of_week(F.col("flightDate"))
    return rows.withColumns(
        {
            "departure_day_of_week": dow,
            "departure_month": F.month("flightDate"),
            "departure_is_weekend": is_weekend(dow),
            "near_holiday": near_holiday("flightDate"),
        }
    )


def attach_features(rows: DataFrame) -> DataFrame:
    """Add the derived features to rows that hold lead day, as-of day and current fare.

    ``route_cat`` is the route's name. Which names a model knows is part of the
    fitted model: an unknown one is treated as missing there.
    """
    if "route" not in rows.columns:
        rows = rows.withColumn("route", route_key())
    if "is_nonstop" not in rows.columns:
        rows = rows.withColumn("is_nonstop", F.col("isNonStop"))
    derived = {
        "route_cat": F.col("route"),
        "is_nonstop": F.col("is_nonstop").cast("boolean"),
        "log_current_fare": log_fare(F.col("current_fare")),
    }
    if "departure_is_weekend" not in rows.columns:
        derived["departure_is_weekend"] = is_weekend(F.col("departure_day_of_week"))
    if "near_holiday" not in rows.columns:
        derived["near_holiday"] = near_holiday("flightDate")
    return rows.withColumns(derived)
