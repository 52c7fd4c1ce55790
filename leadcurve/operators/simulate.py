"""Booking simulation: decisions on past days, paid at fares that were really observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadcurve import constants as C
from leadcurve.constants import CURVE_KEYS
from leadcurve.functions.dates import day_of_week
from leadcurve.functions.keys import decision_id, route_key, stable_uniform
from leadcurve.operators.curves import build_curves, median_so_far, nearest_day, point_at, remaining
from leadcurve.operators.features import attach_features, departure_features
from leadcurve.operators.sampling import hash_sample
from leadcurve.operators.scorers import Scorer
from leadcurve.operators.split import within
from leadcurve.session import spread, stage


def decision_candidates(
    daily: DataFrame,
    bounds: DataFrame,
    routes: DataFrame | None = None,
    decision_days: Sequence[int] = C.DECISION_DAYS,
    max_decisions: int | None = None,
) -> DataFrame:
    """Booking decisions of a period, each with its curve's points.

    ``routes`` (column ``route``) are the routes that count. Over a market that is stored in
    folders by route only theirs are read, and over one in buckets of the curve keys no
    row is shuffled (``session.stage_bucketed``).

    Per curve the observed day nearest to each decision day is taken once. The
    curve needs three points, two of them from the decision on. With
    ``max_decisions`` the decisions that come first by hashed id are kept.
    """
    if "route" not in daily.columns:
        daily = daily.withColumn("route", route_key())
    if routes is not None:  # before curves are built: the known routes are few and staged small
        known = stage(routes.select("route").distinct(), "known-routes")
        # Spark prunes folders at run time only by a list that is filtered itself
        daily = daily.join(known.filter("route > ''"), "route", "left_semi")
    curves = build_curves(daily).withColumn("route", route_key())
    points, as_of = F.col("points"), F.col("as_of_days")
    nearest = [nearest_day(points, t, prefer_larger=True) for t in decision_days]
    rows = (
        curves.filter(F.size(points) >= 3)
        .withColumn("as_of_days", F.explode(F.array_distinct(F.array(*nearest))))
        .withColumn("search_date", F.date_sub("flightDate", as_of))
        .filter(within(F.col("search_date"), bounds, "period_start", "period_end"))
        .filter(F.size(remaining(points, as_of)) >= 2)
    )
    candidates = rows.select(
        decision_id(F.col("route"), F.col("flightDate"), F.col("isNonStop"), as_of).alias("decision_id"),
        "route",
        *CURVE_KEYS,
        "search_date",
        "as_of_days",
        point_at(points, as_of)["fare"].alias("current_fare"),
        median_so_far(points, as_of).alias("trailing_median_fare"),
        "points",
    )
    if max_decisions is None:
        return candidates
    return hash_sample(candidates, F.sha2("decision_id", 256), max_decisions, ["decision_id"])


def unfold_remaining(rows: DataFrame) -> DataFrame:
    """One feature row per decision (or as-of curve) and remaining day."""
    later = remaining(F.col("points"), F.col("as_of_days"))
    unfolded = departure_features(rows).withColumn("later", F.explode(later)).drop("points")
    day = F.col("later.day")
    return unfolded.withColumns(
        {
            "days_before_departure": day,
            "best_fare": F.col("later.fare"),
            "totalTravelDistance": F.col("later.distance"),
            "search_day_of_week": day_of_week(F.date_sub("flightDate", day)),
        }
    ).drop("later")


def action(wait: Column) -> Column:
    return F.when(wait, "WAIT").otherwise("BUY")


def simulate(
    candidates: DataFrame, scorer: Scorer, minimum_savings: float = C.MEANINGFUL_SAVINGS
) -> DataFrame:
    """One row per decision: what the model, each baseline and the oracle do and save.

    Decisions are spread by id before they unfold, so scoring runs in parallel and
    every later step of a decision stays in its partition.
    """
    rows = spread(candidates, "decision_id")
    scored = scorer(attach_features(unfold_remaining(rows)))
    decision = Window.partitionBy("decision_id")
    today = F.col("days_before_departure") == F.col("as_of_days")
    priced = scored.withColumn(
        "today_relative", F.max(F.when(today, F.col("predicted_relative"))).over(decision)
    ).withColumn(
        "predicted_fare",
        F.col("predicted_relative")
        / F.greatest(F.col("today_relative"), F.lit(1e-9))
        * F.col("current_fare"),
    )
    about = [
        "route",
        "flightDate",
        "search_date",
        "isNonStop",
        "as_of_days",
        "current_fare",
        "trailing_median_fare",
    ]
    days = F.col("days_before_departure")
    # negated days put the larger lead day (the earlier date) first among equal fares
    best = F.min(F.struct("predicted_fare", (-days).alias("order"), "best_fare"))
    # grouped by id alone, the rows keep the order the window gave them
    chosen = priced.groupBy("decision_id").agg(
        F.first(F.struct(*about)).alias("about"),
        best.alias("best"),
        F.min("best_fare").alias("lowest_fare"),
        F.min(F.struct(days.alias("day"), "best_fare")).alias("last"),
    )
    current = F.col("current_fare")
    facts = chosen.select("decision_id", "about.*", "best", "lowest_fare", "last").select(
        "decision_id",
        "route",
        F.col("flightDate").alias("flight_date"),
        "search_date",
        F.col("isNonStop").alias("is_nonstop"),
        "as_of_days",
        "current_fare",
        "trailing_median_fare",
        (-F.col("best.order")).alias("predicted_purchase_days"),
        (current - F.col("best.predicted_fare")).alias("predicted_savings"),
        F.col("best.best_fare").alias("wait_paid_fare"),
        (current - F.col("last.best_fare")).alias("always_wait_savings"),
        (current - F.col("lowest_fare")).alias("oracle_savings"),
    )
    return with_baselines(apply_threshold(facts, F.lit(float(minimum_savings))), minimum_savings)


def apply_threshold(decisions: DataFrame, threshold: Column) -> DataFrame:
    """The model's action at a threshold: wait for a large enough saving on a later day."""
    wait = (F.col("predicted_savings") >= threshold) & (
        F.col("predicted_purchase_days") < F.col("as_of_days")
    )
    paid = F.when(wait, F.col("wait_paid_fare")).otherwise(F.col("current_fare"))
    return decisions.withColumns(
        {
            "model_action": action(wait),
            "model_paid_fare": paid,
            "model_savings": F.col("current_fare") - paid,
        }
    )


def _waited(wait: Column) -> Column:
    return F.when(wait, F.col("always_wait_savings")).otherwise(F.lit(0.0))


def with_baselines(decisions: DataFrame, minimum_savings: float) -> DataFrame:
    """Add the fixed policies. A baseline that waits pays the last observed fare."""
    dear = F.col("current_fare") > F.col("trailing_median_fare")
    coin = stable_uniform(F.col("decision_id")) < 0.5
    return decisions.withColumns(
        {
            "actual_best_action": action(F.col("oracle_savings") >= F.lit(float(minimum_savings))),
            "always_buy_action": F.lit("BUY"),
            "always_buy_savings": F.lit(0.0),
            "always_wait_action": F.lit("WAIT"),
            "heuristic_action": action(dear),
            "heuristic_savings": _waited(dear),
            "random_action": action(coin),
            "random_savings": _waited(coin),
        }
    )


def matched_random(decisions: DataFrame) -> DataFrame:
    """Redraw the random policy so that it waits about as often as the model."""
    rate = decisions.agg(F.avg((F.col("model_action") == "WAIT").cast("double"))).scalar()
    coin = stable_uniform(F.col("decision_id")) < rate
    return decisions.withColumns({"random_action": action(coin), "random_savings": _waited(coin)})


def decision_accuracy(decisions: DataFrame) -> DataFrame:
    agree = (F.col("model_action") == F.col("actual_best_action")).cast("double")
    return decisions.agg(
        F.count(F.lit(1)).alias("decisions"), F.avg(agree).alias("decision_accuracy")
    )
