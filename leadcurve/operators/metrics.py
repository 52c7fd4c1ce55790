"""Curve metrics: cheapest-day error, buy/wait agreement, rank correlation, dollar errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadcurve import constants as C
from leadcurve.constants import CURVE_KEYS
from leadcurve.functions.keys import route_key
from leadcurve.operators import explore
from leadcurve.operators.curves import build_curves, nearest_day, point_at
from leadcurve.operators.features import attach_features
from leadcurve.operators.market import stop_collapse
from leadcurve.operators.pairs import asof_anchors
from leadcurve.operators.quantiles import exact_median
from leadcurve.operators.scorers import Scorer
from leadcurve.operators.simulate import unfold_remaining

SCORED_KEYS = ["route", "flightDate", "isNonStop"]


def pinned_override() -> Column:
    """Predicted fare in dollars, with today's known fare on the as-of day."""
    today = F.col("days_before_departure") == F.col("as_of_days")
    return F.when(today, F.col("current_fare")).otherwise(
        F.col("predicted_relative") * F.col("current_fare")
    )


def _scored(anchored: DataFrame, scorer: Scorer, absolute: bool = False) -> DataFrame:
    rows = scorer(attach_features(unfold_remaining(anchored)))
    return rows.select(
        *SCORED_KEYS,
        "as_of_days",
        "days_before_departure",
        F.col("best_fare").alias("actual"),
        (F.col("predicted_fare") if absolute else pinned_override()).alias("predicted"),
    )


def _anchored(daily: DataFrame) -> DataFrame:
    points = F.col("points")
    return (
        build_curves(daily)
        .withColumn("route", route_key())
        .withColumn("as_of_days", nearest_day(points, C.SCORING_TARGET_DAY, prefer_larger=False))
        .filter(F.col("as_of_days") >= C.SCORING_MIN_DAY)
        .withColumn("current_fare", point_at(points, F.col("as_of_days"))["fare"])
    )


def scored_curves(daily: DataFrame, scorer: Scorer) -> DataFrame:
    """Actual and predicted fares of each curve, as of the day nearest to 21.

    The smaller of two equally near days counts. Curves whose day is below five
    are left out.
    """
    return _scored(_anchored(daily), scorer)


def compared_curves(daily: DataFrame, scorer: Scorer, predictions: Mapping[str, str]) -> DataFrame:
    """``scored_curves`` of several scorers side by side: each row once per ``configuration``.

    ``scorer`` adds one column per name of ``predictions`` (name -> column), so the curves
    are read and unfolded once, however many are compared.
    """
    rows = scorer(attach_features(unfold_remaining(_anchored(daily))))
    each = [F.struct(F.lit(name).alias("configuration"), F.col(c).alias("predicted_relative")) for name, c in predictions.items()]
    return rows.select("*", F.inline(F.array(*each))).select(
        *SCORED_KEYS,
        "configuration",
        "as_of_days",
        "days_before_departure",
        F.col("best_fare").alias("actual"),
        pinned_override().alias("predicted"),
    )


def with_ranks(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average ranks of actual and predicted fares within each curve."""

    def average_rank(column: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, column))
        return F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (ties - 1) / F.lit(2.0)

    return scored.withColumn("actual_rank", average_rank("actual")).withColumn(
        "predicted_rank", average_rank("predicted")
    )


def _day_error() -> Column:
    day = F.col("days_before_departure")
    best = [F.min(F.struct(F.col(c), (-day).alias("order")))["order"] for c in ("actual", "predicted")]
    return F.abs(best[0] - best[1])


def _agreement(margin: float) -> Column:
    """Whether both curves say wait, or both say buy; false without a fare for today."""
    day, as_of = F.col("days_before_departure"), F.col("as_of_days")

    def waits(column: str) -> Column:
        today = F.max(F.when(day == as_of, F.col(column)))
        return today - F.min(F.when(day <= as_of, F.col(column))) >= F.lit(float(margin))

    return F.coalesce(waits("actual") == waits("predicted"), F.lit(False))


def _spearman() -> Column:
    spread = F.stddev_pop("actual_rank") * F.stddev_pop("predicted_rank")
    defined = (
        (F.count(F.lit(1)) >= 3)
        & (F.stddev_pop("actual") >= 1e-6)
        & (F.stddev_pop("predicted") >= 1e-6)
    )
    return F.when(defined, F.try_divide(F.covar_pop("actual_rank", "predicted_rank"), spread))


def cheapest_day_error(scored: DataFrame, keys: Sequence[str] = SCORED_KEYS) -> DataFrame:
    """Days between the actual and the predicted cheapest day; the earlier date wins ties."""
    return scored.groupBy(*keys).agg(_day_error().alias("day_error"))


def buy_wait_agreement(
    scored: DataFrame, keys: Sequence[str] = SCORED_KEYS, margin: float = C.MEANINGFUL_SAVINGS
) -> DataFrame:
    return scored.groupBy(*keys).agg(_agreement(margin).alias("agrees"))


def curve_spearman(scored: DataFrame, keys: Sequence[str] = SCORED_KEYS) -> DataFrame:
    """Rank correlation per curve; null for short or flat curves."""
    return with_ranks(scored, keys).groupBy(*keys).agg(_spearman().alias("spearman"))


def curve_metrics(scored: DataFrame, keys: Sequence[str] = SCORED_KEYS) -> DataFrame:
    """All metrics of a curve in one aggregation."""
    error = F.col("actual") - F.col("predicted")
    return with_ranks(scored, keys).groupBy(*keys).agg(
        _agreement(C.MEANINGFUL_SAVINGS).alias("agrees"),
        _day_error().alias("day_error"),
        _spearman().alias("spearman"),
        F.avg(error * error).alias("mse"),
    )


def timing_score(metrics: DataFrame) -> DataFrame:
    """One row over all scored curves, with fixed values where nothing could be scored."""
    empty = C.EMPTY_TIMING
    day_error = exact_median(metrics, [], "day_error", "m").scalar()
    spearman = exact_median(metrics, [], "spearman", "m").scalar()
    means = metrics.agg(
        F.avg(F.col("agrees").cast("double")).alias("buy_wait"),
        F.sqrt(F.avg("mse")).alias("remain_rmse"),
        F.count(F.lit(1)).alias("n"),
    )
    return means.select(
        F.coalesce("buy_wait", F.lit(empty["buy_wait"])).alias("buy_wait"),
        F.coalesce(day_error, F.lit(empty["median_best_day_err"])).alias("median_best_day_err"),
        F.coalesce(spearman, F.lit(empty["median_spearman"])).alias("median_spearman"),
        F.coalesce("remain_rmse", F.lit(empty["remain_rmse"])).alias("remain_rmse"),
        "n",
    )


def pair_errors(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """Mean absolute and root mean square error of pairs in dollars."""
    rows = scorer(attach_features(pairs))
    error = F.col("future_fare") - pinned_override()
    return rows.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count(F.lit(1)).alias("pairs"),
    )


def evaluation_record(
    parts: DataFrame, cutoffs: DataFrame, timing: DataFrame, errors: DataFrame, configuration: str
) -> DataFrame:
    """One row: sizes of the split, its cutoffs, and the test figures."""
    sizes = parts.agg(
        *[
            F.count_if(F.col("part") == part).alias(f"{part}_rows")
            for part in ("train", "validation", "test")
        ]
    )

    def of(df: DataFrame, column: str) -> Column:
        return df.select(column).scalar()

    return sizes.select(
        F.lit(configuration).alias("selected_configuration"),
        "*",
        of(cutoffs, "train_cutoff").alias("train_cutoff"),
        of(cutoffs, "test_cutoff").alias("test_cutoff"),
        of(timing, "buy_wait").alias("test_buy_wait_agreement"),
        of(timing, "median_best_day_err").alias("test_median_best_day_error"),
        of(timing, "median_spearman").alias("test_median_curve_spearman"),
        of(timing, "remain_rmse").alias("test_remaining_curve_rmse"),
        of(errors, "mae").alias("test_pair_mae_dollars"),
        of(errors, "rmse").alias("test_pair_rmse_dollars"),
    )


def predicted_vs_actual(daily: DataFrame, scorer: Scorer, routes: int = 4, absolute: bool = False) -> DataFrame:
    """Actual and predicted curve of the busiest flight date of each of the largest routes.

    Stop types are collapsed to the cheaper one and the prediction starts from the
    first observed fare; with ``absolute`` the scorer gives dollars (``predicted_fare``),
    which are taken as they are.
    """
    sizes = daily.groupBy(*explore.ROUTE, "flightDate").agg(F.count(F.lit(1)).alias("n"))
    top = explore.top_routes(sizes, routes)
    flights = explore.busiest_flight_dates(sizes.join(top.drop("n"), explore.ROUTE, "left_semi"))
    keys = [*explore.ROUTE, "flightDate"]
    chosen = daily.join(flights.select(*keys), keys, "left_semi")
    first_day = asof_anchors(stop_collapse(chosen), lambda points, p: p["day"] == points[0]["day"])
    return _scored(first_day, scorer, absolute).drop("isNonStop")
