"""Backtest: tune the threshold on one period, measure every policy on the next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve import constants as C
from leadcurve.operators import policy, simulate, split
from leadcurve.operators.scorers import Scorer
from leadcurve.plans.train import scorer_of
from leadcurve.session import owned_stages, stage
from leadcurve.sources import sinks
from leadcurve.sources.bundle import Bundle


@dataclass(frozen=True)
class Backtest:
    decisions: DataFrame  # one row per held-out decision
    policies: DataFrame  # one row per policy, eleven figures
    search: DataFrame  # one row per threshold tried
    record: DataFrame  # one row: periods, threshold, sizes, accuracy
    threshold: float


def _period(
    daily: DataFrame,
    routes: DataFrame | None,
    scorer: Scorer,
    start: float,
    end: float,
    minimum_savings: float,
    max_decisions: int | None,
) -> tuple[DataFrame, tuple]:
    bounds = stage(split.period_bounds(daily, start, end), "bounds")
    dates = bounds.first()
    if dates["dates"] < 3:
        raise ValueError("Backtesting requires at least three distinct search dates.")
    candidates = simulate.decision_candidates(daily, bounds, routes, max_decisions=max_decisions)
    decisions = stage(simulate.simulate(candidates, scorer, minimum_savings), "decisions")
    if decisions.isEmpty():
        raise ValueError("No eligible holdout booking decisions were found.")
    return decisions, (dates["period_start"], dates["period_end"])


def evaluate(
    daily: DataFrame,
    scorer: Scorer,
    routes: DataFrame | None = None,
    minimum_savings: float = C.MEANINGFUL_SAVINGS,
    max_decisions: int | None = None,
    bootstrap_samples: int = C.BOOTSTRAP_SAMPLES,
) -> Backtest:
    """Run both periods over a daily market table that is stored (read several times).

    ``routes`` are the routes the scorer knows; without it every route counts. With
    ``max_decisions`` each period keeps a sample of its decisions.
    Decisions of each period are written once. Only two dates per period and the
    chosen threshold come to the driver.
    """
    settings = (minimum_savings, max_decisions)
    tuning, tuning_dates = _period(
        daily, routes, scorer, C.TRAIN_FRACTION, C.VALIDATION_FRACTION, *settings
    )
    search = stage(policy.threshold_search(tuning), "search")
    threshold = policy.select_threshold(search).first()["threshold"]
    held_out, test_dates = _period(daily, routes, scorer, C.VALIDATION_FRACTION, 1.0, *settings)
    decisions = stage(
        simulate.matched_random(simulate.apply_threshold(held_out, F.lit(threshold))), "held-out"
    )
    policies = policy.full_summary(decisions, bootstrap_samples)
    date = lambda day: F.lit(day).cast("date")
    record = simulate.decision_accuracy(decisions).select(
        date(tuning_dates[0]).alias("validation_start"),
        date(tuning_dates[1]).alias("validation_end"),
        date(test_dates[0]).alias("test_start"),
        date(test_dates[1]).alias("test_end"),
        F.lit(float(minimum_savings)).alias("minimum_savings"),
        F.lit(float(threshold)).alias("threshold"),
        F.col("decisions").alias("booking_decisions"),
        "decision_accuracy",
        daily.agg(F.count(F.lit(1))).scalar().alias("daily_market_rows"),
    )
    return Backtest(decisions, policies, search, record, threshold)


def write_backtest(daily: DataFrame, bundle: Bundle, path: str, **settings) -> float:
    """Backtest a stored bundle and write all results under ``path``; returns the threshold.

    ``decisions`` is CSV; ``policies``, ``search`` and ``record`` are JSON. What was staged
    on the way is removed.
    """
    with owned_stages(daily.sparkSession):
        result = evaluate(daily, scorer_of(bundle.model), bundle.routes, **settings)
        sinks.write_decisions(result.decisions, f"{path}/decisions")
        for name in ("policies", "search", "record"):
            sinks.write_record(getattr(result, name), f"{path}/{name}")
    return result.threshold
