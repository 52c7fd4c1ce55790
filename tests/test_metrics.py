from datetime import date

import pandas as pd
import pytest

from leadcurve.operators import metrics, scorers
from tests.helpers import daily

SCHEMA = "route string, as_of_days int, days_before_departure int, actual double, predicted double"
KEYS = ["route"]


def scored(spark, curves):
    rows = [
        (name, as_of, d, float(a), float(p))
        for name, (as_of, days, actual, predicted) in curves.items()
        for d, a, p in zip(days, actual, predicted, strict=True)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_metrics_of_hand_curves(spark):
    days = [21, 14, 7, 1]
    df = scored(spark, {
        "late": (21, days, [200, 180, 150, 170], [200, 190, 180, 160]),
        "flat": (21, days, [200, 180, 150, 170], [200, 200, 200, 200]),
        "tied": (21, days, [100, 90, 90, 95], [100, 80, 85, 80]),
        "short": (7, [7, 1], [100, 90], [100, 90]),
        "no today": (20, days, [200, 180, 150, 170], [200, 190, 180, 160]),
    })
    errors = {r.route: r.day_error for r in metrics.cheapest_day_error(df, KEYS).collect()}
    assert errors == {"late": 6, "flat": 14, "tied": 0, "short": 0, "no today": 6}
    agrees = {r.route: r.agrees for r in metrics.buy_wait_agreement(df, KEYS).collect()}
    assert agrees == {"late": True, "flat": False, "tied": True, "short": True, "no today": False}
    spearman = {r.route: r.spearman for r in metrics.curve_spearman(df, KEYS).collect()}
    assert spearman["flat"] is None and spearman["short"] is None
    for name, a, p in (("late", [200, 180, 150, 170], [200, 190, 180, 160]), ("tied", [100, 90, 90, 95], [100, 80, 85, 80])):
        assert spearman[name] == pytest.approx(pd.Series(a).rank().corr(pd.Series(p).rank()))
    both = metrics.curve_metrics(df, KEYS)
    score = metrics.timing_score(both).first()
    assert (score.n, score.buy_wait, score.median_best_day_err) == (5, 0.6, 6.0)


def test_nothing_to_score_gives_fixed_values(spark):
    empty = scored(spark, {"x": (21, [21], [1], [1])}).filter("route = 'none'")
    score = metrics.timing_score(metrics.curve_metrics(empty, KEYS)).first()
    assert tuple(score) == (0.0, 99.0, 0.0, 999.0, 0)


def test_scoring_day_prefers_the_smaller_and_skips_late_curves(spark):
    flight = date(2022, 10, 30)
    table = daily(spark, {
        ("ATL", "LAX", flight, False): {22: 200, 20: 190, 10: 180},
        ("BOS", "ORD", flight, False): {4: 200, 2: 190, 1: 180},
    })
    rows = metrics.scored_curves(table, scorers.drift()).collect()
    assert {(r.route, r.as_of_days) for r in rows} == {("ATL-LAX", 20)}
    by_day = {r.days_before_departure: r.predicted for r in rows}
    assert by_day == {20: 190.0, 10: pytest.approx(0.60 * 190)}
