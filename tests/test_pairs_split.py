from datetime import date, timedelta

import pytest

from leadcurve.operators import pairs, split
from leadcurve.operators.features import attach_features
from leadcurve.constants import FEATURE_COLUMNS
from tests.helpers import daily, ten_flights


@pytest.fixture(scope="module")
def one_curve(spark):
    return daily(spark, {("ATL", "LAX", date(2022, 10, 22), False): {21: 200, 14: 160, 7: 180}})


def test_pairs_look_forward_only(spark, one_curve):
    rows = pairs.strided_pairs(one_curve, as_of_stride=1).collect()
    assert all(r.days_before_departure <= r.as_of_days for r in rows)
    assert len(rows) == 6
    assert all(r.rel_fare == 1.0 for r in rows if r.days_before_departure == r.as_of_days)
    first = next(r for r in rows if (r.as_of_days, r.days_before_departure) == (21, 14))
    assert (first.rel_fare, first.current_fare, first.future_fare) == (0.8, 200.0, 160.0)


def test_pairs_equal_a_brute_force_join(spark):
    fares = {d: 100 + (d * 37) % 90 for d in (40, 33, 30, 21, 20, 14, 9, 7, 3, 2)}
    flight = date(2022, 7, 4)
    table = daily(spark, {("ATL", "LAX", flight, True): fares, ("BOS", "ORD", flight, None): fares})
    for stride, rule in ((2, lambda d: d % 2 == 0 or d <= 7), (5, lambda d: d % 5 == 0 or d <= 7)):
        got = {(r.as_of_days, r.days_before_departure) for r in pairs.strided_pairs(table, stride).collect()}
        assert got == {(a, b) for a in fares if rule(a) for b in fares if b <= a}
    got = {(r.as_of_days, r.days_before_departure) for r in pairs.remaining_pairs(table).collect()}
    assert got == {(a, b) for a in (40, 21, 14, 7) for b in fares if b <= a}
    row = attach_features(pairs.remaining_pairs(table)).first()
    assert set(FEATURE_COLUMNS) <= set(row.asDict())
    assert (row.near_holiday, row.departure_is_weekend, row.route_cat) == (True, False, "ATL-LAX")


def test_chronological_split_and_periods(spark):
    table = ten_flights(spark)
    rows = pairs.remaining_pairs(table)
    dates = sorted({r.as_of_date for r in rows.collect()})
    cut = split.split_cutoffs(rows, "as_of_date").first()
    assert cut.train_cutoff == dates[int(len(dates) * 0.70)]
    assert cut.test_cutoff == dates[int(len(dates) * 0.85)]
    parts = split.chrono_split(rows, split.split_cutoffs(rows, "as_of_date")).collect()
    assert len(parts) == rows.count()
    for r in parts:
        expected = "train" if r.as_of_date < cut.train_cutoff else (
            "validation" if r.as_of_date < cut.test_cutoff else "test")
        assert r.part == expected
    searched = sorted({date(2022, 10, 1) + timedelta(days=i - d) for i in range(10) for d in (21, 14, 7, 1)})
    bounds = split.period_bounds(table, 0.85, 1.0).first()
    assert bounds.period_start == searched[int(len(searched) * 0.85)] and bounds.period_end is None
    assert bounds.dates == len(searched)


def test_samples_are_repeatable(spark):
    rows = pairs.remaining_pairs(ten_flights(spark))
    one = split.pair_sample(rows, 20).collect()
    two = split.pair_sample(rows.repartition(3), 20).collect()
    assert len(one) == 20 and sorted(map(str, one)) == sorted(map(str, two))
    assert split.pair_sample(rows, 10_000).count() == rows.count()
