from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from leadcurve.constants import SUPPORTED_AIRPORTS
from leadcurve.operators import recommend, scorers

TODAY = date(2026, 3, 1)
FLIGHT = TODAY + timedelta(days=21)
SCHEMA = (
    "request_id long, origin string, destination string, today date, flight_date date, "
    "current_price double, stops string"
)


def lookups(spark):
    routes = spark.createDataFrame(
        [("ATL-LAX", 1940.0, 180.0)], "route string, route_distance double, route_median_fare double"
    )
    overall = spark.createDataFrame(
        [(160.0, 1500.0)], "global_median_fare double, global_median_distance double"
    )
    return routes, overall


def ask(spark, *rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def curve(spark, stops, scorer, price=200.0):
    requests = ask(spark, ("ATL", "LAX", TODAY, FLIGHT, price, stops))
    usable = recommend.validate_requests(requests)
    points = recommend.curve_points(recommend.pin_prices(usable, *lookups(spark)), scorer)
    rows = recommend.curve_rows(points).collect()
    assert len(rows) == 60
    return {r.days_before_departure: r.predicted_fare for r in rows}


def test_curves_are_pinned_to_today_and_scaled(spark):
    falling = lambda d: 200.0 * (0.70 + 0.30 * d / 21)
    connecting = curve(spark, "connecting", scorers.by_stop())
    assert connecting[21] == 200.0 and connecting[14] == pytest.approx(falling(14))
    assert curve(spark, "stop", scorers.by_stop()) == connecting
    nonstop = curve(spark, "nonstop", scorers.by_stop())
    assert nonstop[7] == pytest.approx(200.0)
    either = curve(spark, None, scorers.by_stop())
    assert either[7] < nonstop[7] and either[7] == connecting[7] and either[21] == 200.0
    assert either[40] == pytest.approx(200.0)  # before today the flat nonstop fare is the cheaper one
    drifting = curve(spark, "nonstop", scorers.drift())
    assert drifting[21] == 200.0 and drifting[14] == pytest.approx(200 * 0.64 / 0.71)
    assert curve(spark, "connecting", scorers.by_stop(), None)[21] == 180.0


def test_wait_and_buy_now(spark):
    requests = ask(
        spark,
        ("ATL", "LAX", TODAY, FLIGHT, 200.0, "all"),
        ("ATL", "LAX", TODAY, FLIGHT, 200.0, "nonstop"),
        ("BOS", "BOS", TODAY, FLIGHT, 200.0, "all"),
        ("ATL", "XYZ", TODAY, FLIGHT, 200.0, "all"),
        ("ATL", "LAX", TODAY, TODAY, 200.0, "all"),
        ("ATL", "LAX", TODAY, TODAY + timedelta(days=61), 200.0, "all"),
        ("ATL", "LAX", TODAY, FLIGHT, 200.0, "two"),
    )
    rows = recommend.recommend_requests(requests, scorers.by_stop(), *lookups(spark)).collect()
    by_id = {r.request_id: r for r in rows}
    assert [by_id[i].status for i in range(7)] == ["wait", "buy_now", "error", "error", "error", "too_far", "error"]
    wait = by_id[0]
    assert wait.current_price == 200.0 and wait.price_source == "user" and wait.best_day == 1
    assert wait.expected_savings == pytest.approx(57.14) and wait.wait_days == 20
    # day 1 costs 142.86; $8 more is reached after day 3
    assert (wait.buy_window_start_days, wait.buy_window_end_days) == (3, 1)
    assert wait.message.startswith("Wait, then buy between Mar 19 and Mar 21. Lowest predicted fare")
    assert "around $57.14 by waiting" in wait.message
    assert len(wait.curve) == 60 and wait.curve[0].days_before_departure == 60
    buy = by_id[1]
    assert buy.message.startswith("Buy between Mar 1 and Mar 21") and buy.expected_savings is None
    assert "different airports" in by_id[2].message and "supported" in by_id[3].message
    assert "future" in by_id[4].message and "61 days out" in by_id[5].message


def test_window_stops_at_the_nearest_dearer_day(spark):
    requests = ask(spark, ("ATL", "LAX", TODAY, FLIGHT, 200.0, "connecting"))
    pinned = recommend.pin_prices(recommend.validate_requests(requests), *lookups(spark))
    base = recommend.curve_points(pinned, scorers.drift())

    def fare(day):
        return (
            F.when(day == 10, 100.0).when(day == 11, 108.0).when(day == 12, 108.5).when(day == 13, 101.0)
            .when(day == 9, 105.0).when(day == 8, 300.0).otherwise(150.0)
        )

    points = F.transform("points", lambda p: F.struct(p["day"].alias("day"), fare(p["day"]).alias("fare")))
    shaped = base.withColumn("points", points)
    row = recommend.buy_windows(shaped).first()
    assert (row.best_day, row.window_start_days, row.window_end_days) == (10, 11, 9)


def test_price_precedence(spark):
    requests = ask(
        spark,
        ("ATL", "LAX", TODAY, FLIGHT, 210.0, "all"),
        ("ATL", "LAX", TODAY, FLIGHT, None, "all"),
        ("ATL", "LAX", TODAY, FLIGHT, None, "all"),
        ("BOS", "LAX", TODAY, FLIGHT, None, "all"),
    ).withColumn("published_price", F.when(F.col("request_id") < 2, 100.0))
    rows = recommend.pin_prices(recommend.validate_requests(requests), *lookups(spark)).collect()
    got = {r.request_id: (r.pin_price, r.price_source, r.totalTravelDistance) for r in rows}
    assert got == {
        0: (210.0, "user", 1940.0), 1: (100.0, "web", 1940.0), 2: (180.0, "model", 1940.0),
        3: (160.0, "model", 1500.0),
    }
    empty = spark.createDataFrame([(None, None)], "global_median_fare double, global_median_distance double")
    last = recommend.pin_prices(recommend.validate_requests(requests), lookups(spark)[0], empty)
    assert last.filter("request_id = 3").first().pin_price == 150.0


def test_request_fields_in_order(spark):
    rows = [
        (0, " atl ", "LAX", "2026-03-22", "200", "Non-Stop", None, None),
        (1, "ATL", "LAX", "20260322", "", None, True, None),
        (2, "ATL", "ATL", "x", "-1", "two", None, "Stops must be"),
        (3, "AT", "ATL", "x", "abc", None, None, "must be a number"),
        (4, "AT", "ATL", "x", "0", None, None, "greater than 0"),
        (5, "AT", "ATL", "x", None, None, None, "3-letter"),
        (6, "ATL", "ATL", "x", None, None, None, "different"),
        (7, "ATL", "XXX", "x", None, None, None, "supported list"),
        (8, "ATL", "LAX", "2026-02-30", None, None, None, "valid flight date"),
    ]
    schema = (
        "request_id long, origin string, destination string, flightDate string, currentPrice string, "
        "stops string, nonstopOnly boolean, expected string"
    )
    got = {r.request_id: r for r in recommend.read_request_fields(spark.createDataFrame(rows, schema)).collect()}
    for r in got.values():
        assert (r.problem is None) if r.expected is None else (r.expected in r.problem), r
    assert (got[0].origin, got[0].stops, got[0].current_price) == ("ATL", "nonstop", 200.0)
    assert (got[1].stops, got[1].flight_date, got[1].current_price) == ("nonstop", date(2026, 3, 22), None)
    assert len(SUPPORTED_AIRPORTS) == 16


def test_absolute_model_is_not_pinned(spark):
    requests = ask(spark, ("ATL", "LAX", TODAY, FLIGHT, 500.0, "nonstop"))
    dollars = lambda rows: rows.withColumn("predicted_fare", 100.0 + F.col("days_before_departure"))
    row = recommend.recommend_requests(requests, dollars, *lookups(spark), absolute=True).first()
    assert (row.status, row.current_price, row.expected_best_price) == ("wait", 121.0, 101.0)


def test_repeated_and_null_request_ids_are_answered_one_by_one(spark):
    rows = [
        (1, "ATL", "LAX", TODAY, FLIGHT, 200.0, "all"), (1, "BOS", "LAX", TODAY, FLIGHT, 500.0, "nonstop"),
        (None, "ATL", "BOS", TODAY, FLIGHT, 90.0, "stop"), (None, "ATL", "BOS", TODAY, FLIGHT, 90.0, "stop"),
    ]
    out = recommend.recommend_requests(spark.createDataFrame(rows, SCHEMA), scorers.dip(), *lookups(spark)).collect()
    assert sorted((r.request_id or 0, r.origin, r.current_price) for r in out) == [
        (0, "ATL", 90.0), (0, "ATL", 90.0), (1, "ATL", 200.0), (1, "BOS", 500.0)]
    assert all(len(r.curve) == 60 and [p.days_before_departure for p in r.curve] == list(range(60, 0, -1)) for r in out)


def test_each_stop_type_is_scored_once(spark):
    seen = []

    def counting(rows):
        seen.append(rows)
        return scorers.by_stop()(rows)

    requests = ask(spark, ("ATL", "LAX", TODAY, FLIGHT, 200.0, "all"), ("ATL", "LAX", TODAY, FLIGHT, 200.0, "nonstop"))
    pinned = recommend.pin_prices(recommend.validate_requests(requests), *lookups(spark))
    recommend.curve_points(pinned, counting).collect()
    assert len(seen) == 1 and seen[0].count() == 180


def many(spark, n=400):
    """Requests of all stop types and lead days, with repeated and null ids, in no order."""
    ends = [("ATL", "LAX"), ("LAX", "BOS"), ("BOS", "ATL")]
    rows = [
        (None if i % 7 == 0 else i % 90, *ends[i % 3], TODAY, TODAY + timedelta(days=1 + i % 60), 100.0 + i if i % 4 else None, ["all", "stop", "nonstop"][i % 3])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(7, F.rand(3))


def answers(spark, requests, scorer):
    rows = recommend.recommend_requests(requests, scorer, *lookups(spark)).collect()
    return sorted((str(r.request_id), r.origin, r.days_left, r.status, r.current_price, r.best_day, r.message, tuple(p.predicted_fare for p in r.curve)) for r in rows)


@pytest.mark.parametrize("formula", [scorers.by_stop, scorers.drift, scorers.dip])
def test_curves_in_the_row_equal_unfolded_ones(spark, formula):
    requests = many(spark)
    opaque = lambda rows: formula()(rows)
    inside, unfolded = answers(spark, requests, formula()), answers(spark, requests, opaque)
    assert len(inside) == 400
    for a, b in zip(inside, unfolded, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[7] == pytest.approx(b[7], abs=0.011)


def test_formulas_move_no_request(spark):
    pinned = recommend.pin_prices(recommend.validate_requests(many(spark)), *lookups(spark))
    before = pinned._jdf.queryExecution().optimizedPlan().toString()
    after = recommend.curve_points(pinned, scorers.by_stop())._jdf.queryExecution().optimizedPlan().toString()
    for step in ("Generate", "Aggregate", "Repartition"):
        assert after.count(step) == before.count(step)


def test_row_numbers_are_stored_before_rows_move(spark):
    """A model's requests are read back with their numbers, so that a repeated task cannot number them otherwise."""
    pinned = recommend.pin_prices(recommend.validate_requests(many(spark)), *lookups(spark))
    rows = recommend._unfolded(pinned, F.array(F.lit(False)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "parquet" in plan
    assert rows.select("_row").distinct().count() == 400 and rows.count() == 400 * 60
    again = answers(spark, many(spark), lambda r: scorers.dip()(r))
    assert again == answers(spark, many(spark).repartition(3), lambda r: scorers.dip()(r))


def test_dollar_formula_equals_unfolded_one(spark):
    requests = recommend.pin_prices(recommend.validate_requests(many(spark, 40)), *lookups(spark))
    score = scorers.dollars()
    both = [recommend.predict_curves(requests, s, absolute=True) for s in (score, lambda rows: score(rows))]
    found = [sorted((str(r.request_id), r.origin, r.days_left, tuple(map(tuple, r.points))) for r in df.collect()) for df in both]
    assert found[0] == found[1]


def test_window_search_is_no_search_per_day(spark):
    pinned = recommend.pin_prices(recommend.validate_requests(many(spark, 40)), *lookups(spark))
    windows = recommend.buy_windows(recommend.curve_points(pinned, scorers.drift()))
    plan = windows.select("request_id", "window_start_days", "window_end_days")._jdf.queryExecution().optimizedPlan().toString()
    # the days ahead are found by the only filter; nothing looks through the dear days for each day
    assert plan.count("filter(") == 1


def test_a_question_asked_often_is_scored_once(spark):
    seen = []

    def counting(rows):
        seen.append(rows)
        return scorers.by_stop()(rows)

    questions = [
        ("ATL", "LAX", TODAY, FLIGHT, 200.0, "all"), ("ATL", "LAX", TODAY, FLIGHT, None, "stop"),
        ("BOS", "ATL", TODAY, FLIGHT, 90.0, "nonstop"), ("BOS", "ATL", TODAY, FLIGHT, 91.0, "nonstop"),
    ]
    requests = ask(spark, *[q for q in questions for _ in range(30)])
    routes, overall = lookups(spark)
    overall = overall.withColumn("global_median_distance", F.lit(None).cast("double"))  # BOS-ATL has no distance
    out = recommend.recommend_requests(requests, counting, routes, overall).collect()
    assert len(seen) == 1 and seen[0].count() == 5 * 60  # one question is for both stop types
    assert sorted(r.request_id for r in out) == list(range(120))
    plain = recommend.recommend_requests(requests, scorers.by_stop(), routes, overall).collect()
    assert sorted(out, key=lambda r: r.request_id) == sorted(plain, key=lambda r: r.request_id)
