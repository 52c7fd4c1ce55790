"""Batch recommendations: request checks, price pinning, fare curves, buy or wait."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadcurve import constants as C
from leadcurve.functions import text
from leadcurve.functions.dates import day_of_week
from leadcurve.functions.fares import cents
from leadcurve.functions.keys import normalize_stops
from leadcurve.operators.features import attach_features, departure_features
from leadcurve.operators.scorers import FormulaScorer, Scorer
from leadcurve.session import spread, stage


#: What a curve and its buy window depend on. Rows that agree on all of it are one question.
QUESTION = ("origin", "destination", "today", "flight_date", "days_left", "stops", "pin_price", "totalTravelDistance")


def _first(*cases: tuple[Column, Column | str]) -> Column:
    """Value of the first condition that holds; null if none does."""
    chain = None
    for condition, value in cases:
        value = F.lit(value) if isinstance(value, str) else value
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def _airport(column: str) -> Column:
    return F.upper(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Check typed requests: ``request_id, origin, destination, flight_date, today,
    current_price, stops``. Adds ``days_left`` and, for a rejected request, ``status``
    and ``message``; a usable request has the status ``ok``.
    """
    nonstop_only = F.col("nonstop_only") if "nonstop_only" in requests.columns else None
    read = requests.withColumns(
        {
            "origin": _airport("origin"),
            "destination": _airport("destination"),
            "stops": normalize_stops(F.col("stops"), nonstop_only),
            "days_left": F.datediff("flight_date", "today"),
        }
    )
    origin, destination, left = F.col("origin"), F.col("destination"), F.col("days_left")
    supported = origin.isin(*C.SUPPORTED_AIRPORTS) & destination.isin(*C.SUPPORTED_AIRPORTS)
    problem = _first(
        (F.col("stops").isNull(), C.MSG_STOPS),
        (origin == destination, C.MSG_SAME_AIRPORT),
        (~F.coalesce(supported, F.lit(False)), C.MSG_UNSUPPORTED),
        (F.col("flight_date").isNull(), C.MSG_DATE),
        (left <= 0, C.MSG_NOT_FUTURE),
    )
    far = left > C.MAX_LEAD_DAYS
    return (
        read.withColumn("message", problem)
        .withColumn("status", F.when(F.col("message").isNotNull(), "error").when(far, "too_far").otherwise("ok"))
        .withColumn("message", F.when(F.col("status") == "too_far", text.too_far_message(left)).otherwise(F.col("message")))
    )


def read_request_fields(raw: DataFrame) -> DataFrame:
    """Type the text fields of raw requests (``origin, destination, flightDate,
    currentPrice, stops``). A bad row is kept, with the first ``problem`` found.
    """
    price = F.regexp_replace(F.col("currentPrice"), r"^\s+|\s+$", "")
    given = F.col("currentPrice").isNotNull() & (F.col("currentPrice") != "")
    day = F.regexp_replace(F.coalesce("flightDate", F.lit("")), r"^\s+|\s+$", "")
    iso = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date")).when(
        day.rlike(r"^\d{8}$"),
        F.concat_ws("-", day.substr(1, 4), day.substr(5, 2), day.substr(7, 2)).try_cast("date"),
    )
    nonstop_only = F.col("nonstopOnly") if "nonstopOnly" in raw.columns else None
    read = raw.withColumns(
        {
            "origin": F.coalesce(_airport("origin"), F.lit("")),
            "destination": F.coalesce(_airport("destination"), F.lit("")),
            "flight_date": iso,
            "current_price": F.when(given, price.try_cast("double")),
            "stops": normalize_stops(F.col("stops"), nonstop_only),
        }
    )
    origin, destination = F.col("origin"), F.col("destination")
    supported = origin.isin(*C.SUPPORTED_AIRPORTS) & destination.isin(*C.SUPPORTED_AIRPORTS)
    problem = _first(
        (F.col("stops").isNull(), C.MSG_STOPS),
        (given & F.col("current_price").isNull(), C.MSG_PRICE_TYPE),
        (F.col("current_price") <= 0, C.MSG_PRICE_SIGN),
        ((F.length(origin) != 3) | (F.length(destination) != 3), C.MSG_CODE_LENGTH),
        (origin == destination, C.MSG_SAME_AIRPORT),
        (~supported, C.MSG_UNSUPPORTED),
        (F.col("flight_date").isNull(), C.MSG_DATE),
    )
    return read.withColumn("problem", problem).drop("flightDate", "currentPrice")


def pin_prices(requests: DataFrame, route_lookup: DataFrame, global_lookup: DataFrame) -> DataFrame:
    """Choose today's fare: the traveller's, else a published one, else the route's median.

    ``published_price`` is used if the requests carry it. Also adds the route's
    distance. A route that is not in the lookup takes the global values, and
    without those $150.
    """
    route = F.concat(F.col("origin"), F.lit("-"), F.col("destination"))
    fare = global_lookup.select("global_median_fare").scalar()
    distance = global_lookup.select("global_median_distance").scalar()
    joined = requests.withColumn("route", route).join(route_lookup, "route", "left")
    web = F.col("published_price") if "published_price" in requests.columns else F.lit(None).cast("double")
    user = F.col("current_price").cast("double")
    typical = F.coalesce("route_median_fare", fare, F.lit(C.DEFAULT_FARE))
    if "live_matched_date" in requests.columns:
        used = user.isNull() & web.isNotNull()
        about = [c for c in ("live_matched_date", "published_stops", "published_carrier") if c in requests.columns]
        joined = joined.withColumns({c: F.when(used, F.col(c)) for c in about})
    return joined.withColumns(
        {
            "pin_price": F.coalesce(user, web, typical),
            "price_source": F.when(user.isNotNull(), "user").when(web.isNotNull(), "web").otherwise("model"),
            "totalTravelDistance": F.coalesce("route_distance", distance),
        }
    ).drop("route_median_fare", "route_distance")


def _serving_features(requests: DataFrame) -> DataFrame:
    """Requests with the columns of a feature row that do not depend on the lead day."""
    return requests.withColumns(
        {
            "startingAirport": F.col("origin"),
            "destinationAirport": F.col("destination"),
            "flightDate": F.col("flight_date"),
            "route": F.concat(F.col("origin"), F.lit("-"), F.col("destination")),
            "as_of_days": F.col("days_left"),
            "current_fare": F.col("pin_price"),
        }
    )


def _unfolded(requests: DataFrame, pools: Column) -> DataFrame:
    """One feature row per request row, stop type (``pools``: nonstop or not) and lead day.

    Rows are numbered, so that equal, repeated or null request ids stay apart, and stored
    with their number: a task that is run again reads the numbers that others have seen,
    in whatever order the rows arrived. They spread by that number, so that a request's
    rows stay together. What the flight alone decides is worked out before the lead days
    unfold. The request's own columns travel with one of its rows only.
    """
    given = requests.columns
    numbered = stage(requests.withColumn("_row", F.monotonically_increasing_id()), "requests")
    prepared = departure_features(_serving_features(spread(numbered, "_row")))
    days = F.explode(F.sequence(F.lit(C.MAX_LEAD_DAYS), F.lit(1)))
    rows = prepared.withColumn("_pools", pools).withColumn("is_nonstop", F.explode("_pools"))
    rows = rows.withColumn("isNonStop", F.col("is_nonstop")).withColumn("days_before_departure", days)
    searched = F.date_sub("flight_date", F.col("days_before_departure"))
    first = (F.col("days_before_departure") == C.MAX_LEAD_DAYS) & (F.col("is_nonstop") == F.get("_pools", F.lit(0)))
    return attach_features(
        rows.withColumns(
            {
                "search_day_of_week": day_of_week(searched),
                "_about": F.when(first, F.struct(*given)),
            }
        )
    )


def _gathered(scored: DataFrame, value: str) -> DataFrame:
    """One row per request row with its ``values``: by stop type, largest lead day first."""
    point = F.struct(
        F.col("is_nonstop").alias("nonstop"),
        (-F.col("days_before_departure")).alias("order"),
        F.col("days_before_departure").alias("day"),
        F.col(value).alias("value"),
    )
    gathered = scored.groupBy("_row").agg(
        F.first("_about", ignorenulls=True).alias("about"), F.sort_array(F.collect_list(point)).alias("values")
    )
    return gathered.select("about.*", "values")


def _every_day(fare: Callable[[Column], Column]) -> Column:
    """Points of the lead days from the largest to 1, with the fare of each."""
    days = F.sequence(F.lit(C.MAX_LEAD_DAYS), F.lit(1), F.lit(-1))
    return F.transform(days, lambda day: F.struct(day.alias("day"), fare(day).alias("fare")))


def _curve_in_row(requests: DataFrame, scorer: FormulaScorer) -> DataFrame:
    """``curve_points`` of a formula: every lead day of a request inside its row, nothing unfolds or moves."""
    left, price, stops = F.col("days_left"), F.col("pin_price"), F.col("stops")

    def base(nonstop: bool) -> Column:
        today = scorer.at(left, left, F.lit(nonstop))
        return F.when(left.between(1, C.MAX_LEAD_DAYS) & (today > 0), today).otherwise(F.lit(1.0))

    based = requests.withColumns({"_base_nonstop": base(True), "_base_connecting": base(False)})

    def direct(day: Column) -> Column:
        return scorer.at(day, left, F.lit(True)) / F.col("_base_nonstop") * price

    def via(day: Column) -> Column:
        return scorer.at(day, left, F.lit(False)) / F.col("_base_connecting") * price

    # the stop type is looked at once per row, not once per day
    points = (
        F.when(stops == "nonstop", _every_day(direct))
        .when(stops == "connecting", _every_day(via))
        .otherwise(_every_day(lambda day: F.least(via(day), direct(day))))
    )
    return based.select(*requests.columns, points.alias("points"))


def curve_points(requests: DataFrame, scorer: Scorer) -> DataFrame:
    """Requests with ``points``: the predicted fare of each of the 60 lead days, largest day first.

    A formula is worked out inside the request's row. For another scorer a request for one
    stop type is unfolded for that one, a request for both for both, and scored in one
    pass. Each stop type costs the pinned fare today, and the cheaper one of each day is
    the curve of a request for both.
    """
    if isinstance(scorer, FormulaScorer):
        return _curve_in_row(requests, scorer)
    both, stops = F.array(F.lit(False), F.lit(True)), F.col("stops")
    pools = F.when(stops == "nonstop", F.array(F.lit(True))).when(stops == "connecting", F.array(F.lit(False)))
    gathered = _gathered(scorer(_unfolded(requests, pools.otherwise(both))), "predicted_relative")
    days = F.lit(C.MAX_LEAD_DAYS)
    halves = gathered.withColumn("one", F.slice("values", F.lit(1), days)).withColumn(
        "other", F.when(F.size("values") > days, F.slice("values", days + 1, days)).otherwise(F.col("one"))
    )

    def base(pool: str) -> Column:
        today = F.try_element_at(F.col(pool), (days + 1 - F.col("days_left")).cast("int"))["value"]
        return F.when(today > 0, today).otherwise(F.lit(1.0))

    known = halves.withColumns({"base_one": base("one"), "base_other": base("other")})
    price = F.col("pin_price")
    points = F.zip_with(
        "one",
        "other",
        lambda a, b: F.struct(
            a["day"].alias("day"),
            F.least(a["value"] / F.col("base_one") * price, b["value"] / F.col("base_other") * price).alias("fare"),
        ),
    )
    return known.select(*requests.columns, points.alias("points"))


def absolute_curve_points(requests: DataFrame, scorer: Scorer) -> DataFrame:
    """Curves of a model that predicts dollars (``predicted_fare``): one pool, no pinning."""
    if isinstance(scorer, FormulaScorer):
        points = _every_day(lambda day: scorer.at(day, F.col("days_left"), F.lit(False)))
        return requests.select(*requests.columns, points.alias("points"))
    gathered = _gathered(scorer(_unfolded(requests, F.array(F.lit(False)))), "predicted_fare")
    points = F.transform("values", lambda v: F.struct(v["day"].alias("day"), v["value"].alias("fare")))
    return gathered.select(*requests.columns, points.alias("points"))


def predict_curves(requests: DataFrame, scorer: Scorer, absolute: bool = False) -> DataFrame:
    """Pinned requests with their fare curves; ``absolute`` for a scorer that gives dollars."""
    return (absolute_curve_points if absolute else curve_points)(requests, scorer)


def curve_rows(curves: DataFrame) -> DataFrame:
    """One row per request and lead day: ``days_before_departure`` and ``predicted_fare``."""
    kept = [c for c in curves.columns if c != "points"]
    unfolded = curves.select(*kept, F.explode("points").alias("point"))
    return unfolded.select(
        *kept, F.col("point.day").alias("days_before_departure"), F.col("point.fare").alias("predicted_fare")
    )


def buy_windows(curves: DataFrame, margin: float = C.MEANINGFUL_SAVINGS) -> DataFrame:
    """Per request with ``points`` the best day and the unbroken run of days around it within the margin.

    Only days up to departure count. The run ends before the nearest dearer day on
    either side.
    """
    left, place = F.col("days_left"), F.col("best_place")
    # days lie in the order of the points, the largest first: the first of equal fares is the earliest date
    found = (
        curves.withColumn("ahead", F.filter("points", lambda p: p["day"] <= left))
        .withColumns({"ahead_days": F.col("ahead.day"), "ahead_fares": F.col("ahead.fare")})
        .withColumn("best_price", F.array_min("ahead_fares"))
        .withColumn("best_place", F.array_position("ahead_fares", F.col("best_price")).cast("int"))
        .withColumn("dear", F.transform("ahead_fares", lambda fare: fare > F.col("best_price") + F.lit(float(margin))))
    )
    # how many days on either side come before the nearest dearer one: one pass, places by number
    before = F.array_position(F.reverse(F.slice("dear", F.lit(1), place)), True)
    after = F.array_position(F.slice("dear", place, F.size("dear") - place + 1), True)
    found = found.withColumns({"dear_before": before.cast("int"), "dear_after": after.cast("int")})
    first = F.when(F.col("dear_before") == 0, 1).otherwise(place - F.col("dear_before") + 2)
    last = F.when(F.col("dear_after") == 0, F.size("dear")).otherwise(place + F.col("dear_after") - 2)
    rounded = F.transform(
        "points",
        lambda p: F.struct(
            p["day"].alias("days_before_departure"), cents(p["fare"]).alias("predicted_fare")
        ),
    )
    return found.withColumns(
        {
            "best_day": F.try_element_at("ahead_days", place),
            "window_start_days": F.try_element_at("ahead_days", first),
            "window_end_days": F.try_element_at("ahead_days", last),
            "today_price": F.element_at("ahead_fares", 1),
            "curve": rounded,
        }
    ).drop("points", "ahead", "ahead_days", "ahead_fares", "best_place", "dear", "dear_before", "dear_after")


def answered_once(pinned: DataFrame, scorer: Scorer, absolute: bool = False) -> DataFrame:
    """Pinned requests with their buy window; every distinct question is scored and searched once.

    A formula costs less inside each request's row than a join. For another scorer the
    requests are stored, as its rows unfold, and each finds the answer of its question
    again; nulls are equal there. Feature rows hold what ``QUESTION`` gives.
    """
    if isinstance(scorer, FormulaScorer):
        return buy_windows(predict_curves(pinned, scorer, absolute))
    asked = stage(pinned, "pinned")
    found = buy_windows(predict_curves(asked.select(*QUESTION).distinct(), scorer, absolute))
    answers = [c for c in found.columns if c not in QUESTION]
    found = found.select(*[F.col(c).alias(f"_{c}") for c in QUESTION], *answers)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in QUESTION])
    return asked.join(found, same).select(*asked.columns, *answers)


def recommend(windows: DataFrame, margin: float = C.MEANINGFUL_SAVINGS) -> DataFrame:
    """Buy now or wait, with dates, amounts, wording and the whole curve."""
    best_day, left = F.col("best_day"), F.col("days_left")
    dated = windows.withColumns(
        {
            "best_date": F.date_sub("flight_date", best_day),
            "buy_window_start": F.date_sub("flight_date", F.col("window_start_days")),
            "buy_window_end": F.date_sub("flight_date", F.col("window_end_days")),
        }
    )
    savings = F.col("today_price") - F.col("best_price")
    buy = (best_day == left) | (savings < F.lit(float(margin)))
    when = text.window_text(F.col("buy_window_start"), F.col("buy_window_end"))
    kept = [
        c
        for c in ("request_id", "origin", "destination", "flight_date", "today", "days_left",
                  "stops", "price_source", "live_matched_date", "published_stops", "published_carrier")
        if c in windows.columns
    ]
    return dated.select(
        *kept,
        (F.col("stops") == "nonstop").alias("nonstop_only"),
        F.when(buy, "buy_now").otherwise("wait").alias("status"),
        F.when(~buy, left - best_day).alias("wait_days"),
        cents(F.col("today_price")).alias("current_price"),
        F.when(~buy, cents(F.col("best_price"))).alias("expected_best_price"),
        F.when(~buy, cents(savings)).alias("expected_savings"),
        "best_day",
        "best_date",
        "buy_window_start",
        "buy_window_end",
        F.col("window_start_days").alias("buy_window_start_days"),
        F.col("window_end_days").alias("buy_window_end_days"),
        F.when(buy, text.buy_now_message(when))
        .otherwise(text.wait_message(when, F.col("best_date"), savings))
        .alias("message"),
        "curve",
    )


def recommend_requests(
    requests: DataFrame,
    scorer: Scorer,
    route_lookup: DataFrame,
    global_lookup: DataFrame,
    absolute: bool = False,
    find_published: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Requests to recommendations; rejected requests keep status and message only.

    ``find_published`` looks up published fares: it gets the usable requests and adds
    ``published_price`` and ``live_matched_date``. A traveller's own price still wins.
    """
    checked = validate_requests(requests)
    usable = checked.filter(F.col("status") == "ok").drop("status", "message")
    if find_published is not None:
        usable = find_published(usable)
    pinned = pin_prices(usable, route_lookup, global_lookup)
    answers = recommend(answered_once(pinned, scorer, absolute))
    rejected = checked.filter(F.col("status") != "ok")
    # a rejected request keeps no fare
    kept = [c for c in answers.columns if c in rejected.columns and c != "current_price"]
    return answers.unionByName(rejected.select(*kept), allowMissingColumns=True)
