"""One query per operator. Each takes the session and the folder of the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.catalog import fixtures as fx
from leadcurve.constants import CURVE_KEYS
from leadcurve.functions import dates
from leadcurve.functions.keys import route_key, stable_uniform
from leadcurve.operators import (
    clean,
    explore,
    extract,
    market,
    metrics,
    pairs,
    policy,
    recommend,
    scorers,
    simulate,
    split,
)
from leadcurve.operators.features import attach_features
from leadcurve.session import shared_folder, stage, stage_bucketed
from leadcurve.sources import bundle, offers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- cleaning and the daily table ----------------------------------------------------


@query
def fixture_offers(spark, sf):
    return fx.offers(spark, sf)


@query
def clean_strict(spark, sf):
    return clean.clean_offers(fx.offers_mixed_case(spark, sf))


@query
def clean_same_day(spark, sf):
    return clean.clean_offers(fx.offers_mixed_case(spark, sf), same_day=True, upper=False)


@query
def quality_profile(spark, sf):
    return clean.quality_profile(fx.offers(spark, sf))


@query
def clean_profile(spark, sf):
    return clean.clean_profile(fx.offers(spark, sf))


@query
def cleaning_impact(spark, sf):
    return rounded(clean.cleaning_impact(fx.offers(spark, sf)), "dropped_percent")


@query
def daily_best_fare(spark, sf):
    return market.daily_from_offers(fx.offers_mixed_case(spark, sf))


@query
def lenient_market(spark, sf):
    # written first, as the text table a quote file would be
    return market.daily_market(stage(fx.offers_as_text(spark, sf), "text"))


def _daily(spark, sf) -> DataFrame:
    return market.daily_from_offers(fx.offers(spark, sf))


def _market(spark, sf) -> DataFrame:
    """The backtest's daily table, written once because several steps read it: by route, in buckets of curves."""
    return stage_bucketed(market.daily_market(fx.offers(spark, sf)), "market", CURVE_KEYS, by=["route"])


@query
def table_stats(spark, sf):
    return market.table_stats(_daily(spark, sf))


@query
def stop_counts(spark, sf):
    return market.stop_counts(_daily(spark, sf))


@query
def route_lookups(spark, sf):
    counts = stage(market.lookup_counts(_daily(spark, sf)), "lookup-counts")
    routes = market.route_lookups(counts)
    overall = stage(market.global_lookups(counts), "globals")
    return routes.withColumns(
        {c: overall.select(c).scalar() for c in ("global_median_fare", "global_median_distance")}
    )


@query
def curve_lengths(spark, sf):
    return market.curve_lengths(_daily(spark, sf))


@query
def stop_collapse(spark, sf):
    return market.stop_collapse(_daily(spark, sf))


# --- files -------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def csv_clean(spark, sf):
    """Cleaned quotes of a CSV table in which some lines are broken."""
    path = _folder(spark, "quotes")
    fx.offers_csv(spark, sf, path)
    return clean.clean_offers(offers.load_offers(spark, path, "csv"))


@query
def csv_rejects(spark, sf):
    """Ingest of that table: rejected lines by reason, beside the counts of its profile."""
    from leadcurve.plans.ingest import ingest

    path, out, rejects = (_folder(spark, name) for name in ("quotes", "clean", "rejects"))
    fx.offers_csv(spark, sf, path)
    profile = stage(ingest(spark, path, out, rejects_path=rejects, fmt="csv"), "profile")
    counts = [profile.select(c).scalar().alias(c) for c in ("broken_lines", "input_rows", "accepted_rows")]
    by_reason = spark.read.parquet(rejects).groupBy("reason").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters")
    )
    return by_reason.select("*", *counts)


@query
def month_refresh(spark, sf):
    """A stored market of which two flight months are written anew, twice; three months are read back."""
    path = _folder(spark, "months")
    daily = stage(_daily(spark, sf), "daily")
    sinks.write_market(daily, path)
    later = daily.filter(F.col("flightDate").between("2022-06-01", "2022-07-31"))
    for _ in range(2):
        sinks.refresh_months(later.withColumn("best_fare", F.col("best_fare") + 1), path)
    rows = sinks.read_months(spark, path, "2022-05", "2022-07")
    return rows.select(
        route_key().alias("route"), "flightDate", "isNonStop", "days_before_departure", "best_fare", "offers_observed"
    )


# --- exploration ---------------------------------------------------------------------


def _rollup(spark, sf) -> DataFrame:
    kept = clean.accepted(clean.typed_offers(fx.offers(spark, sf)), same_day=True)
    return stage(explore.route_day_rollup(clean.with_calendar(kept)), "rollup")


@query
def top_routes(spark, sf):
    return explore.top_routes(_rollup(spark, sf))


@query
def lead_day_avg_fare(spark, sf):
    rollup = _rollup(spark, sf)
    return rounded(explore.lead_day_average(rollup, explore.top_routes(rollup)), "avg_fare")


@query
def busiest_flight_date(spark, sf):
    return explore.busiest_flight_dates(_rollup(spark, sf))


@query
def flight_trajectory(spark, sf):
    rollup = _rollup(spark, sf)
    busiest = explore.busiest_flight_dates(rollup)
    first = explore.top_routes(rollup, 1).drop("n")
    return explore.flight_trajectory(rollup, busiest.join(first, explore.ROUTE, "left_semi"))


@query
def lead_fare_corr(spark, sf):
    rollup = _rollup(spark, sf)
    return rounded(explore.lead_fare_correlation(rollup, explore.top_routes(rollup)), "corr")


# --- calendar, pairs, splits ------------------------------------------------------------


@query
def holiday_dates(spark, sf):
    """Holidays of every year in which a quoted flight departs, with the quotes on that day."""
    per_day = fx.offers(spark, sf).groupBy("flightDate").agg(F.count(F.lit(1)).alias("offers"))
    years = per_day.select(F.year("flightDate").alias("year")).distinct()
    listed = years.select("year", F.inline(dates.holidays_of_year("year")))
    counted = listed.join(per_day.withColumnRenamed("flightDate", "holiday_date"), "holiday_date", "left")
    return counted.select(
        "year", "holiday", "holiday_date", F.coalesce("offers", F.lit(0).cast("bigint")).alias("offers")
    )


@query
def near_holiday_flags(spark, sf):
    return fx.offers(spark, sf).groupBy("flightDate").agg(F.count(F.lit(1)).alias("offers")).select(
        "flightDate",
        "offers",
        dates.is_federal_holiday("flightDate").alias("is_holiday"),
        dates.near_holiday("flightDate").alias("near_holiday"),
        dates.is_weekend(dates.day_of_week(F.col("flightDate"))).alias("is_weekend"),
    )


@query
def asof_anchors(spark, sf):
    return pairs.asof_anchors(_daily(spark, sf)).drop("points")


@query
def remaining_pairs(spark, sf):
    return rounded(pairs.remaining_pairs(_daily(spark, sf)), "rel_fare")


@query
def strided_pairs(spark, sf):
    return rounded(pairs.strided_pairs(_daily(spark, sf)), "rel_fare")


@query
def pair_features(spark, sf):
    rows = attach_features(pairs.remaining_pairs(_daily(spark, sf)))
    return rounded(rows, "rel_fare", "log_current_fare").drop(
        "startingAirport", "destinationAirport", "isNonStop"
    )


def _pairs(spark, sf) -> DataFrame:
    return stage(pairs.remaining_pairs(_daily(spark, sf)), "pairs")


@query
def chrono_split(spark, sf):
    """Size and dates of each part of the chronological split."""
    rows = _pairs(spark, sf)
    parts = split.chrono_split(rows, split.split_cutoffs(rows, "as_of_date"))
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.min("as_of_date").alias("first_date"),
        F.max("as_of_date").alias("last_date"),
    )


@query
def period_slice(spark, sf):
    """Rows of the backtest market in its validation and its test period."""
    daily = _market(spark, sf)
    day, labelled = F.col("searchDate"), daily
    for name, start, end in (("validation", 0.70, 0.85), ("test", 0.85, 1.0)):
        inside = split.within(day, split.period_bounds(daily, start, end), "period_start", "period_end")
        labelled = labelled.withColumn(name, inside)
    period = F.when(F.col("validation"), "validation").when(F.col("test"), "test")
    return labelled.withColumn("period", period).filter("period IS NOT NULL").select(
        "period", "route", "flightDate", "isNonStop", "searchDate", "days_before_departure", "best_fare"
    )


@query
def search_date_slices(spark, sf):
    """Daily rows by search date, cut at the pair cutoffs."""
    daily = stage(_daily(spark, sf), "daily")
    cutoffs = stage(split.split_cutoffs(pairs.asof_anchors(daily), "as_of_date"), "cutoffs")
    both = split.validation_days(daily, cutoffs).withColumn("part", F.lit("validation")).unionByName(
        split.held_out_days(daily, cutoffs).withColumn("part", F.lit("test"))
    )
    return both.select("part", "route", "flightDate", "isNonStop", "days_before_departure", "best_fare")


PAIR_SAMPLE = 25_000


@query
def pair_sample(spark, sf):
    rows = split.pair_sample(_pairs(spark, sf), PAIR_SAMPLE)
    return rows.select(
        "route", "flightDate", "isNonStop", "as_of_days", "days_before_departure", "future_fare"
    )


CURVE_SAMPLE = 300


@query
def curve_sample(spark, sf):
    daily = stage(_daily(spark, sf), "daily")
    sample = split.curve_sample(market.curve_lengths(daily), CURVE_SAMPLE)
    return split.rows_of_curves(daily, sample).select(
        "route", "flightDate", "isNonStop", "days_before_departure", "best_fare"
    )


@query
def train_val_union(spark, sf):
    rows = _pairs(spark, sf)
    parts = split.chrono_split(rows, split.split_cutoffs(rows, "as_of_date"))
    both = parts.filter("part = 'train'").unionByName(parts.filter("part = 'validation'"))
    return both.groupBy("part", "route").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.sum("future_fare"), 6).alias("future_fare")
    )


# --- decisions and simulation ---------------------------------------------------------------


def _candidates(daily: DataFrame, start: float, end: float) -> DataFrame:
    """All decisions of a period: a formula knows every route of the market."""
    return simulate.decision_candidates(daily, split.period_bounds(daily, start, end))


def _decisions(spark, sf) -> DataFrame:
    return simulate.simulate(_candidates(_market(spark, sf), 0.85, 1.0), scorers.dip())


@query
def decision_candidates(spark, sf):
    rows = _candidates(_market(spark, sf), 0.70, 0.85)
    return rows.select(
        "decision_id", "route", "flightDate", "search_date", "isNonStop", "as_of_days", "current_fare",
        "trailing_median_fare",
    )


@query
def trailing_median(spark, sf):
    """Median fare up to each observed day of each curve."""
    from leadcurve.operators.curves import build_curves, median_so_far

    curves = build_curves(_daily(spark, sf)).withColumn("point", F.explode("points"))
    return curves.select(
        route_key().alias("route"),
        "flightDate",
        "isNonStop",
        F.col("point.day").alias("as_of_days"),
        median_so_far(F.col("points"), F.col("point.day")).alias("trailing_median_fare"),
    )


@query
def stable_uniform_draws(spark, sf):
    key = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", F.round(stable_uniform(key), 9).alias("draw")
    )


@query
def simulate_decisions(spark, sf):
    rows = _decisions(spark, sf).select(
        "decision_id", "route", "flight_date", "search_date", "is_nonstop", "as_of_days", "current_fare",
        "trailing_median_fare", "predicted_purchase_days", "predicted_savings", "wait_paid_fare",
        "model_action", "model_paid_fare", "model_savings",
    )
    return rounded(rows, "predicted_savings")


@query
def baseline_policies(spark, sf):
    return _decisions(spark, sf).select(
        "decision_id", "always_buy_action", "always_buy_savings", "always_wait_action",
        "always_wait_savings", "heuristic_action", "heuristic_savings", "random_action",
        "random_savings", "oracle_savings", "actual_best_action",
    )


@query
def matched_random(spark, sf):
    rows = simulate.matched_random(stage(_decisions(spark, sf), "decisions"))
    return rows.select("decision_id", "model_action", "random_action", "random_savings")


# --- policies ------------------------------------------------------------------------------------

SHARES = [
    "wait_rate", "mean_savings", "median_savings", "win_rate", "tie_rate", "loss_rate",
    "mean_loss_when_wrong", "savings_p05",
]
INTERVAL = ["mean_savings_ci95_low", "mean_savings_ci95_high"]


@query
def threshold_search(spark, sf):
    decisions = simulate.simulate(_candidates(_market(spark, sf), 0.70, 0.85), scorers.dip())
    search = stage(policy.threshold_search(decisions), "search")
    selected = F.col("threshold") == policy.select_threshold(search).scalar()
    return rounded(
        search.withColumn("selected", selected), "mean_savings", "wait_rate", "savings_p05"
    )


@query
def policy_summary(spark, sf):
    return rounded(policy.policy_summary(_decisions(spark, sf)), *SHARES)


@query
def bootstrap_ci(spark, sf):
    columns = {name: savings for name, (savings, _) in policy.POLICIES.items()}
    decisions = stage(_decisions(spark, sf), "decisions")
    return rounded(policy.bootstrap_intervals(decisions, columns), *INTERVAL)


@query
def decision_accuracy(spark, sf):
    return rounded(simulate.decision_accuracy(_decisions(spark, sf)), "decision_accuracy")


@query
def full_backtest(spark, sf):
    from leadcurve.plans.backtest import evaluate

    result = evaluate(_market(spark, sf), scorers.dip())
    record = result.record.select("threshold", "decision_accuracy", "booking_decisions")
    rows = result.policies.withColumns({c: record.select(c).scalar() for c in record.columns})
    return rounded(rows, *SHARES, *INTERVAL, "decision_accuracy")


# --- curve metrics -----------------------------------------------------------------------------------


def _scored(spark, sf) -> DataFrame:
    return metrics.scored_curves(_daily(spark, sf), scorers.dip())


@query
def cheapest_day_error(spark, sf):
    return metrics.cheapest_day_error(_scored(spark, sf))


@query
def buy_wait_agreement(spark, sf):
    return metrics.buy_wait_agreement(_scored(spark, sf))


@query
def curve_spearman(spark, sf):
    return rounded(metrics.curve_spearman(_scored(spark, sf)), "spearman")


@query
def timing_score(spark, sf):
    from leadcurve.plans.train import timing_on, timing_rows

    rows = timing_rows(stage(_daily(spark, sf), "daily"))
    score = timing_on(rows, scorers.dip())
    return rounded(score, "buy_wait", "median_best_day_err", "median_spearman", "remain_rmse")


@query
def pair_errors(spark, sf):
    rows = _pairs(spark, sf)
    parts = split.chrono_split(rows, split.split_cutoffs(rows, "as_of_date"))
    return rounded(metrics.pair_errors(parts.filter("part = 'test'"), scorers.dip()), "mae", "rmse")


@query
def evaluation_record(spark, sf):
    from leadcurve.plans.train import evaluate_scorer

    record = evaluate_scorer(stage(_daily(spark, sf), "daily"), scorers.dip(), "dip")
    return rounded(record, *[c for c in record.columns if c.startswith("test_") and c not in (
        "test_rows", "test_cutoff")])


@query
def predicted_vs_actual(spark, sf):
    rows = metrics.predicted_vs_actual(stage(_daily(spark, sf), "daily"), scorers.dip())
    return rounded(rows, "predicted")


@query
def predicted_dollars_vs_actual(spark, sf):
    """The same of a scorer of dollars."""
    rows = metrics.predicted_vs_actual(stage(_daily(spark, sf), "daily"), scorers.dollars(), absolute=True)
    return rounded(rows, "predicted")


# --- recommendation -----------------------------------------------------------------------------------


@query
def request_validation(spark, sf):
    return recommend.validate_requests(fx.requests(spark, sf)).select(
        "request_id", "origin", "destination", "stops", "days_left", "status", "message"
    )


@query
def request_fields(spark, sf):
    return recommend.read_request_fields(fx.raw_requests(spark, sf)).select(
        "request_id", "origin", "destination", "flight_date", "current_price", "stops", "problem"
    )


def _lookups(spark, sf) -> tuple[DataFrame, DataFrame]:
    counts = stage(market.lookup_counts(_daily(spark, sf)), "lookup-counts")
    return stage(market.route_lookups(counts), "routes"), stage(market.global_lookups(counts), "globals")


def _find_published(spark, sf) -> Callable[[DataFrame], DataFrame]:
    """Lookup of published fares on the route pages, then on the city-pair pages."""
    route_pages = extract.parse_route_pages(fx.route_pages(spark, sf))
    city_pages = extract.parse_route_pages(fx.city_pages(spark, sf))

    def find(requests: DataFrame) -> DataFrame:
        cities = requests.withColumns(
            {
                "origin_city": extract.city_of(F.col("origin")),
                "destination_city": extract.city_of(F.col("destination")),
            }
        )
        return extract.published_fare(
            cities,
            route_pages,
            city_pages,
            ["origin", "destination", "block"],
            ["origin_city", "destination_city", "block"],
            ("route page", "city page"),
        ).drop("origin_city", "destination_city")

    return find


@query
def price_pin(spark, sf):
    usable = recommend.validate_requests(fx.requests(spark, sf)).filter("status = 'ok'")
    found = _find_published(spark, sf)(usable)
    return recommend.pin_prices(found, *_lookups(spark, sf)).select(
        "request_id", "route", "pin_price", "price_source", "totalTravelDistance"
    )


def _pinned(spark, sf) -> DataFrame:
    usable = recommend.validate_requests(fx.requests(spark, sf)).filter("status = 'ok'")
    return recommend.pin_prices(usable, *_lookups(spark, sf))


def _curve_columns(curves: DataFrame) -> DataFrame:
    rows = curves.select("request_id", "stops", "days_before_departure", "predicted_fare")
    return rounded(rows, "predicted_fare")


@query
def pinned_curve(spark, sf):
    curves = recommend.predict_curves(_pinned(spark, sf).filter("stops <> 'all'"), scorers.by_stop())
    return _curve_columns(recommend.curve_rows(curves))


@query
def all_stops_curve(spark, sf):
    curves = recommend.predict_curves(_pinned(spark, sf).filter("stops = 'all'"), scorers.by_stop())
    return _curve_columns(recommend.curve_rows(curves))


@query
def buy_window(spark, sf):
    windows = recommend.buy_windows(recommend.curve_points(_pinned(spark, sf), scorers.dip()))
    rows = windows.select("request_id", "best_day", "best_price", "window_start_days", "window_end_days")
    return rounded(rows, "best_price")


@query
def recommendations(spark, sf):
    rows = recommend.recommend_requests(
        fx.requests(spark, sf),
        scorers.dip(),
        *_lookups(spark, sf),
        find_published=_find_published(spark, sf),
    )
    total = F.aggregate("curve", F.lit(0.0), lambda s, p: s + p["predicted_fare"])
    return rows.withColumns(
        {"curve_points": F.size("curve").cast("bigint"), "curve_total": F.round(total, 2)}
    ).drop("curve", "today")


def _served(spark, sf, formula: str, kind: str) -> DataFrame:
    """Answers of a stored bundle whose model is one SQL formula."""
    from leadcurve.plans import serve

    formula_stage = SQLTransformer(statement=f"SELECT *, {formula} AS prediction FROM __THIS__")
    model = Pipeline(stages=[formula_stage]).fit(spark.range(0))
    daily, path = market.with_market_columns(stage(_daily(spark, sf), "daily")), _folder(spark, "bundle")
    record = spark.range(1).select(F.lit("formula").alias("selected_configuration"))
    bundle.save_bundle(path, model, daily, *_lookups(spark, sf), record, kind=kind)
    return serve.answer(fx.requests(spark, sf), bundle.load_bundle(spark, path))


@query
def bundle_answers(spark, sf):
    """Answers of a bundle that was saved and loaded; its model is scored row by row, as a fitted one is."""
    rows = _served(spark, sf, "0.80D + 0.02D * abs(days_before_departure - 10)", bundle.MODEL_KIND)
    total = F.aggregate("curve", F.lit(0.0), lambda s, p: s + p["predicted_fare"])
    return rows.select(
        "request_id", "status", "price_source", "current_price", "expected_best_price", "expected_savings", "wait_days",
        "best_day", "buy_window_start_days", "buy_window_end_days", "message", F.round(total, 2).alias("curve_total"),
    )


@query
def absolute_curve(spark, sf):
    """Curves of a bundle whose model predicts dollars: nothing is pinned to today's fare."""
    rows = _served(spark, sf, "120 + 2.5D * abs(days_before_departure - 10)", bundle.ABSOLUTE_KIND)
    return rows.filter("curve IS NOT NULL").select("request_id", "current_price", F.inline("curve"))


# --- extraction -----------------------------------------------------------------------------------------


def _joined(column: str) -> Column:
    return F.concat_ws("|", column).alias(column)


@query
def itineraries(spark, sf):
    rows = extract.with_curve_pool(extract.itineraries(fx.payloads(spark, sf)))
    return rows.select(
        "payload_id", "id", "airline", "airline_code", _joined("flight_numbers"), "depart_time",
        "arrive_time", "duration_min", "stops", _joined("stop_airports"), "price", "curve_pool",
    )


@query
def itinerary_filter(spark, sf):
    rows = extract.filter_stops(extract.itineraries(fx.payloads(spark, sf)), "connecting")
    return rows.select("payload_id", "id", "stops", "price")


@query
def rejected_payloads(spark, sf):
    return extract.rejected_payloads(fx.payloads_as_fetched(spark, sf)).select("payload_id", "reason")


@query
def clean_from_text(spark, sf):
    """Quotes of a text file, with seats written as decimals or unreadable."""
    return clean.clean_offers(fx.offers_all_text(spark, sf))


@query
def published_deals(spark, sf):
    return extract.published_deals(fx.route_pages(spark, sf))


@query
def headline_fare(spark, sf):
    return fx.route_pages(spark, sf).select(
        "origin", "destination", "block", "fetched_at", extract.headline_fare(F.col("html")).alias("headline")
    )


@query
def nearest_deal(spark, sf):
    requests = recommend.validate_requests(fx.requests(spark, sf)).filter("status <> 'error'")
    pages = extract.parse_route_pages(fx.route_pages(spark, sf))
    rows = extract.nearest_deal(requests, pages, ["origin", "destination", "block"])
    deal = F.col("deal")
    return rows.select(
        "request_id",
        extract.match_name(deal["tier"]).alias("match"),
        deal["price"].alias("price"),
        deal["date"].alias("deal_date"),
        deal["stops"].alias("deal_stops"),
        deal["carrier"].alias("carrier"),
    )


@query
def published_fare(spark, sf):
    requests = recommend.validate_requests(fx.requests(spark, sf)).filter("status <> 'error'")
    return _find_published(spark, sf)(requests).select(
        "request_id", "published_price", "match", "live_matched_date", "published_stops", "published_carrier", "source"
    )


# --- model ------------------------------------------------------------------------------------------------


# Configurations of the registered queries: the operator's own three have 300 to 500 trees,
# which take hours on one machine and are no other code
QUERY_CONFIGURATIONS = {
    "default": {"maxIter": 6, "stepSize": 0.3, "maxDepth": 5, "minInstancesPerNode": 20},
    "more trees, lower lr": {"maxIter": 12, "stepSize": 0.2, "maxDepth": 5, "minInstancesPerNode": 20},
    "shallower + regularized": {"maxIter": 6, "stepSize": 0.25, "maxDepth": 4, "minInstancesPerNode": 50},
}


@query
def train_gbt(spark, sf):
    """Three configurations: fit, select on validation, test figures."""
    from leadcurve.plans.train import train

    return train(stage(_daily(spark, sf), "daily"), QUERY_CONFIGURATIONS).record


@query
def train_checks(spark, sf):
    """What must hold of a training whatever its trees: sizes, cutoffs, range, and better than no change.

    Both models, the selected one and the one refitted on training and validation pairs, are
    scored on all test pairs.
    """
    from leadcurve.plans.train import scorer_of, train

    daily = stage(_daily(spark, sf), "daily")
    result = train(daily, QUERY_CONFIGURATIONS)
    rows = stage(pairs.remaining_pairs(daily), "pairs")
    parts = split.chrono_split(rows, split.split_cutoffs(rows, "as_of_date"))
    flat = scorers.formula_scorer(lambda days, as_of, nonstop: F.lit(1.0))
    unchanged = stage(metrics.pair_errors(parts.filter("part = 'test'"), flat), "unchanged").first()
    scored = scorer_of(result.model)(attach_features(rows))
    bounds = scored.agg(F.min("predicted_relative"), F.max("predicted_relative"), F.count("predicted_relative")).first()
    refit = result.refit_errors.first()
    return result.record.select(
        "train_rows", "validation_rows", "test_rows", "train_cutoff", "test_cutoff",
        F.lit(refit["pairs"]).alias("refit_pairs"),
        F.lit(bounds[2]).alias("scored_pairs"),
        F.round(F.lit(unchanged["rmse"]), 6).alias("unchanged_rmse"),
        F.col("selected_configuration").isin(*QUERY_CONFIGURATIONS).alias("selected_is_known"),
        F.lit(bounds[0] >= 0.3 and bounds[1] <= 3.0).alias("in_range"),
        (F.col("test_pair_rmse_dollars") < unchanged["rmse"]).alias("selected_beats_unchanged"),
        F.lit(refit["rmse"] < unchanged["rmse"]).alias("refit_beats_unchanged"),
    )
