from datetime import date
from statistics import median

import pytest
from pyspark.sql import functions as F

from leadcurve.operators import clean, explore, market
from leadcurve.plans import ingest
from leadcurve.sources import offers as source
from leadcurve.sources import sinks
from tests.helpers import OFFER_SCHEMA, offer, offers


def messy(spark):
    return offers(
        spark,
        [
            offer("2022-09-01", "2022-09-20", 220.0),
            offer("2022-09-01", "2022-09-20", 190.0, distance=None),
            offer("2022-09-01", "2022-09-20", 195.0, origin="atl", distance=None),
            offer("2022-09-01", "2022-09-20", 20.0),
            offer("2022-09-01", "2022-09-20", 5000.0),
            offer("2022-09-01", "2022-09-20", None),
            offer("2022-09-20", "2022-09-20", 100.0),
            offer("2022-09-21", "2022-09-20", 100.0),
            offer(None, "2022-09-20", 100.0),
            offer("2022-09-02", "2022-09-20", 100.0, seats=-1),
            offer("2022-09-02", "2022-09-20", 300.0, seats=None, nonstop=None, distance=1900.0),
        ],
    )


def test_strict_and_same_day_rules(spark):
    kept = clean.clean_offers(messy(spark)).collect()
    assert sorted(r.totalFare for r in kept) == [190.0, 195.0, 220.0, 300.0]
    legacy = clean.clean_offers(messy(spark), same_day=True, upper=False).collect()
    assert sorted(r.totalFare for r in legacy) == [100.0, 190.0, 195.0, 220.0, 300.0]
    by_fare = {r.totalFare: r for r in kept}
    # medians go by the source's spelling: ATL knows distances, atl does not
    assert by_fare[190.0].totalTravelDistance == 1920.0
    assert by_fare[195.0].totalTravelDistance is None
    assert by_fare[195.0].startingAirport == "ATL"
    first = by_fare[220.0]
    assert (first.days_before_departure, first.departure_day_of_week, first.departure_month) == (19, 2, 9)
    assert first.search_day_of_week == 4


def test_profiles_count_each_fault(spark):
    row = clean.clean_profile(messy(spark)).first()
    assert (row.input_rows, row.accepted_rows, row.rejected_rows) == (11, 4, 7)
    assert (row.invalid_fares, row.invalid_dates, row.invalid_seats) == (3, 3, 1)
    assert row.missing_distance_imputed == 2
    assert clean.quality_profile(messy(spark)).first().invalid_dates == 3
    impact = clean.cleaning_impact(messy(spark)).first()
    assert (impact.bad_date_rows, impact.rows_after, impact.rows_dropped) == (1, 5, 6)
    assert impact.dropped_percent == pytest.approx(600 / 11)


def test_daily_table_from_clean_and_from_raw_are_equal(spark):
    raw = messy(spark)
    one = market.daily_best_fare(clean.clean_offers(raw))
    two = market.daily_from_offers(raw)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    rows = {(r.days_before_departure, r.isNonStop): r for r in one.collect()}
    assert len(rows) == 2
    main = rows[(19, False)]
    assert (main.best_fare, main.offers_observed) == (190.0, 3)
    assert main.totalTravelDistance == median([1940.0, 1920.0])
    assert rows[(18, None)].best_fare == 300.0  # a missing stop type is kept


def test_hot_group_is_folded_before_the_median(spark):
    rows = [offer("2022-09-01", "2022-09-20", 100.0 + i % 7, distance=float(1000 + i % 3)) for i in range(900)]
    rows += [offer("2022-09-01", f"2022-09-{10 + i}", 90.0, distance=800.0) for i in range(5)]
    daily = {r.flightDate: r for r in market.daily_from_offers(offers(spark, rows)).collect()}
    hot = daily[date(2022, 9, 20)]
    assert (hot.best_fare, hot.offers_observed, hot.totalTravelDistance) == (100.0, 900, 1001.0)


def test_lenient_market_reads_text(spark):
    rows = [
        ("2022-09-01", "2022-09-20", "atl", "LAX", "220", "TRUE", "1940"),
        ("2022-09-01", "2022-09-20", "atl", "LAX", "190", "true", "x"),
        ("2022-09-01", "2022-09-20", "atl", "LAX", "180", "maybe", "1940"),
        ("bad", "2022-09-20", "atl", "LAX", "170", "False", "1940"),
        ("2022-09-01", "2022-09-20", "atl", "LAX", "n/a", "False", "1940"),
        ("2022-09-01", "2022-09-20", None, "LAX", "150", "False", "1940"),
    ]
    schema = (
        "searchDate string, flightDate string, startingAirport string, destinationAirport string, "
        "totalFare string, isNonStop string, totalTravelDistance string"
    )
    daily = market.daily_market(spark.createDataFrame(rows, schema)).collect()
    assert len(daily) == 1
    assert (daily[0].best_fare, daily[0].route, daily[0].isNonStop) == (190.0, "atl-LAX", True)
    assert daily[0].totalTravelDistance == 1940.0


def test_lookups_counts_and_stats(spark):
    daily = market.daily_from_offers(messy(spark))
    counts = market.stop_counts(daily).first()
    assert (counts["rows"], counts.nonstop_rows, counts.connecting_rows) == (2, 0, 2)
    stats = market.table_stats(daily).first()
    assert (stats["rows"], stats.routes) == (2, 1)
    assert (stats.search_date_min, stats.search_date_max) == (date(2022, 9, 1), date(2022, 9, 2))
    counted = market.lookup_counts(daily)
    look = market.route_lookups(counted).first()
    assert tuple(look) == ("ATL-LAX", 1915.0, 245.0)
    overall = market.global_lookups(counted).first()
    assert tuple(overall) == (245.0, 1915.0)


def test_correlation_of_a_constant_is_null(spark):
    rows = [offer(f"2022-09-0{i}", "2022-09-20", 100.0) for i in range(1, 6)]
    rows += [offer(f"2022-09-0{i}", "2022-09-20", 100.0 + i, origin="BOS") for i in range(1, 6)]
    cleaned = clean.clean_offers(offers(spark, rows))
    rollup = explore.route_day_rollup(cleaned)
    corr = {r.startingAirport: r["corr"] for r in explore.lead_fare_correlation(rollup, explore.top_routes(rollup)).collect()}
    assert corr["ATL"] is None
    assert corr["BOS"] == pytest.approx(-1.0)
    busiest = explore.busiest_flight_dates(rollup).collect()
    assert all(r.flightDate == date(2022, 9, 20) and r.n == 5 for r in busiest)


def test_files_round_trip(spark, tmp_path):
    raw = messy(spark)
    csv, clean_path, daily_path = (str(tmp_path / n) for n in ("raw.csv", "clean.parquet", "daily.parquet"))
    # an extra column and another order: columns are found by name
    raw.selectExpr("'x' AS legId", "isBasicEconomy", "totalTravelDistance", "seatsRemaining", "isNonStop",
                   "totalFare", "destinationAirport", "startingAirport", "flightDate", "searchDate"
                   ).coalesce(1).write.option("header", True).csv(csv)
    profile = ingest.ingest(spark, csv, clean_path).first()
    assert (profile.accepted_rows, profile.rejected_rows) == (4, 7)
    stats = ingest.build_daily_table(spark, clean_path, daily_path).first()
    assert stats["rows"] == 2
    months = {r.flight_month for r in spark.read.parquet(clean_path).select("flight_month").collect()}
    assert months == {"2022-09"}
    assert source.load_offers(spark, clean_path).count() == 4
    sinks.write_decisions(raw, str(tmp_path / "d"))
    assert source.load_offers(spark, str(tmp_path / "d"), fmt="csv").count() == 11


def test_schema_check_names_missing_columns(spark):
    with pytest.raises(ValueError, match="missing required columns: isBasicEconomy, seatsRemaining"):
        source.require_columns(messy(spark).drop("seatsRemaining", "isBasicEconomy").columns)
    assert source.require_backtest_columns(messy(spark).columns) == sorted(messy(spark).columns)
    assert OFFER_SCHEMA.count(",") == 8


def test_lines_that_do_not_fit_are_rejected_by_the_parser(spark, tmp_path):
    header = "searchDate,flightDate,startingAirport,destinationAirport,totalFare,isNonStop,seatsRemaining,totalTravelDistance,isBasicEconomy"
    good = "2022-04-16,2022-05-20,ATL,LAX,250.5,True,7,1940,False"
    lines = [header, good, "2022-04-16,2022-05-20,ATL", good + ",x", '"' + good, good.replace("ATL", '"A,T"'), "", good.replace("250.5", "n/a"), '"a,b",c']
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "one.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "q" / "two.csv").write_text(header + "\n" + good + "\n")
    path = str(tmp_path / "q")
    rows = source.load_offers(spark, path, "csv")
    assert sorted(r.startingAirport for r in rows.collect()) == ["A,T", "ATL", "ATL", "ATL"] and source.BROKEN not in rows.columns
    rejected = source.rejected_lines(source.csv_lines(spark, path))
    assert sorted(map(tuple, rejected.collect())) == sorted([
        ("2022-04-16,2022-05-20,ATL", "short"), (good + ",x", "long"), ('"' + good, "open quote"), ('"a,b",c', "short")])
    assert rejected.count() == 4
    profile = ingest.ingest(spark, path, str(tmp_path / "clean"), rejects_path=str(tmp_path / "rejects"), fmt="csv").first()
    assert (profile.broken_lines, profile.input_rows, profile.accepted_rows, profile.invalid_fares) == (4, 4, 3, 1)
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == profile.broken_lines


def test_months_are_refreshed_and_pruned(spark, tmp_path):
    path = str(tmp_path / "months")
    days = ["2022-05-20", "2022-06-20", "2022-06-21", "2022-07-20"]
    rows = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "day string, fare double")
    table = rows.select(F.col("day").cast("date").alias("flightDate"), "fare")
    sinks.write_market(table, path)
    june = table.filter(F.month("flightDate") == 6).withColumn("fare", F.col("fare") + 100)
    for _ in range(2):
        sinks.refresh_months(june, path)
    assert sorted(r.fare for r in spark.read.parquet(path).collect()) == [0.0, 3.0, 101.0, 102.0]
    kept = sinks.read_months(spark, path, "2022-06", "2022-06")
    assert sorted(r.fare for r in kept.collect()) == [101.0, 102.0]
    scan = kept._jdf.queryExecution().executedPlan().toString()
    assert "flight_month" in scan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_text_is_parsed_once_not_for_each_rule(spark, monkeypatch):
    from leadcurve.session import stage

    parsed = []

    def recording(df, name):
        if not parsed:
            parsed.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df, name)

    text = messy(spark).select(*[F.col(c).cast("string") for c in messy(spark).columns])
    monkeypatch.setattr(clean, "stage", recording)
    found = clean.clean_offers(text)
    # no rule stands beside the parsing: one there would repeat the casts it names
    assert "Filter" not in parsed[0]
    monkeypatch.undo()
    assert sorted(map(str, found.collect())) == sorted(map(str, clean.clean_offers(messy(spark)).collect()))
