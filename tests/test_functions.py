import hashlib
import math
from datetime import date, timedelta

from pyspark.sql import functions as F

from leadcurve.functions import dates, fares, keys, text


def brute_holidays(year):
    def nth(month, weekday, n):
        days = [date(year, month, 1) + timedelta(days=i) for i in range(31)]
        return [d for d in days if d.month == month and d.isoweekday() % 7 == weekday][n]

    return {
        date(year, 1, 1), date(year, 6, 19), date(year, 7, 4), date(year, 11, 11), date(year, 12, 25),
        nth(1, 1, 2), nth(2, 1, 2), nth(5, 1, -1), nth(9, 1, 0), nth(10, 1, 1), nth(11, 4, 3),
    }


def test_holidays_and_nearness_match_brute_force(spark):
    known = set().union(*[brute_holidays(y) for y in range(2018, 2032)])
    days = spark.sql("SELECT explode(sequence(DATE'2019-01-01', DATE'2030-12-31')) AS d")
    rows = days.select(
        "d",
        dates.is_federal_holiday("d").alias("holiday"),
        dates.near_holiday("d").alias("near"),
        dates.near_holiday("d", 10).alias("near10"),
        dates.day_of_week(F.col("d")).alias("dow"),
        dates.is_weekend(dates.day_of_week(F.col("d"))).alias("weekend"),
    ).collect()
    for r in rows:
        gap = min(abs((r.d - h).days) for h in known)
        assert r.holiday == (gap == 0), r
        assert r.near == (gap <= 3), r
        assert r.near10 == (gap <= 10), r
        assert r.dow == (r.d.weekday() + 1) % 7
        assert r.weekend == (r.d.weekday() >= 5)
    listed = spark.sql("SELECT explode(sequence(2019, 2030)) AS y").select(
        F.inline(dates.holidays_of_year("y"))
    )
    assert {r.holiday_date for r in listed.collect()} == {h for h in known if 2019 <= h.year <= 2030}


def test_known_dates(spark):
    row = spark.sql(
        "SELECT DATE'2022-11-24' AS a, DATE'2022-07-02' AS b, DATE'2022-07-20' AS c, DATE'2022-12-30' AS e"
    ).select(
        dates.is_federal_holiday("a"), dates.near_holiday("b"), dates.near_holiday("c"), dates.near_holiday("e")
    ).first()
    assert list(row) == [True, True, False, True]


def test_stable_draws(spark):
    names = [f"ATL-LAX|2022-10-0{i}|False|{i}" for i in range(1, 9)]
    df = spark.createDataFrame([(n,) for n in names], "k string")
    rows = df.select(
        "k", keys.stable_uniform(F.col("k")).alias("u"), keys.stable_slot(F.col("k"), F.lit(7)).alias("s")
    ).collect()
    for r in rows:
        digest = hashlib.sha256(r.k.encode()).digest()
        assert r.u == int.from_bytes(digest[:8], "big") / (2**64 - 1)
        assert r.s == int(hashlib.md5(r.k.encode()).hexdigest()[:8], 16) % 7


def test_stops_spellings(spark):
    cases = {
        "ALL": "all", "": "all", " Non-Stop ": "nonstop", "non_stop only": "nonstop", "stop": "connecting",
        "Stops": "connecting", "connecting": "connecting", "two": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = {r.s: r.n for r in df.select("s", keys.normalize_stops(F.col("s")).alias("n")).collect()}
    assert got == cases
    absent = spark.createDataFrame([(None, True), (None, False), (None, None)], "s string, n boolean")
    chosen = absent.select(keys.normalize_stops(F.col("s"), F.col("n")).alias("x")).collect()
    assert [r.x for r in chosen] == ["nonstop", "all", "all"]


def test_fares_and_text(spark):
    row = spark.sql("SELECT 160D AS f, 200D AS c, 0.5D AS tiny, DATE'2026-03-02' AS s, DATE'2026-03-05' AS e").select(
        fares.relative_fare(F.col("f"), F.col("c")).alias("rel"),
        fares.relative_fare(F.col("c"), F.col("tiny")).alias("high"),
        fares.log_fare(F.col("tiny")).alias("zero"),
        fares.log_fare(F.col("c")).alias("log"),
        fares.cents(F.lit(166.875)).alias("cents"),
        text.window_text(F.col("s"), F.col("s")).alias("by"),
        text.window_text(F.col("s"), F.col("e")).alias("between"),
    ).first()
    assert row.rel == 0.8 and row.high == 3.0 and row.zero == 0.0
    assert math.isclose(row.log, math.log(200)) and row.cents == 166.88
    assert row.by == "by Mar 2" and row.between == "between Mar 2 and Mar 5"
