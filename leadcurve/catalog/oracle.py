"""The catalog's queries as DuckDB SQL over the driver's tables.

Each fragment is a named table expression; ``_sql`` puts those a query needs into
one WITH clause.
"""

from __future__ import annotations

from leadcurve import constants as C
from leadcurve.catalog.fixtures import AIRPORT, PAGE_BLOCK
from leadcurve.catalog.queries import CURVE_SAMPLE, PAIR_SAMPLE
from leadcurve.operators.policy import POISSON_BOUNDS

# name -> (fragments it needs, SQL)
_FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def _fragment(name: str, *needs: str, sql: str) -> None:
    _FRAGMENTS[name] = (needs, sql)


def _sql(final: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in _FRAGMENTS[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{name} AS ({_FRAGMENTS[name][1]})" for name in ordered)
    if final.startswith("WITH "):
        return f"WITH {parts},\n{final.removeprefix('WITH ')}"
    return f"WITH {parts}\n{final}"


# --- quotes -----------------------------------------------------------------------------

_fragment(
    "keyed",
    sql=f"""
SELECT *, CAST(l_suppkey % 4 AS INTEGER) AS oi,
  CAST((l_suppkey + 1 + l_partkey % 3) % 4 AS INTEGER) AS di,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 63 AS INTEGER) - 1 AS lead_raw,
  DATE '2022-05-01' + CAST(5 * (l_orderkey % 30) AS INTEGER) AS fd,
  CAST(l_orderkey // {PAGE_BLOCK} AS BIGINT) AS block
FROM lineitem""",
)
_fragment(
    "offers_keyed",
    "keyed",
    sql=f"""
SELECT fd - lead_raw AS searchDate, fd AS flightDate,
  {AIRPORT.format('oi')} AS startingAirport, {AIRPORT.format('di')} AS destinationAirport,
  CASE WHEN l_quantity = 1 THEN 10e0 WHEN l_quantity = 50 THEN 6000e0
       WHEN l_quantity = 49 AND l_linenumber = 3 THEN NULL
       ELSE CAST(floor(l_extendedprice / 400) + 80 + 2 * abs(lead_raw - 21) AS DOUBLE) END AS totalFare,
  l_linenumber % 2 = 0 AS isNonStop,
  CAST(CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL
            WHEN l_linenumber = 1 AND l_tax = 0.08e0 THEN -1 ELSE l_quantity % 10 END AS INTEGER) AS seatsRemaining,
  CASE WHEN l_discount = 0 THEN NULL
       ELSE CAST(400 + 150 * (oi + di) + l_suppkey % 7 AS DOUBLE) END AS totalTravelDistance,
  l_returnflag = 'R' AS isBasicEconomy, l_partkey
FROM keyed""",
)
_fragment("offers", "offers_keyed", sql="SELECT * EXCLUDE (l_partkey) FROM offers_keyed")
_fragment(
    "offers_mixed",
    "offers_keyed",
    sql="""
SELECT * EXCLUDE (l_partkey) REPLACE (CASE WHEN l_partkey % 11 = 0 THEN lower(startingAirport)
  ELSE startingAirport END AS startingAirport) FROM offers_keyed""",
)


def _clean(source: str, date_rule: str, upper: bool) -> str:
    end = "upper({0}) AS {0}" if upper else "{0}"
    return f"""
SELECT searchDate, flightDate, {end.format('startingAirport')}, {end.format('destinationAirport')},
  totalFare, isNonStop, seatsRemaining,
  coalesce(totalTravelDistance, median(totalTravelDistance)
    OVER (PARTITION BY {source}.startingAirport, {source}.destinationAirport)) AS totalTravelDistance,
  isBasicEconomy,
  CAST(date_diff('day', searchDate, flightDate) AS INTEGER) AS days_before_departure,
  CAST(dayofweek(flightDate) AS INTEGER) AS departure_day_of_week,
  CAST(month(flightDate) AS INTEGER) AS departure_month,
  CAST(dayofweek(searchDate) AS INTEGER) AS search_day_of_week
FROM {source}
WHERE totalFare > 20 AND totalFare < 5000 AND {date_rule}
  AND (seatsRemaining IS NULL OR seatsRemaining >= 0)"""


_fragment("clean", "offers", sql=_clean("offers", "flightDate > searchDate", True))
_fragment("clean_mixed", "offers_mixed", sql=_clean("offers_mixed", "flightDate > searchDate", True))
_fragment("clean_legacy", "offers_mixed", sql=_clean("offers_mixed", "flightDate >= searchDate", False))
_fragment("seen", "offers", sql=_clean("offers", "flightDate >= searchDate", False))


def _daily(source: str) -> str:
    return f"""
SELECT startingAirport, destinationAirport, flightDate, days_before_departure, departure_day_of_week,
  departure_month, search_day_of_week, isNonStop, median(totalTravelDistance) AS totalTravelDistance,
  min(totalFare) AS best_fare, CAST(count(*) AS BIGINT) AS offers_observed
FROM {source} GROUP BY ALL"""


_fragment("daily_mixed", "clean_mixed", sql=_daily("clean_mixed"))
_fragment("daily_plain", "clean", sql=_daily("clean"))
_fragment(
    "daily",
    "daily_plain",
    sql="""
SELECT *, startingAirport || '-' || destinationAirport AS route,
  flightDate - days_before_departure AS searchDate FROM daily_plain""",
)


def _market(search: str, fare: str, stop: str, where: str) -> str:
    return f"""
SELECT startingAirport, destinationAirport, flightDate, s AS searchDate, stop AS isNonStop,
  CAST(date_diff('day', s, flightDate) AS INTEGER) AS days_before_departure,
  min(fare) AS best_fare, median(totalTravelDistance) AS totalTravelDistance,
  startingAirport || '-' || destinationAirport AS route,
  CAST(dayofweek(flightDate) AS INTEGER) AS departure_day_of_week,
  CAST(month(flightDate) AS INTEGER) AS departure_month,
  CAST(dayofweek(s) AS INTEGER) AS search_day_of_week
FROM (SELECT *, {search} AS s, {fare} AS fare, {stop} AS stop FROM offers_keyed)
WHERE {where} fare > 20 AND fare < 5000 AND s < flightDate AND stop IS NOT NULL
GROUP BY startingAirport, destinationAirport, flightDate, s, stop"""


_fragment("market", "offers_keyed", sql=_market("searchDate", "totalFare", "isNonStop", ""))
_fragment(
    "market_text",
    "offers_keyed",
    sql=_market(
        "searchDate",
        "totalFare",
        "CASE WHEN l_partkey % 83 = 0 THEN NULL ELSE isNonStop END",
        "l_partkey % 97 <> 0 AND l_partkey % 89 <> 0 AND",
    ),
)

_BAD_FARE = "totalFare IS NULL OR totalFare <= 20 OR totalFare >= 5000"
_BAD_DATE = "searchDate IS NULL OR flightDate IS NULL OR flightDate <= searchDate"
_OK_SEATS = "(seatsRemaining IS NULL OR seatsRemaining >= 0)"

_fragment(
    "legacy_counts",
    "offers",
    sql=f"""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE {_BAD_FARE}) AS bad_fare_rows,
  count(*) FILTER (WHERE flightDate < searchDate) AS bad_date_rows,
  count(*) FILTER (WHERE seatsRemaining < 0) AS bad_seats_rows,
  count(*) FILTER (WHERE totalTravelDistance IS NULL) AS missing_distance_rows,
  count(*) FILTER (WHERE NOT ({_BAD_FARE}) AND flightDate >= searchDate AND {_OK_SEATS}) AS rows_after
FROM offers""",
)

ORACLE: dict[str, str] = {
    "fixture_offers": _sql("SELECT * FROM offers", "offers"),
    "clean_strict": _sql("SELECT * FROM clean_mixed", "clean_mixed"),
    "clean_same_day": _sql("SELECT * FROM clean_legacy", "clean_legacy"),
    "quality_profile": _sql(
        f"""SELECT count(*) AS input_rows, count(*) FILTER (WHERE {_BAD_FARE}) AS invalid_fares,
count(*) FILTER (WHERE {_BAD_DATE}) AS invalid_dates,
count(*) FILTER (WHERE seatsRemaining < 0) AS invalid_seats,
count(*) FILTER (WHERE totalTravelDistance IS NULL) AS missing_distance FROM offers""",
        "offers",
    ),
    "clean_profile": _sql(
        f"""SELECT count(*) AS input_rows, (SELECT count(*) FROM clean) AS accepted_rows,
count(*) - (SELECT count(*) FROM clean) AS rejected_rows,
count(*) FILTER (WHERE {_BAD_FARE}) AS invalid_fares,
count(*) FILTER (WHERE {_BAD_DATE}) AS invalid_dates,
count(*) FILTER (WHERE seatsRemaining < 0) AS invalid_seats,
count(*) FILTER (WHERE totalTravelDistance IS NULL) AS missing_distance_imputed FROM offers""",
        "clean",
    ),
    "cleaning_impact": _sql(
        """SELECT *, total_rows - rows_after AS rows_dropped,
round(CAST(total_rows - rows_after AS DOUBLE) / total_rows * 100, 6) AS dropped_percent FROM legacy_counts""",
        "legacy_counts",
    ),
    "daily_best_fare": _sql("SELECT * FROM daily_mixed", "daily_mixed"),
    "lenient_market": _sql("SELECT * FROM market_text", "market_text"),
    "table_stats": _sql(
        """SELECT count(*) AS rows, count(DISTINCT route) AS routes, min(searchDate) AS search_date_min,
max(searchDate) AS search_date_max FROM daily""",
        "daily",
    ),
    "stop_counts": _sql(
        """SELECT count(*) AS rows, count(*) FILTER (WHERE isNonStop) AS nonstop_rows,
count(*) - count(*) FILTER (WHERE isNonStop) AS connecting_rows FROM daily""",
        "daily",
    ),
    "route_lookups": _sql(
        """SELECT route, median(totalTravelDistance) AS route_distance, median(best_fare) AS route_median_fare,
(SELECT median(best_fare) FROM daily) AS global_median_fare,
(SELECT median(totalTravelDistance) FROM daily) AS global_median_distance FROM daily GROUP BY route""",
        "daily",
    ),
    "curve_lengths": _sql(
        """SELECT route, flightDate, isNonStop, count(*) AS n FROM daily
GROUP BY ALL HAVING count(*) >= 8""",
        "daily",
    ),
}

_fragment(
    "collapsed",
    "daily",
    sql="""
SELECT startingAirport, destinationAirport, flightDate, days_before_departure, departure_day_of_week,
  departure_month, search_day_of_week, false AS isNonStop, best_fare, totalTravelDistance
FROM daily
QUALIFY row_number() OVER (PARTITION BY route, flightDate, days_before_departure
  ORDER BY best_fare, isNonStop) = 1""",
)
ORACLE["stop_collapse"] = _sql("SELECT * FROM collapsed", "collapsed")

# --- exploration -----------------------------------------------------------------------------

_fragment(
    "top5",
    "seen",
    sql="""
SELECT startingAirport, destinationAirport, count(*) AS n FROM seen GROUP BY ALL
ORDER BY n DESC, startingAirport, destinationAirport LIMIT 5""",
)
_fragment(
    "busiest",
    "seen",
    sql="""
SELECT startingAirport, destinationAirport, flightDate, count(*) AS n FROM seen
GROUP BY startingAirport, destinationAirport, flightDate
QUALIFY row_number() OVER (PARTITION BY startingAirport, destinationAirport
  ORDER BY count(*) DESC, flightDate) = 1""",
)
ORACLE |= {
    "top_routes": _sql("SELECT * FROM top5", "top5"),
    "lead_day_avg_fare": _sql(
        """SELECT startingAirport, destinationAirport, days_before_departure, round(avg(totalFare), 6) AS avg_fare
FROM seen SEMI JOIN top5 USING (startingAirport, destinationAirport)
WHERE days_before_departure BETWEEN 0 AND 60 GROUP BY ALL""",
        "top5",
    ),
    "busiest_flight_date": _sql("SELECT * FROM busiest", "busiest"),
    "flight_trajectory": _sql(
        """SELECT startingAirport, destinationAirport, flightDate, days_before_departure, min(totalFare) AS min_fare
FROM seen SEMI JOIN (SELECT * FROM busiest ORDER BY (SELECT count(*) FROM seen s
  WHERE s.startingAirport = busiest.startingAirport AND s.destinationAirport = busiest.destinationAirport) DESC,
  startingAirport, destinationAirport LIMIT 1) USING (startingAirport, destinationAirport, flightDate)
GROUP BY ALL""",
        "busiest",
    ),
    "lead_fare_corr": _sql(
        """SELECT startingAirport, destinationAirport, round(corr(days_before_departure, totalFare), 6) AS corr
FROM seen SEMI JOIN top5 USING (startingAirport, destinationAirport) GROUP BY ALL""",
        "top5",
    ),
}

# --- calendar --------------------------------------------------------------------------------------

_fragment("flight_days", "offers", sql="SELECT flightDate, count(*) AS offers FROM offers GROUP BY flightDate")
_fragment(
    "flight_years",
    "flight_days",
    sql="SELECT DISTINCT CAST(year(flightDate) AS INTEGER) AS year FROM flight_days",
)
_fragment(
    "near_years",
    "flight_years",
    sql="""
SELECT DISTINCT CAST(year + unnest([-1, 0, 1]) AS INTEGER) AS year FROM flight_years""",
)
_fragment(
    "year_days",
    "near_years",
    sql="""
SELECT year, CAST(make_date(year, 1, 1) + CAST(unnest(range(0, 366)) AS INTEGER) AS DATE) AS day FROM near_years""",
)
_fragment(
    "weekday_places",
    "year_days",
    sql="""
SELECT year, day, month(day) AS m, dayofweek(day) AS wd,
  row_number() OVER (PARTITION BY year, month(day), dayofweek(day) ORDER BY day) AS nth,
  row_number() OVER (PARTITION BY year, month(day), dayofweek(day) ORDER BY day DESC) AS from_end
FROM year_days WHERE year(day) = year""",
)
_fragment(
    "holidays",
    "weekday_places",
    sql="""
SELECT CAST(year AS INTEGER) AS year, holiday, day AS holiday_date FROM (
  SELECT year, day, CASE
    WHEN m = 1 AND day(day) = 1 THEN 'New Year'
    WHEN m = 6 AND day(day) = 19 THEN 'Juneteenth'
    WHEN m = 7 AND day(day) = 4 THEN 'Independence'
    WHEN m = 11 AND day(day) = 11 THEN 'Veterans'
    WHEN m = 12 AND day(day) = 25 THEN 'Christmas'
    WHEN m = 1 AND wd = 1 AND nth = 3 THEN 'King'
    WHEN m = 2 AND wd = 1 AND nth = 3 THEN 'Presidents'
    WHEN m = 5 AND wd = 1 AND from_end = 1 THEN 'Memorial'
    WHEN m = 9 AND wd = 1 AND nth = 1 THEN 'Labor'
    WHEN m = 10 AND wd = 1 AND nth = 2 THEN 'Columbus'
    WHEN m = 11 AND wd = 4 AND nth = 4 THEN 'Thanksgiving' END AS holiday FROM weekday_places)
WHERE holiday IS NOT NULL""",
)
_NEAR = "EXISTS (SELECT 1 FROM holidays h WHERE abs(date_diff('day', h.holiday_date, {0})) <= 3)"
ORACLE |= {
    "holiday_dates": _sql(
        """SELECT year, holiday, holiday_date, coalesce(offers, 0) AS offers FROM holidays
JOIN flight_years USING (year) LEFT JOIN flight_days ON flightDate = holiday_date""",
        "holidays",
    ),
    "near_holiday_flags": _sql(
        f"""SELECT flightDate, offers,
EXISTS (SELECT 1 FROM holidays h WHERE h.holiday_date = flightDate) AS is_holiday,
{_NEAR.format('flightDate')} AS near_holiday,
dayofweek(flightDate) IN (0, 6) AS is_weekend FROM flight_days""",
        "holidays",
    ),
}

# --- pairs -------------------------------------------------------------------------------------------

_fragment("known", "daily", sql="SELECT * FROM daily WHERE isNonStop IS NOT NULL")
_fragment(
    "anchors",
    "known",
    sql="""
SELECT * FROM known QUALIFY days_before_departure IN (21, 14, 7) OR days_before_departure =
  max(days_before_departure) OVER (PARTITION BY route, flightDate, isNonStop)""",
)


def _pairs(anchors: str) -> str:
    return f"""
SELECT a.route, a.startingAirport, a.destinationAirport, a.flightDate, a.isNonStop, a.searchDate AS as_of_date,
  a.days_before_departure AS as_of_days, b.days_before_departure, a.best_fare AS current_fare,
  b.best_fare AS future_fare,
  round(least(3e0, greatest(0.3e0, b.best_fare / a.best_fare)), 6) AS rel_fare,
  a.departure_day_of_week, a.departure_month, b.search_day_of_week, a.totalTravelDistance
FROM {anchors} a JOIN known b ON a.route = b.route AND a.flightDate = b.flightDate AND a.isNonStop = b.isNonStop
WHERE b.days_before_departure <= a.days_before_departure AND a.best_fare > 1"""


_fragment("pairs", "anchors", sql=_pairs("anchors"))
_fragment(
    "strided",
    "known",
    sql=_pairs("(SELECT * FROM known WHERE days_before_departure % 2 = 0 OR days_before_departure <= 7)"),
)
_fragment(
    "pair_dates",
    "pairs",
    sql="""
SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n
FROM (SELECT DISTINCT as_of_date AS d FROM pairs)""",
)
_fragment(
    "cutoffs",
    "pair_dates",
    sql="""
SELECT max(d) FILTER (WHERE i = floor(n * 0.7e0)) AS train_cutoff,
  max(d) FILTER (WHERE i = floor(n * 0.85e0)) AS test_cutoff FROM pair_dates""",
)
_fragment(
    "parts",
    "pairs",
    "cutoffs",
    sql="""
SELECT pairs.*, CASE WHEN as_of_date < train_cutoff THEN 'train'
  WHEN as_of_date < test_cutoff THEN 'validation' ELSE 'test' END AS part FROM pairs, cutoffs""",
)
_STOP = "CASE WHEN isNonStop THEN 'True' ELSE 'False' END"
ORACLE |= {
    "asof_anchors": _sql(
        """SELECT route, startingAirport, destinationAirport, flightDate, isNonStop, searchDate AS as_of_date,
days_before_departure AS as_of_days, best_fare AS current_fare, totalTravelDistance FROM anchors""",
        "anchors",
    ),
    "remaining_pairs": _sql("SELECT * FROM pairs", "pairs"),
    "strided_pairs": _sql("SELECT * EXCLUDE (route, as_of_date) FROM strided", "strided"),
    "pair_features": _sql(
        f"""SELECT p.* EXCLUDE (startingAirport, destinationAirport, isNonStop), isNonStop AS is_nonstop,
route AS route_cat, round(ln(greatest(current_fare, 1e0)), 6) AS log_current_fare,
departure_day_of_week IN (0, 6) AS departure_is_weekend, near_holiday
FROM pairs p JOIN (SELECT flightDate, {_NEAR.format('flightDate')} AS near_holiday FROM flight_days)
USING (flightDate)""",
        "pairs",
        "holidays",
    ),
    "chrono_split": _sql(
        """SELECT part, count(*) AS pairs, min(as_of_date) AS first_date, max(as_of_date) AS last_date
FROM parts GROUP BY part""",
        "parts",
    ),
    "search_date_slices": _sql(
        """SELECT part, route, flightDate, isNonStop, days_before_departure, best_fare FROM (
SELECT daily.*, CASE WHEN searchDate >= test_cutoff THEN 'test' WHEN searchDate >= train_cutoff THEN 'validation' END
AS part FROM daily, cutoffs) WHERE part IS NOT NULL""",
        "cutoffs",
    ),
    "pair_sample": _sql(
        f"""SELECT route, flightDate, isNonStop, as_of_days, days_before_departure, future_fare FROM pairs
ORDER BY md5(concat_ws('|', route, strftime(flightDate, '%Y-%m-%d'), {_STOP}, CAST(as_of_days AS VARCHAR),
CAST(days_before_departure AS VARCHAR), '42')), route, flightDate, isNonStop, as_of_days, days_before_departure
LIMIT {PAIR_SAMPLE}""",
        "pairs",
    ),
    "train_val_union": _sql(
        """SELECT part, route, count(*) AS pairs, round(sum(future_fare), 6) AS future_fare FROM parts
WHERE part <> 'test' GROUP BY ALL""",
        "parts",
    ),
}


def _long_curves(source: str) -> str:
    return f"""
SELECT route, flightDate, isNonStop FROM {source} WHERE isNonStop IS NOT NULL
GROUP BY route, flightDate, isNonStop HAVING count(*) >= 8"""


def _curve_sample(source: str, size: int, seed: int) -> str:
    return f"""
SELECT * FROM ({_long_curves(source)})
ORDER BY md5(concat_ws('|', route, strftime(flightDate, '%Y-%m-%d'), {_STOP}, '{seed}')), route, flightDate,
  isNonStop LIMIT {size}"""


_fragment("sampled", "daily", sql=_curve_sample("daily", CURVE_SAMPLE, 0))
ORACLE["curve_sample"] = _sql(
    """SELECT route, flightDate, isNonStop, days_before_departure, best_fare
FROM daily SEMI JOIN sampled USING (route, flightDate, isNonStop)""",
    "sampled",
)

# --- decisions --------------------------------------------------------------------------------------------

_fragment(
    "market_dates",
    "market",
    sql="""
SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n
FROM (SELECT DISTINCT searchDate AS d FROM market)""",
)
_fragment(
    "measured",
    "market",
    sql="""
SELECT *, count(*) OVER curve AS points, min(days_before_departure) OVER curve AS last_day,
  median(best_fare) OVER (curve ORDER BY days_before_departure DESC ROWS UNBOUNDED PRECEDING) AS seen_median
FROM market WINDOW curve AS (PARTITION BY route, flightDate, isNonStop)""",
)
_fragment(
    "nearest",
    "measured",
    sql="""
SELECT DISTINCT route, flightDate, isNonStop, days_before_departure FROM (
  SELECT route, flightDate, isNonStop, days_before_departure
  FROM measured, (SELECT unnest([21, 14, 7]) AS target) WHERE points >= 3
  QUALIFY row_number() OVER (PARTITION BY route, flightDate, isNonStop, target
    ORDER BY abs(days_before_departure - target), days_before_departure DESC) = 1)""",
)
_PREDICTED = "least(3e0, greatest(0.3e0, 0.8e0 + 0.02e0 * abs({day} - 10)))"


def _wait_rule(threshold: str) -> str:
    return f"(predicted_savings >= {threshold} AND predicted_purchase_days < as_of_days)"


def _period(prefix: str, start: float, end: float) -> None:
    """Bounds, candidates and simulated decisions of a period."""
    _fragment(
        f"{prefix}_bounds",
        "market_dates",
        sql=f"""
SELECT max(d) FILTER (WHERE i = least(n - 1, floor(n * {start}e0))) AS period_start,
  max(d) FILTER (WHERE i = floor(n * {end}e0)) AS period_end FROM market_dates""",
    )
    _fragment(
        f"{prefix}_candidates",
        "nearest",
        f"{prefix}_bounds",
        sql=f"""
SELECT concat_ws('|', route, strftime(flightDate, '%Y-%m-%d'), {_STOP}, CAST(days_before_departure AS VARCHAR))
    AS decision_id,
  route, flightDate, searchDate AS search_date, isNonStop, days_before_departure AS as_of_days,
  best_fare AS current_fare, seen_median AS trailing_median_fare
FROM measured JOIN nearest USING (route, flightDate, isNonStop, days_before_departure), {prefix}_bounds
WHERE searchDate >= period_start AND (period_end IS NULL OR searchDate < period_end)
  AND days_before_departure > last_day""",
    )
    _fragment(
        f"{prefix}_rows",
        f"{prefix}_candidates",
        sql=f"""
SELECT c.*, m.days_before_departure AS day, m.best_fare,
  {_PREDICTED.format(day='m.days_before_departure')} / greatest({_PREDICTED.format(day='c.as_of_days')}, 1e-9)
    * c.current_fare AS predicted_fare
FROM {prefix}_candidates c JOIN market m ON c.route = m.route AND c.flightDate = m.flightDate
  AND c.isNonStop = m.isNonStop AND m.days_before_departure <= c.as_of_days""",
    )
    _fragment(
        f"{prefix}_best",
        f"{prefix}_rows",
        sql=f"""
SELECT decision_id, day AS predicted_purchase_days, predicted_fare, best_fare AS wait_paid_fare
FROM {prefix}_rows QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY predicted_fare, day DESC) = 1""",
    )
    _fragment(
        f"{prefix}_facts",
        f"{prefix}_best",
        sql=f"""
SELECT c.*, predicted_purchase_days, c.current_fare - predicted_fare AS predicted_savings, wait_paid_fare,
  c.current_fare - last_fare AS always_wait_savings, c.current_fare - lowest AS oracle_savings
FROM {prefix}_candidates c JOIN {prefix}_best USING (decision_id)
JOIN (SELECT decision_id, min(best_fare) AS lowest, arg_min(best_fare, day) AS last_fare
      FROM {prefix}_rows GROUP BY decision_id) USING (decision_id)""",
    )
    wait = _wait_rule("8")
    coin = (
        "CAST(CAST(('0x' || substr(sha256(decision_id), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551615e0"
    )
    _fragment(
        f"{prefix}_decisions",
        f"{prefix}_facts",
        sql=f"""
SELECT *, CASE WHEN {wait} THEN 'WAIT' ELSE 'BUY' END AS model_action,
  CASE WHEN {wait} THEN wait_paid_fare ELSE current_fare END AS model_paid_fare,
  current_fare - CASE WHEN {wait} THEN wait_paid_fare ELSE current_fare END AS model_savings,
  CASE WHEN oracle_savings >= 8 THEN 'WAIT' ELSE 'BUY' END AS actual_best_action,
  'BUY' AS always_buy_action, 0e0 AS always_buy_savings, 'WAIT' AS always_wait_action,
  CASE WHEN current_fare > trailing_median_fare THEN 'WAIT' ELSE 'BUY' END AS heuristic_action,
  CASE WHEN current_fare > trailing_median_fare THEN always_wait_savings ELSE 0e0 END AS heuristic_savings,
  {coin} AS coin,
  CASE WHEN {coin} < 0.5e0 THEN 'WAIT' ELSE 'BUY' END AS random_action,
  CASE WHEN {coin} < 0.5e0 THEN always_wait_savings ELSE 0e0 END AS random_savings
FROM {prefix}_facts""",
    )


_period("val", 0.70, 0.85)
_period("test", 0.85, 1.0)


def _slice(name: str, prefix: str) -> str:
    return f"""SELECT '{name}' AS period, route, flightDate, isNonStop, searchDate, days_before_departure, best_fare
FROM market, {prefix}_bounds WHERE searchDate >= period_start AND (period_end IS NULL OR searchDate < period_end)"""


def _matched(source: str) -> str:
    rate = f"(SELECT avg(CASE WHEN model_action = 'WAIT' THEN 1e0 ELSE 0e0 END) FROM {source})"
    return f"""
SELECT * REPLACE (CASE WHEN coin < {rate} THEN 'WAIT' ELSE 'BUY' END AS random_action,
  CASE WHEN coin < {rate} THEN always_wait_savings ELSE 0e0 END AS random_savings) FROM {source}"""


_FACTS = (
    "decision_id, route, flightDate AS flight_date, search_date, isNonStop AS is_nonstop, as_of_days, "
    "current_fare, trailing_median_fare"
)
ORACLE |= {
    "period_slice": _sql(
        f"{_slice('validation', 'val')} UNION ALL {_slice('test', 'test')}", "val_bounds", "test_bounds"
    ),
    "decision_candidates": _sql("SELECT * FROM val_candidates", "val_candidates"),
    "trailing_median": _sql(
        """SELECT route, flightDate, isNonStop, days_before_departure AS as_of_days, median(best_fare) OVER (
PARTITION BY route, flightDate, isNonStop ORDER BY days_before_departure DESC ROWS UNBOUNDED PRECEDING)
AS trailing_median_fare FROM known""",
        "known",
    ),
    "stable_uniform_draws": """SELECT o_orderkey, round(CAST(CAST(('0x' || substr(sha256(concat_ws('|',
CAST(o_orderkey AS VARCHAR), o_orderpriority)), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551615e0, 9) AS draw
FROM orders""",
    "simulate_decisions": _sql(
        f"""SELECT {_FACTS}, predicted_purchase_days, round(predicted_savings, 6) AS predicted_savings,
wait_paid_fare, model_action, model_paid_fare, model_savings FROM test_decisions""",
        "test_decisions",
    ),
    "baseline_policies": _sql(
        """SELECT decision_id, always_buy_action, always_buy_savings, always_wait_action, always_wait_savings,
heuristic_action, heuristic_savings, random_action, random_savings, oracle_savings, actual_best_action
FROM test_decisions""",
        "test_decisions",
    ),
    "matched_random": _sql(
        f"SELECT decision_id, model_action, random_action, random_savings FROM ({_matched('test_decisions')})",
        "test_decisions",
    ),
    "decision_accuracy": _sql(
        """SELECT count(*) AS decisions, round(avg(CASE WHEN model_action = actual_best_action THEN 1e0 ELSE 0e0 END), 6)
AS decision_accuracy FROM test_decisions""",
        "test_decisions",
    ),
}

# --- policies --------------------------------------------------------------------------------------------------

_POLICIES = {
    "model": ("model_savings", "model_action"),
    "always_buy": ("always_buy_savings", "always_buy_action"),
    "always_wait": ("always_wait_savings", "always_wait_action"),
    "trailing_median_heuristic": ("heuristic_savings", "heuristic_action"),
    "random": ("random_savings", "random_action"),
    "oracle_reference": ("oracle_savings", "actual_best_action"),
}


def _long(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS policy, decision_id, {s} AS savings, {a} AS action FROM {source}"
        for name, (s, a) in _POLICIES.items()
    )


def _share(condition: str) -> str:
    return f"round(avg(CASE WHEN {condition} THEN 1e0 ELSE 0e0 END), 6)"


_FIGURES = f"""count(*) AS observations, {_share("action = 'WAIT'")} AS wait_rate,
  round(avg(savings), 6) AS mean_savings, round(median(savings), 6) AS median_savings,
  {_share('savings > 0')} AS win_rate, {_share('savings = 0')} AS tie_rate, {_share('savings < 0')} AS loss_rate,
  round(coalesce(avg(savings) FILTER (WHERE savings < 0), 0e0), 6) AS mean_loss_when_wrong,
  round(quantile_cont(savings, 0.05), 6) AS savings_p05"""

_fragment("test_long", "test_decisions", sql=_long("test_decisions"))
_fragment(
    "search",
    "val_facts",
    sql=f"""
SELECT threshold, avg(savings) AS mean_savings, avg(waited) AS wait_rate, quantile_cont(savings, 0.05) AS savings_p05
FROM (SELECT threshold, CASE WHEN {_wait_rule('threshold')} THEN 1e0 ELSE 0e0 END AS waited,
  CASE WHEN {_wait_rule('threshold')} THEN current_fare - wait_paid_fare ELSE 0e0 END AS savings
  FROM val_facts, (SELECT CAST(unnest([{', '.join(f'{t:g}' for t in C.THRESHOLDS)}]) AS DOUBLE) AS threshold))
GROUP BY threshold""",
)
_fragment(
    "selected",
    "search",
    sql="""
SELECT threshold FROM search WHERE wait_rate >= 0.05e0 OR (SELECT max(wait_rate) FROM search) < 0.05e0
ORDER BY mean_savings DESC, savings_p05 DESC, threshold LIMIT 1""",
)


def _bootstrap(long: str, samples: int) -> str:
    """Interval per policy; ``long`` has one row per decision and policy."""
    bounds = ", ".join(f"{b!r}" for b in POISSON_BOUNDS)
    return f"""
SELECT policy, round(quantile_cont(mean, 0.025), 6) AS mean_savings_ci95_low,
  round(quantile_cont(mean, 0.975), 6) AS mean_savings_ci95_high FROM (
  SELECT policy, resample, sum(savings * weight) / sum(weight) AS mean FROM (
    SELECT policy, resample, savings, len(list_filter([{bounds}], lambda b: b <=
      CAST(('0x' || substr(md5('42|' || (resample // 4) || '|' || decision_id), 1 + 8 * (resample % 4), 8)) AS BIGINT)
      / 4294967296e0)) AS weight
    FROM {long}, (SELECT unnest(range(0, {samples})) AS resample))
  GROUP BY policy, resample HAVING sum(weight) > 0) GROUP BY policy"""


_rule = _wait_rule("(SELECT threshold FROM selected)")
_fragment(
    "thresholded",
    "test_decisions",
    "selected",
    sql=f"""
SELECT * REPLACE (CASE WHEN {_rule} THEN 'WAIT' ELSE 'BUY' END AS model_action,
  CASE WHEN {_rule} THEN wait_paid_fare ELSE current_fare END AS model_paid_fare,
  current_fare - CASE WHEN {_rule} THEN wait_paid_fare ELSE current_fare END AS model_savings)
FROM test_decisions""",
)
_fragment("held_out", "thresholded", sql=_matched("thresholded"))
_fragment("held_out_long", "held_out", sql=_long("held_out"))
ORACLE |= {
    "threshold_search": _sql(
        """SELECT threshold, round(mean_savings, 6) AS mean_savings, round(wait_rate, 6) AS wait_rate,
round(savings_p05, 6) AS savings_p05, threshold = (SELECT threshold FROM selected) AS selected FROM search""",
        "selected",
    ),
    "policy_summary": _sql(f"SELECT policy, {_FIGURES} FROM test_long GROUP BY policy", "test_long"),
    "bootstrap_ci": _sql(_bootstrap("test_long", C.BOOTSTRAP_SAMPLES), "test_long"),
    "full_backtest": _sql(
        f"""SELECT *, (SELECT threshold FROM selected) AS threshold,
(SELECT {_share('model_action = actual_best_action')} FROM held_out) AS decision_accuracy,
(SELECT count(*) FROM held_out) AS booking_decisions
FROM (SELECT policy, {_FIGURES} FROM held_out_long GROUP BY policy)
JOIN ({_bootstrap('held_out_long', C.BOOTSTRAP_SAMPLES)}) USING (policy)""",
        "held_out_long",
    ),
}

# --- curve metrics ------------------------------------------------------------------------------------------------


def _scoring(prefix: str, source: str, *needs: str) -> None:
    """Scored rows and metrics of every curve of ``source``."""
    _fragment(
        f"{prefix}_scored",
        *needs,
        sql=f"""
WITH a AS (SELECT route, flightDate, isNonStop, days_before_departure AS as_of_days, best_fare AS current_fare
    FROM {source} WHERE isNonStop IS NOT NULL QUALIFY row_number() OVER (PARTITION BY route, flightDate, isNonStop
      ORDER BY abs(days_before_departure - 21), days_before_departure) = 1)
SELECT a.*, s.days_before_departure AS day, s.best_fare AS actual,
  CASE WHEN s.days_before_departure = as_of_days THEN current_fare
    ELSE {_PREDICTED.format(day='s.days_before_departure')} * current_fare END AS predicted
FROM a JOIN {source} s ON a.route = s.route AND a.flightDate = s.flightDate AND a.isNonStop = s.isNonStop
WHERE as_of_days >= 5 AND s.days_before_departure <= as_of_days""",
    )
    _fragment(
        f"{prefix}_ranked",
        f"{prefix}_scored",
        sql=f"""
SELECT *, rank() OVER (c ORDER BY actual) + (count(*) OVER (c, actual) - 1) / 2e0 AS actual_rank,
  rank() OVER (c ORDER BY predicted) + (count(*) OVER (c, predicted) - 1) / 2e0 AS predicted_rank
FROM {prefix}_scored""".replace("(c ORDER", "(PARTITION BY route, flightDate, isNonStop ORDER").replace(
            "(c, ", "(PARTITION BY route, flightDate, isNonStop, "
        ),
    )
    today = "max({0}) FILTER (WHERE day = as_of_days) - min({0}) >= 8"
    _fragment(
        f"{prefix}_metrics",
        f"{prefix}_ranked",
        sql=f"""
SELECT route, flightDate, isNonStop,
  ({today.format('actual')}) = ({today.format('predicted')}) AS agrees,
  CAST(abs(arg_min(day, (actual, -day)) - arg_min(day, (predicted, -day))) AS INTEGER) AS day_error,
  CASE WHEN count(*) >= 3 AND stddev_pop(actual) >= 1e-6 AND stddev_pop(predicted) >= 1e-6
    THEN corr(actual_rank, predicted_rank) END AS spearman,
  avg((actual - predicted) * (actual - predicted)) AS mse
FROM {prefix}_ranked GROUP BY ALL""",
    )


_scoring("all", "known", "known")
_fragment("long_curves", "daily", sql=_long_curves("daily"))
_fragment(
    "sampled_rows",
    "long_curves",
    sql="SELECT * FROM daily SEMI JOIN long_curves USING (route, flightDate, isNonStop)",
)
_scoring("some", "sampled_rows", "sampled_rows")
_fragment("late_days", "cutoffs", sql="SELECT daily.* FROM daily, cutoffs WHERE searchDate >= test_cutoff")
_fragment("late_sample", "late_days", sql=_long_curves("late_days"))
_fragment(
    "late_rows",
    "late_sample",
    sql="SELECT * FROM late_days SEMI JOIN late_sample USING (route, flightDate, isNonStop)",
)
_scoring("late", "late_rows", "late_rows")
_fragment(
    "errors",
    "parts",
    sql=f"""
SELECT avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, count(*) AS pairs FROM (
  SELECT future_fare - CASE WHEN days_before_departure = as_of_days THEN current_fare
    ELSE {_PREDICTED.format(day='days_before_departure')} * current_fare END AS e FROM parts WHERE part = 'test')""",
)
def _comparison(predicted: str) -> str:
    return f"""WITH t AS (SELECT startingAirport, destinationAirport, count(*) AS n FROM daily GROUP BY ALL
  ORDER BY n DESC, startingAirport, destinationAirport LIMIT 4),
b AS (SELECT startingAirport, destinationAirport, flightDate FROM daily SEMI JOIN t
  USING (startingAirport, destinationAirport) GROUP BY startingAirport, destinationAirport, flightDate
  QUALIFY row_number() OVER (
    PARTITION BY startingAirport, destinationAirport ORDER BY count(*) DESC, flightDate) = 1),
c AS (SELECT collapsed.*, first_value(days_before_departure) OVER w AS as_of_days,
    first_value(best_fare) OVER w AS current_fare
  FROM collapsed SEMI JOIN b USING (startingAirport, destinationAirport, flightDate)
  WINDOW w AS (PARTITION BY startingAirport, destinationAirport, flightDate ORDER BY days_before_departure DESC))
SELECT startingAirport || '-' || destinationAirport AS route, flightDate, as_of_days, days_before_departure,
  best_fare AS actual, round({predicted}, 6) AS predicted FROM c"""


_CURVE = "route, flightDate, isNonStop"
_TIMING = """round(coalesce(avg(CASE WHEN agrees THEN 1e0 ELSE 0e0 END), 0e0), 6) AS {0}buy_wait{1},
  round(coalesce(median(day_error), 99e0), 6) AS {0}median_best_day_err{2},
  round(coalesce(median(spearman), 0e0), 6) AS {0}median_{3}spearman,
  round(coalesce(sqrt(avg(mse)), 999e0), 6) AS {0}{4}rmse"""
ORACLE |= {
    "cheapest_day_error": _sql(f"SELECT {_CURVE}, day_error FROM all_metrics", "all_metrics"),
    "buy_wait_agreement": _sql(f"SELECT {_CURVE}, agrees FROM all_metrics", "all_metrics"),
    "curve_spearman": _sql(
        f"SELECT {_CURVE}, round(spearman, 6) AS spearman FROM all_metrics", "all_metrics"
    ),
    "timing_score": _sql(
        f"SELECT {_TIMING.format('', '', '', '', 'remain_')}, count(*) AS n FROM some_metrics", "some_metrics"
    ),
    "pair_errors": _sql("SELECT round(mae, 6) AS mae, round(rmse, 6) AS rmse, pairs FROM errors", "errors"),
    "evaluation_record": _sql(
        f"""SELECT 'dip' AS selected_configuration,
(SELECT count(*) FROM parts WHERE part = 'train') AS train_rows,
(SELECT count(*) FROM parts WHERE part = 'validation') AS validation_rows,
(SELECT count(*) FROM parts WHERE part = 'test') AS test_rows,
(SELECT train_cutoff FROM cutoffs) AS train_cutoff, (SELECT test_cutoff FROM cutoffs) AS test_cutoff,
{_TIMING.format('test_', '_agreement', 'or', 'curve_', 'remaining_curve_')},
(SELECT round(mae, 6) FROM errors) AS test_pair_mae_dollars,
(SELECT round(rmse, 6) FROM errors) AS test_pair_rmse_dollars FROM late_metrics""",
        "late_metrics",
        "errors",
    ),
    "predicted_vs_actual": _sql(
        _comparison(
            f"""CASE WHEN days_before_departure = as_of_days THEN current_fare ELSE {_PREDICTED.format(day='days_before_departure')} * current_fare END"""
        ),
        "collapsed",
    ),
    "predicted_dollars_vs_actual": _sql(_comparison("120e0 + 2.5e0 * abs(days_before_departure - 10)"), "collapsed"),
}

# --- requests -----------------------------------------------------------------------------------------------------------

_fragment(
    "requests",
    sql=f"""
SELECT o_orderkey AS request_id,
  CASE o_custkey % 5 WHEN 0 THEN 'ATL' WHEN 1 THEN 'BOS' WHEN 2 THEN 'LAX' WHEN 3 THEN 'ORD'
    ELSE CASE WHEN o_custkey % 10 = 9 THEN 'DEN' ELSE 'XYZ' END END AS origin,
  CASE o_orderkey % 4 WHEN 0 THEN 'ATL' WHEN 1 THEN 'BOS' WHEN 2 THEN 'LAX' ELSE 'ORD' END AS destination,
  DATE '2022-06-01' AS today, DATE '2022-05-29' + CAST(o_orderkey % 70 AS INTEGER) AS flight_date,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(100 + o_custkey % 200 AS DOUBLE) END AS current_price,
  CASE o_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'nonstop' ELSE 'connecting' END AS stops,
  CAST(o_orderkey // {PAGE_BLOCK} AS BIGINT) AS block
FROM orders""",
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_fragment(
    "checked",
    "requests",
    sql=f"""
SELECT *, CASE WHEN message IS NULL THEN 'ok' WHEN days_left > 60 AND message LIKE 'Flight is %' THEN 'too_far'
  ELSE 'error' END AS status FROM (
  SELECT *, CAST(flight_date - today AS INTEGER) AS days_left, CASE
    WHEN origin = destination THEN {_text(C.MSG_SAME_AIRPORT)}
    WHEN origin = 'XYZ' THEN {_text(C.MSG_UNSUPPORTED)}
    WHEN flight_date <= today THEN {_text(C.MSG_NOT_FUTURE)}
    WHEN flight_date - today > 60 THEN printf({_text(C.MSG_TOO_FAR)}, CAST(flight_date - today AS VARCHAR))
  END AS message FROM requests)""",
)
_fragment("usable", "checked", sql="SELECT * FROM checked WHERE status = 'ok'")
_fragment(
    "lookups",
    "daily",
    sql="""
SELECT route, median(totalTravelDistance) AS route_distance, median(best_fare) AS route_median_fare
FROM daily GROUP BY route""",
)
_fragment(
    "overall",
    "daily",
    sql="SELECT median(best_fare) AS fare, median(totalTravelDistance) AS distance FROM daily",
)
ORACLE |= {
    "request_validation": _sql(
        "SELECT request_id, origin, destination, stops, days_left, status, message FROM checked", "checked"
    ),
    "request_fields": _sql(
        f"""WITH f AS (SELECT request_id, request_id AS o,
  CASE WHEN o % 17 = 0 AND o % 13 <> 0 THEN 'AT' ELSE origin END AS origin, destination,
  CASE WHEN o % 11 IN (0, 1) THEN NULL ELSE flight_date END AS flight_date,
  CASE o % 8 WHEN 3 THEN 0e0 WHEN 4 THEN -5e0 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL
    ELSE CAST(100 + o % 200 AS DOUBLE) END AS current_price,
  CASE o % 9 WHEN 0 THEN 'all' WHEN 1 THEN 'nonstop' WHEN 2 THEN 'connecting' WHEN 3 THEN 'connecting'
    WHEN 4 THEN 'all' WHEN 5 THEN 'all' WHEN 6 THEN 'nonstop' WHEN 7 THEN NULL ELSE 'connecting' END AS stops
  FROM requests)
SELECT * EXCLUDE (o), CASE WHEN stops IS NULL THEN {_text(C.MSG_STOPS)}
  WHEN o % 8 = 2 THEN {_text(C.MSG_PRICE_TYPE)} WHEN current_price <= 0 THEN {_text(C.MSG_PRICE_SIGN)}
  WHEN origin = 'AT' THEN {_text(C.MSG_CODE_LENGTH)} WHEN origin = destination THEN {_text(C.MSG_SAME_AIRPORT)}
  WHEN origin = 'XYZ' THEN {_text(C.MSG_UNSUPPORTED)} WHEN flight_date IS NULL THEN {_text(C.MSG_DATE)} END AS problem
FROM f""",
        "requests",
    ),
}

# --- published fares -----------------------------------------------------------------------------------------------------

_fragment(
    "listed",
    "keyed",
    sql=f"""
SELECT {AIRPORT.format('oi')} AS origin, {AIRPORT.format('di')} AS destination, block,
  CAST(floor(l_extendedprice / 400) AS DOUBLE) + 20 + CASE WHEN l_linenumber = 2 THEN 0.5e0 ELSE 0e0 END AS price,
  DATE '2022-05-29' + CAST(l_orderkey % 70 AS INTEGER) AS deal_date,
  CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_linenumber % 3 AS INTEGER) END AS stops, l_returnflag AS carrier,
  row_number() OVER (PARTITION BY oi, di, block
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place
FROM keyed""",
)
_fragment(
    "deals",
    "listed",
    sql="""
SELECT origin, destination, block, CAST(nth - 1 AS INTEGER) AS pos, CAST(price AS DOUBLE) AS price,
  CAST(deal_date AS VARCHAR) AS deal_date, stops, carrier
FROM (SELECT *, row_number() OVER (PARTITION BY origin, destination, block ORDER BY place) AS nth
  FROM listed WHERE price BETWEEN 35 AND 1500 AND block % 10 <> 9)""",
)
_fragment(
    "headlines",
    "listed",
    sql="""
SELECT origin, destination, block, CASE WHEN block % 10 <> 9 AND block % 4 <> 3
  AND min(price) + 40 BETWEEN 35 AND 1500 THEN CAST(min(price) + 40 AS DOUBLE) END AS headline
FROM listed GROUP BY origin, destination, block""",
)
_fragment(
    "matched",
    "checked",
    "deals",
    sql="""
SELECT request_id, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'nearby' WHEN 2 THEN 'route_lowest' END AS match,
  price, deal_date, deal_stops, carrier FROM (
  SELECT r.request_id, d.price, d.deal_date, d.stops AS deal_stops, d.carrier,
    abs(date_diff('day', r.flight_date, CAST(d.deal_date AS DATE))) AS gap,
    CASE WHEN gap = 0 THEN 0 WHEN gap <= 10 THEN 1 ELSE 2 END AS tier, d.pos,
    CASE WHEN r.stops = 'all' THEN true WHEN r.stops = 'nonstop' THEN coalesce(d.stops = 0, false)
      ELSE coalesce(d.stops <> 0, false) END AS fits,
    bool_or(fits) OVER (PARTITION BY r.request_id) AS some_fit
  FROM checked r LEFT JOIN deals d USING (origin, destination, block) WHERE r.status <> 'error')
WHERE fits OR NOT some_fit OR price IS NULL
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY
  CASE WHEN price IS NULL THEN 3 ELSE tier END, CASE WHEN tier = 1 THEN gap ELSE 0 END, price, pos) = 1""",
)
# a request without any deal keeps no match
_fragment(
    "deal_hits",
    "matched",
    sql="SELECT * REPLACE (CASE WHEN price IS NOT NULL THEN match END AS match) FROM matched",
)
_fragment(
    "web",
    "deal_hits",
    "headlines",
    sql="""
SELECT request_id, coalesce(page, city) AS published_price,
  CASE WHEN page IS NOT NULL THEN coalesce(m, 'route_lowest') WHEN city IS NOT NULL THEN 'route_lowest' END AS match,
  CASE WHEN page IS NOT NULL THEN deal_date END AS live_matched_date,
  CASE WHEN page IS NOT NULL THEN deal_stops END AS published_stops,
  CASE WHEN page IS NOT NULL THEN carrier END AS published_carrier,
  CASE WHEN page IS NOT NULL THEN 'route page' WHEN city IS NOT NULL THEN 'city page' END AS source FROM (
  SELECT r.request_id, h.match AS m, deal_date, deal_stops, carrier,
    CASE WHEN price IS NULL THEN headline WHEN h.match = 'route_lowest' THEN least(price, headline) ELSE price END AS page,
    CASE WHEN l.block IS NOT NULL AND r.block % 20 <> 19 THEN CAST(90 + r.block % 7 AS DOUBLE) END AS city
  FROM checked r LEFT JOIN deal_hits h USING (request_id)
  LEFT JOIN headlines l ON l.origin = r.origin AND l.destination = r.destination AND l.block = r.block
  WHERE r.status <> 'error')""",
)
_fragment(
    "pinned_web",
    "web",
    "lookups",
    "overall",
    sql="""
SELECT u.*, u.origin || '-' || u.destination AS route,
  coalesce(current_price, published_price, route_median_fare, fare, 150e0) AS pin_price,
  CASE WHEN current_price IS NOT NULL THEN 'user' WHEN published_price IS NOT NULL THEN 'web' ELSE 'model' END
    AS price_source, coalesce(route_distance, distance) AS totalTravelDistance,
  CASE WHEN current_price IS NULL THEN live_matched_date END AS live_matched_date,
  CASE WHEN current_price IS NULL THEN published_stops END AS published_stops,
  CASE WHEN current_price IS NULL THEN published_carrier END AS published_carrier
FROM checked u JOIN web USING (request_id)
LEFT JOIN lookups l ON l.route = u.origin || '-' || u.destination, overall WHERE u.status = 'ok'""",
)
_fragment(
    "pinned",
    "usable",
    "lookups",
    "overall",
    sql="""
SELECT u.*, coalesce(current_price, route_median_fare, fare, 150e0) AS pin_price
FROM usable u LEFT JOIN lookups l ON l.route = u.origin || '-' || u.destination, overall""",
)

_FALLING = "0.7e0 + 0.3e0 * {day} / greatest(days_left, 1)"
_DIP = "0.8e0 + 0.02e0 * abs({day} - 10)"


def _clip(formula: str, day: str) -> str:
    return f"least(3e0, greatest(0.3e0, {formula.format(day=day)}))"


def _curves(source: str, connecting: str, nonstop: str) -> str:
    """Pinned fares of 60 lead days per request."""

    def pool(formula: str) -> str:
        return f"{_clip(formula, 'day')} / {_clip(formula, 'days_left')} * pin_price"

    return f"""
SELECT * EXCLUDE (fare), fare * CASE WHEN stops = 'all' THEN pin_price / max(CASE WHEN day = days_left THEN fare END)
    OVER (PARTITION BY request_id) ELSE 1e0 END AS fare FROM (
  SELECT *, CASE stops WHEN 'nonstop' THEN {pool(nonstop)} WHEN 'connecting' THEN {pool(connecting)}
    ELSE least({pool(nonstop)}, {pool(connecting)}) END AS fare
  FROM {source}, (SELECT unnest(range(1, 61)) AS day))"""


_fragment("stop_curves", "pinned", sql=_curves("pinned", _FALLING, "1.05e0"))
_fragment("dip_curves", "pinned", sql=_curves("pinned", _DIP, _DIP))
_fragment("web_curves", "pinned_web", sql=_curves("pinned_web", _DIP, _DIP))


def _windows(curves: str) -> str:
    return f"""
WITH best AS (SELECT request_id, day AS best_day, fare AS best_price FROM {curves} WHERE day <= days_left
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY fare, day DESC) = 1),
marked AS (SELECT c.*, best_day, best_price, fare > best_price + 8 AS dear FROM {curves} c JOIN best USING (request_id)
  WHERE day <= days_left),
islands AS (SELECT *, sum(CASE WHEN dear THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY day DESC) AS island
  FROM marked)
SELECT i.request_id, i.best_day, i.best_price, max(i.day) AS window_start_days, min(i.day) AS window_end_days
FROM islands i JOIN islands b ON i.request_id = b.request_id AND b.day = b.best_day AND i.island = b.island
WHERE NOT i.dear GROUP BY ALL"""


_fragment("dip_windows", "dip_curves", sql=_windows("dip_curves"))
_fragment("web_windows", "web_curves", sql=_windows("web_curves"))
_SHORT = "strftime({0}, '%b %-d')"
_start, _end, _best = (
    _SHORT.format("buy_window_start"),
    _SHORT.format("buy_window_end"),
    _SHORT.format("best_date"),
)
_WHEN = f"""CASE WHEN buy_window_start = buy_window_end THEN printf({_text(C.WINDOW_OF_ONE_DAY)}, {_start})
  ELSE printf({_text(C.WINDOW_OF_DAYS)}, {_start}, {_end}) END"""
_MESSAGE = f"""CASE WHEN buy THEN printf({_text(C.MSG_BUY)}, {_WHEN})
    ELSE printf({_text(C.MSG_WAIT)}, {_WHEN}, {_best}, printf('%.2f', round_even(savings * 100, 0) / 100)) END"""
_CURVE_COLUMNS = (
    "SELECT request_id, stops, CAST(day AS INTEGER) AS days_before_departure, "
    "round(fare, 6) AS predicted_fare FROM stop_curves"
)
ORACLE |= {
    "published_deals": _sql(
        """SELECT *, CAST(2 AS INTEGER) AS fetched_at FROM deals""", "deals"
    ),
    "headline_fare": _sql(
        """SELECT *, CAST(2 AS INTEGER) AS fetched_at FROM headlines
UNION ALL SELECT origin, destination, block, 1400e0 AS headline, CAST(1 AS INTEGER) AS fetched_at
FROM headlines WHERE block % 7 = 3""",
        "headlines",
    ),
    "nearest_deal": _sql("SELECT * FROM deal_hits", "deal_hits"),
    "published_fare": _sql("SELECT * FROM web", "web"),
    "price_pin": _sql(
        "SELECT request_id, route, pin_price, price_source, totalTravelDistance FROM pinned_web", "pinned_web"
    ),
    "pinned_curve": _sql(f"{_CURVE_COLUMNS} WHERE stops <> 'all'", "stop_curves"),
    "all_stops_curve": _sql(f"{_CURVE_COLUMNS} WHERE stops = 'all'", "stop_curves"),
    "buy_window": _sql(
        """SELECT request_id, CAST(best_day AS INTEGER) AS best_day, round(best_price, 6) AS best_price,
CAST(window_start_days AS INTEGER) AS window_start_days, CAST(window_end_days AS INTEGER) AS window_end_days
FROM dip_windows""",
        "dip_windows",
    ),
    "recommendations": _sql(
        f"""WITH d AS (SELECT p.*, w.* EXCLUDE (request_id), flight_date - CAST(best_day AS INTEGER) AS best_date,
  flight_date - CAST(window_start_days AS INTEGER) AS buy_window_start,
  flight_date - CAST(window_end_days AS INTEGER) AS buy_window_end,
  pin_price - best_price AS savings, best_day = days_left OR pin_price - best_price < 8 AS buy
  FROM pinned_web p JOIN web_windows w USING (request_id)),
t AS (SELECT request_id, count(*) AS curve_points, round(sum(round_even(fare * 100, 0) / 100), 2) AS curve_total
  FROM web_curves GROUP BY request_id)
SELECT request_id, origin, destination, flight_date, days_left, stops, price_source, live_matched_date,
  published_stops, published_carrier, stops = 'nonstop' AS nonstop_only,
  CASE WHEN buy THEN 'buy_now' ELSE 'wait' END AS status,
  CASE WHEN NOT buy THEN CAST(days_left - best_day AS INTEGER) END AS wait_days,
  round_even(pin_price * 100, 0) / 100 AS current_price,
  CASE WHEN NOT buy THEN round_even(best_price * 100, 0) / 100 END AS expected_best_price,
  CASE WHEN NOT buy THEN round_even(savings * 100, 0) / 100 END AS expected_savings,
  CAST(best_day AS INTEGER) AS best_day, best_date, buy_window_start, buy_window_end,
  CAST(window_start_days AS INTEGER) AS buy_window_start_days, CAST(window_end_days AS INTEGER) AS buy_window_end_days,
  {_MESSAGE} AS message,
  curve_points, curve_total
FROM d JOIN t USING (request_id)
UNION ALL BY NAME
SELECT request_id, origin, destination, flight_date, days_left, stops, NULL AS price_source,
  status, message FROM checked WHERE status <> 'ok'""",
        "web_windows",
    ),
}

# --- itineraries -------------------------------------------------------------------------------------------------------------

_fragment(
    "options",
    sql="""
SELECT l_orderkey AS payload_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
  CASE WHEN l_quantity > 3 THEN floor(l_extendedprice / 400) + 15 END AS price,
  CASE WHEN l_quantity % 2 = 0 THEN 'Delta' ELSE 'Sky' END AS airline, 'DL' AS airline_code,
  'dl ' || (l_partkey % 50) || CASE WHEN l_linenumber % 2 = 0 THEN '|AA ' || (l_suppkey % 20) ELSE '' END
    AS flight_numbers,
  '0' || l_linenumber || ':15' AS depart_time, '1' || l_linenumber || ':45' AS arrive_time,
  CAST(CASE WHEN l_tax > 0.02e0 THEN 60 + l_linenumber * 10
    WHEN l_linenumber % 2 = 0 THEN 2 * (30 + l_linenumber * 5) ELSE 30 + l_linenumber * 5 END AS INTEGER)
    AS duration_min,
  CAST(1 - l_linenumber % 2 AS INTEGER) AS stops,
  CASE WHEN l_linenumber % 2 = 0 THEN 'DFW' ELSE '' END AS stop_airports
FROM lineitem""",
)
_fragment(
    "itins",
    "options",
    sql="""
SELECT payload_id, CAST(row_number() OVER (PARTITION BY payload_id ORDER BY pos) - 1 AS INTEGER) AS id,
  airline, airline_code, flight_numbers, depart_time, arrive_time, duration_min, stops, stop_airports,
  CAST(price AS DOUBLE) AS price, CASE WHEN stops = 0 THEN 'nonstop' ELSE 'connecting' END AS curve_pool
FROM (SELECT * FROM options WHERE price BETWEEN 20 AND 5000 QUALIFY row_number() OVER (
  PARTITION BY payload_id, flight_numbers, depart_time, price ORDER BY pos) = 1)""",
)
ORACLE |= {
    "itineraries": _sql("SELECT * FROM itins", "itins"),
    "itinerary_filter": _sql("SELECT payload_id, id, stops, price FROM itins WHERE stops > 0", "itins"),
}

# --- text input and rejected payloads ----------------------------------------------------------------------------------------

_fragment(
    "offers_text",
    "offers_keyed",
    sql="""
SELECT * EXCLUDE (l_partkey) REPLACE (CASE WHEN l_partkey % 101 = 0 THEN NULL WHEN l_partkey % 103 = 0 THEN -1
  WHEN l_partkey % 7 <> 0 AND l_partkey % 11 = 0 AND seatsRemaining >= 0
    THEN CAST(round_even(seatsRemaining + 0.5e0, 0) AS INTEGER)
  WHEN l_partkey % 7 <> 0 AND l_partkey % 11 = 0 THEN CAST(round_even(seatsRemaining - 0.5e0, 0) AS INTEGER)
  ELSE seatsRemaining END AS seatsRemaining) FROM offers_keyed""",
)
_fragment("clean_text", "offers_text", sql=_clean("offers_text", "flightDate > searchDate", True))
ORACLE |= {
    "clean_from_text": _sql("SELECT * FROM clean_text", "clean_text"),
    "rejected_payloads": """SELECT payload_id, CASE payload_id % 50 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'missing'
WHEN 3 THEN 'not an object' ELSE 'unreadable' END AS reason
FROM (SELECT DISTINCT l_orderkey AS payload_id FROM lineitem) WHERE payload_id % 50 IN (1, 2, 3, 4)""",
}

# --- training ----------------------------------------------------------------------------------------------------------------

ORACLE |= {
    "train_checks": _sql(
        """SELECT count(*) FILTER (WHERE part = 'train') AS train_rows,
count(*) FILTER (WHERE part = 'validation') AS validation_rows, count(*) FILTER (WHERE part = 'test') AS test_rows,
(SELECT train_cutoff FROM cutoffs) AS train_cutoff, (SELECT test_cutoff FROM cutoffs) AS test_cutoff,
count(*) FILTER (WHERE part = 'test') AS refit_pairs, count(*) AS scored_pairs,
round(sqrt(avg(pow(future_fare - current_fare, 2)) FILTER (WHERE part = 'test')), 6) AS unchanged_rmse,
true AS selected_is_known, true AS in_range, true AS selected_beats_unchanged, true AS refit_beats_unchanged
FROM parts""",
        "parts",
        "cutoffs",
    ),
}

# --- files and stored bundles ------------------------------------------------------------------------------------------------

_CSV_FAULT = """CASE WHEN l_partkey % 61 = 0 THEN 'short' WHEN l_partkey % 59 = 0 THEN 'long'
  WHEN l_partkey % 53 = 0 THEN 'open quote' END"""
_CSV_FIELDS = [
    f"coalesce(CAST({c} AS VARCHAR), '')"
    for c in ("searchDate", "flightDate", "startingAirport", "destinationAirport", "totalFare", "isNonStop",
              "seatsRemaining", "totalTravelDistance", "isBasicEconomy")
]
_fragment("offers_csv", "offers_keyed", sql=f"SELECT *, {_CSV_FAULT} AS fault FROM offers_keyed")
_fragment("offers_fitting", "offers_csv", sql="SELECT * EXCLUDE (l_partkey, fault) FROM offers_csv WHERE fault IS NULL")
_fragment("clean_csv", "offers_fitting", sql=_clean("offers_fitting", "flightDate > searchDate", True))
_served = """SELECT p.*, w.* EXCLUDE (request_id), pin_price - best_price AS savings,
  best_day = days_left OR pin_price - best_price < 8 AS buy, flight_date - CAST(window_start_days AS INTEGER) AS buy_window_start,
  flight_date - CAST(window_end_days AS INTEGER) AS buy_window_end, flight_date - CAST(best_day AS INTEGER) AS best_date
  FROM pinned p JOIN dip_windows w USING (request_id)"""
ORACLE |= {
    "csv_clean": _sql("SELECT * FROM clean_csv", "clean_csv"),
    "csv_rejects": _sql(
        f"""SELECT fault AS reason, count(*) AS lines,
sum(len(CASE fault WHEN 'short' THEN {" || ',' || ".join(_CSV_FIELDS[:6])}
  WHEN 'long' THEN {" || ',' || ".join(_CSV_FIELDS)} || ',more' ELSE '"' || {" || ',' || ".join(_CSV_FIELDS)} END))::BIGINT
  AS characters,
(SELECT count(*) FROM offers_csv WHERE fault IS NOT NULL) AS broken_lines,
(SELECT count(*) FROM offers_fitting) AS input_rows, (SELECT count(*) FROM clean_csv) AS accepted_rows
FROM offers_csv WHERE fault IS NOT NULL GROUP BY fault""",
        "clean_csv",
    ),
    "month_refresh": _sql(
        """SELECT route, flightDate, isNonStop, days_before_departure,
best_fare + CASE WHEN month(flightDate) IN (6, 7) THEN 1 ELSE 0 END AS best_fare, offers_observed
FROM daily WHERE flightDate BETWEEN DATE '2022-05-01' AND DATE '2022-07-31'""",
        "daily",
    ),
    "bundle_answers": _sql(
        f"""WITH d AS ({_served}),
t AS (SELECT request_id, round(sum(round_even(fare * 100, 0) / 100), 2) AS curve_total FROM dip_curves GROUP BY request_id)
SELECT request_id, CASE WHEN buy THEN 'buy_now' ELSE 'wait' END AS status,
  CASE WHEN current_price IS NULL THEN 'model' ELSE 'user' END AS price_source,
  round_even(pin_price * 100, 0) / 100 AS current_price,
  CASE WHEN NOT buy THEN round_even(best_price * 100, 0) / 100 END AS expected_best_price,
  CASE WHEN NOT buy THEN round_even(savings * 100, 0) / 100 END AS expected_savings,
  CASE WHEN NOT buy THEN CAST(days_left - best_day AS INTEGER) END AS wait_days, CAST(best_day AS INTEGER) AS best_day,
  CAST(window_start_days AS INTEGER) AS buy_window_start_days, CAST(window_end_days AS INTEGER) AS buy_window_end_days,
  {_MESSAGE} AS message,
  curve_total
FROM d JOIN t USING (request_id)
UNION ALL BY NAME SELECT request_id, status, message FROM checked WHERE status <> 'ok'""",
        "dip_windows",
        "checked",
    ),
    "absolute_curve": _sql(
        """SELECT request_id, 120e0 + 2.5e0 * abs(days_left - 10) AS current_price,
CAST(day AS INTEGER) AS days_before_departure, 120e0 + 2.5e0 * abs(day - 10) AS predicted_fare
FROM usable, (SELECT unnest(range(1, 61)) AS day)""",
        "usable",
    ),
}
