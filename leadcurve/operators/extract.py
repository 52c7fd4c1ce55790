"""Fares and itineraries out of tables of fetched pages and JSON payloads.

A page or payload is one row and is read whole; arrays inside the row hold its
deals or options, so extraction needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadcurve import constants as C
from leadcurve.functions.fares import cents
from leadcurve.functions.once import once

# --- itineraries -----------------------------------------------------------------

_END = "struct<id:string,time:string>"
_LEG = (
    f"struct<departure_airport:{_END},arrival_airport:{_END},duration:string,"
    "airline:string,airline_logo:string,flight_number:string>"
)
_OPTION = (
    f"struct<flights:array<{_LEG}>,layovers:array<struct<id:string>>,total_duration:string,"
    "price:string,airline:string,airline_logo:string>"
)
PAYLOAD_SCHEMA = f"struct<best_flights:array<{_OPTION}>,other_flights:array<{_OPTION}>>"

def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _clock(raw: Column) -> Column:
    """hh:mm of a ``date time`` text, or of a bare time."""
    bare = once(F.regexp_extract(raw, r"^\s*(?=\S*:)(?=\S{4})(\S{1,5})\S*\s*$", 1), _filled)
    return once(
        F.regexp_extract(raw, r"^\s*\S+\s+(\S{1,5})", 1), lambda second: F.when(second != "", second).otherwise(bare)
    )


def _flight_numbers(legs: Column) -> Column:
    numbers = F.transform(legs, lambda leg: _trimmed(leg["flight_number"]))
    return F.filter(numbers, lambda n: n.isNotNull() & (n != ""))


def _minutes(text: Column) -> Column:
    return F.coalesce(text.try_cast("double").cast("int"), F.lit(0))


def _usable(option: Column) -> Column:
    """An option needs a leg and an acceptable price."""
    price = option["price"].try_cast("double")
    legs = F.coalesce(F.size(option["flights"]), F.lit(0))
    return (legs > 0) & once(price, lambda p: p.between(C.ITINERARY_MIN, C.ITINERARY_MAX))


def _identity(option: Column) -> Column:
    """What makes two options the same: flight numbers, departure time, price."""
    departure = F.get(option["flights"], F.lit(0))["departure_airport"]["time"]
    return F.struct(
        _flight_numbers(option["flights"]).alias("numbers"),
        _clock(departure).alias("depart_time"),
        cents(option["price"].try_cast("double")).alias("price"),
    )


def _details(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The kept fields of ``option``, one option per row."""
    legs, layovers = F.col("option.flights"), F.col("option.layovers")
    first, last = F.get(legs, F.lit(0)), F.try_element_at(legs, F.lit(-1))
    stop_ids = F.filter(
        F.transform(F.coalesce(layovers, F.array()), lambda stop: stop["id"]),
        lambda a: a.isNotNull() & (a != ""),
    )
    summed = F.aggregate(legs, F.lit(0), lambda total, leg: total + _minutes(leg["duration"]))
    total = _minutes(F.col("option.total_duration"))
    code = F.regexp_extract(
        F.upper(F.replace(F.get("numbers", F.lit(0)), F.lit(" "), F.lit(""))), r"^[\p{L}\p{N}]{2}", 0
    )
    staged = rows.select(
        *keys,
        "id",
        "option",
        "key",
        F.col("key.numbers").alias("numbers"),
        F.when(total != 0, total).otherwise(summed).alias("minutes"),
    )
    return staged.select(
        *keys,
        "id",
        F.coalesce(_filled(first["airline"]), F.col("option.airline")).alias("airline"),
        _filled(code).alias("airline_code"),
        F.coalesce(_filled(first["airline_logo"]), F.col("option.airline_logo")).alias("airline_logo"),
        F.col("numbers").alias("flight_numbers"),
        F.col("key.depart_time").alias("depart_time"),
        _clock(last["arrival_airport"]["time"]).alias("arrive_time"),
        F.when(F.col("minutes") != 0, F.col("minutes")).alias("duration_min"),
        F.greatest(F.size(legs) - 1, F.coalesce(F.size(layovers), F.lit(0))).alias("stops"),
        stop_ids.alias("stop_airports"),
        F.col("key.price").alias("price"),
    )


def itineraries(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per distinct kept option, best options first, numbered from 0 in each payload.

    Options are equal if flight numbers, departure time and price are; the first
    one stays. Equal options are found by sorting inside the row, so that payloads
    are never shuffled.
    """
    keys = [c for c in payloads.columns if c != payload]
    parsed = payloads.select(*keys, F.from_json(payload, PAYLOAD_SCHEMA).alias("doc"))
    none = F.array().cast(f"array<{_OPTION}>")
    options = F.concat(
        F.coalesce("doc.best_flights", none), F.coalesce("doc.other_flights", none)
    )
    # sort_array compares rows as they are; array_sort would call a comparator of expressions
    tagged = parsed.select(
        *keys,
        F.sort_array(
            F.transform(
                F.filter(options, _usable),
                lambda o, i: F.struct(_identity(o).alias("key"), i.alias("place"), o.alias("option")),
            )
        ).alias("tagged"),
    )
    # sorted by key, then place: an entry equal to the one before it is a copy
    before = F.concat(F.array(F.lit(None)), F.col("tagged.key"))
    firsts = F.transform(
        F.filter(
            F.arrays_zip(F.col("tagged").alias("entry"), before.alias("before")),
            lambda z: z["entry"].isNotNull() & ~z["entry"]["key"].eqNullSafe(z["before"]),
        ),
        lambda z: F.struct(
            z["entry"]["place"].alias("place"),
            z["entry"]["key"].alias("key"),
            z["entry"]["option"].alias("option"),
        ),
    )
    kept = tagged.select(*keys, F.posexplode(F.sort_array(firsts)).alias("id", "entry"))
    return _details(kept.select(*keys, "id", "entry.key", "entry.option"), keys)


def rejected_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads that cannot give itineraries, with a ``reason``."""
    text, value = F.col(payload), F.try_parse_json(payload)
    reason = (
        F.when(text.isNull(), "missing")
        .when(value.isNull(), "unreadable")
        .when(~F.startswith(F.ltrim(text), F.lit("{")), "not an object")
    )
    return payloads.withColumn("reason", reason).filter("reason IS NOT NULL")


def filter_stops(found: DataFrame, choice: str) -> DataFrame:
    """Itineraries without a stop, with at least one, or all."""
    if choice == "nonstop":
        return found.filter(F.col("stops") == 0)
    if choice == "connecting":
        return found.filter(F.col("stops") > 0)
    return found


def with_curve_pool(found: DataFrame) -> DataFrame:
    """The stops choice whose fare curve belongs to an itinerary."""
    pool = F.when(F.col("stops") == 0, "nonstop").otherwise("connecting")
    return found.withColumn("curve_pool", pool)


# --- published fares ---------------------------------------------------------------


def _published(price: Column) -> Column:
    """The price as a number if it lies in the accepted range."""
    amount = F.regexp_replace(price, r"[,$]", "").try_cast("double")
    return once(amount, lambda a: F.when(a.between(C.PUBLISHED_MIN, C.PUBLISHED_MAX), a))


def _found(text: Column, pattern: str) -> Column:
    return once(F.regexp_extract(text, pattern, 1), _filled)


def _behind_first(parts: Column) -> Column:
    """All parts of a split text but the first."""
    return F.filter(parts, lambda part, i: i > 0)


def _after_headline(html: Column, headline: str) -> Column:
    """Price of the first headline that has one before it ends."""
    own = F.transform(
        _behind_first(F.split(html, headline)),
        lambda part: _found(F.get(F.split(part, C.HEADLINE_END, 2), F.lit(0)), C.HEADLINE_PRICE),
    )
    return F.get(F.filter(own, lambda price: price.isNotNull()), F.lit(0))


def headline_fare(html: Column) -> Column:
    """Cheapest one-way fare of a page's headline: the first form with a fare in range."""
    return F.coalesce(
        _published(_after_headline(html, C.HEADLINE)),
        _published(_found(html, C.CARD_PRICE)),
        _published(_after_headline(html, C.HEADLINE_OF_FLIGHT)),
    )


def _deals_block(html: Column) -> Column:
    """The one-way block: from behind its opening to the next block."""
    behind = F.try_element_at(F.split(html, C.DEALS_BLOCK, 2), F.lit(2))
    return F.get(F.split(behind, C.NEXT_BLOCK, 2), F.lit(0))


def deals_array(html: Column) -> Column:
    """Deals of a route page in page order: ``array<struct<pos, price, date, stops, carrier>>``."""
    # each text is matched once for each field: what is found is named first, then read
    found = F.transform(
        _behind_first(F.split(_deals_block(html), C.DEAL_START)),
        lambda part, i: F.struct(
            i.alias("pos"),
            F.regexp_extract(part, C.DEAL_PRICE, 1).try_cast("double").alias("amount"),
            F.regexp_extract(part, C.DEAL_DATE, 1).alias("date"),
            F.regexp_extract(part, C.DEAL_STOPS, 1).try_cast("int").alias("stops"),
            F.regexp_extract(part, C.DEAL_CARRIER, 1).alias("carrier"),
        ),
    )
    deals = F.transform(
        found,
        lambda d: F.struct(
            d["pos"].alias("pos"),
            F.when(d["amount"].between(C.PUBLISHED_MIN, C.PUBLISHED_MAX), d["amount"]).alias("price"),
            _filled(d["date"]).alias("date"),
            d["stops"].alias("stops"),
            _filled(d["carrier"]).alias("carrier"),
        ),
    )
    usable = F.filter(deals, lambda d: d["price"].isNotNull() & d["date"].isNotNull())
    empty = F.array().cast("array<struct<pos:int,price:double,date:string,stops:int,carrier:string>>")
    return F.coalesce(usable, empty)


def _dated(deals: Column) -> Column:
    """The deals as ``pick_deal`` reads them: with the date typed, by price and place on the page."""
    fields = lambda d: [d[c].alias(c) for c in ("price", "pos", "date", "stops", "carrier")]
    return F.sort_array(F.transform(deals, lambda d: F.struct(*fields(d), d["date"].try_cast("date").alias("day"))))


def parse_route_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace each page's text by its ``deals`` and ``headline``."""
    keys = [c for c in pages.columns if c != html]
    return pages.select(
        *keys, deals_array(F.col(html)).alias("deals"), headline_fare(F.col(html)).alias("headline")
    )


def published_deals(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per deal of each page, numbered from 0 in page order."""
    keys = [c for c in pages.columns if c != html]
    unfolded = pages.select(*keys, F.posexplode(deals_array(F.col(html))).alias("pos", "deal"))
    return unfolded.select(
        *keys, "pos", "deal.price", F.col("deal.date").alias("deal_date"), "deal.stops", "deal.carrier"
    )


def pick_deal(deals: Column, flight_date: Column, stops: Column) -> Column:
    """The deal nearest to a flight date: ``struct<tier, gap, price, pos, date, ...>``.

    ``deals`` come from ``_dated``: with a ``day`` and in the order of their price.
    Tier 0 is the exact date, 1 a date within ten days, 2 the route's lowest fare.
    Within a tier the smaller gap (tier 1), the lower price and the page order
    decide. A stop type without a deal falls back to all deals.
    """
    fitting = (
        F.when(stops == "nonstop", F.filter(deals, lambda d: d["stops"] == 0))
        .when(stops == "connecting", F.filter(deals, lambda d: d["stops"] != 0))
        .otherwise(deals)
    )

    def ranked(d: Column, tier: Column, gap: Column) -> Column:
        rest = [d[c].alias(c) for c in ("price", "pos", "date", "stops", "carrier")]
        return F.struct(tier.alias("tier"), gap.alias("gap"), *rest)

    def nearest(pool: Column) -> Column:
        gaps = F.transform(pool, lambda d: F.struct(F.abs(F.datediff(d["day"], flight_date)).alias("gap"), d.alias("deal")))
        near = F.filter(gaps, lambda g: g["gap"] <= C.NEARBY_DAYS)
        dated = F.array_min(
            F.transform(near, lambda g: ranked(g["deal"], F.when(g["gap"] == 0, 0).otherwise(1), g["gap"]))
        )
        lowest = once(F.get(pool, F.lit(0)), lambda d: F.when(d.isNotNull(), ranked(d, F.lit(2), F.lit(0))))
        return F.coalesce(dated, lowest)

    return once(once(fitting, lambda f: F.when(F.size(f) > 0, f).otherwise(deals)), nearest)


def one_page_each(pages: DataFrame, on: Sequence[str]) -> DataFrame:
    """One parsed page per key: the latest by ``fetched_at``, if the pages have it.

    Of equally late pages the greater one in (headline, deals) is taken, so that a page
    that was fetched twice answers each request once.
    """
    fetched = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(0)
    page = F.struct(fetched.alias("fetched_at"), "headline", "deals")
    return pages.groupBy(*on).agg(F.max(page).alias("page")).select(*on, "page.deals", "page.headline")


def nearest_deal(requests: DataFrame, pages: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each request's best matching deal on its route page (``deals`` from ``parse_route_pages``)."""
    # dates are read once per page, not once per request
    dated = one_page_each(pages, on).withColumn("deals", _dated(F.col("deals")))
    joined = requests.join(dated, list(on), "left")
    hit = pick_deal(F.col("deals"), F.col("flight_date"), F.col("stops"))
    return joined.withColumn("deal", hit).drop("deals")


def match_name(tier: Column) -> Column:
    return F.when(tier == 0, "exact").when(tier == 1, "nearby").when(tier == 2, "route_lowest")


def route_page_fare(matched: DataFrame) -> DataFrame:
    """Fare of the route page: the deal, lowered to the headline when no date matched.

    Takes the columns ``deal`` and ``headline`` and adds ``page_price``, ``page_match``,
    ``page_date``, ``page_stops`` and ``page_carrier``; the last three are the deal's.
    """
    deal, headline = F.col("deal"), F.col("headline")
    lowest = F.when(deal["tier"] == 2, F.least(deal["price"], headline)).otherwise(deal["price"])
    price = F.when(deal.isNull(), headline).otherwise(lowest)
    match = F.when(deal.isNull(), F.lit("route_lowest")).otherwise(match_name(deal["tier"]))
    return matched.withColumns(
        {
            "page_price": price,
            "page_match": F.when(price.isNotNull(), match),
            "page_date": deal["date"],
            "page_stops": deal["stops"],
            "page_carrier": deal["carrier"],
        }
    )


def published_fare(
    requests: DataFrame,
    route_pages: DataFrame,
    city_pages: DataFrame,
    route_on: Sequence[str],
    city_on: Sequence[str],
    sources: tuple[str, str],
) -> DataFrame:
    """Published fare per request: the route page, else the city-pair page, else none.

    Both page tables come from ``parse_route_pages``; only the headline of a
    city-pair page counts. ``sources`` names the two kinds of pages.
    """
    fares = route_page_fare(nearest_deal(requests, route_pages, route_on)).drop("deal", "headline")
    cities = one_page_each(city_pages, city_on).select(*city_on, F.col("headline").alias("city_price"))
    both = fares.join(cities, list(city_on), "left")
    paged, city = F.col("page_price").isNotNull(), F.col("city_price").isNotNull()
    first, second = sources
    return both.select(
        *requests.columns,
        F.coalesce("page_price", "city_price").alias("published_price"),
        F.when(paged, F.col("page_match")).when(city, "route_lowest").alias("match"),
        F.when(paged, F.col("page_date")).alias("live_matched_date"),
        F.when(paged, F.col("page_stops")).alias("published_stops"),
        F.when(paged, F.col("page_carrier")).alias("published_carrier"),
        F.when(paged, first).when(city, second).alias("source"),
    )


def city_of(airport: Column) -> Column:
    """City name in the address of a city-pair page; null for an airport without one."""
    slugs = F.create_map(*[F.lit(x) for pair in C.CITY_SLUGS.items() for x in pair])
    return F.try_element_at(slugs, airport)
