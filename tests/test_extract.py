import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from leadcurve.operators import extract


def deal(carrier, price, day=None, stops=None, note=""):
    parts = [f'"providerName":"{carrier}"', f'"price":{{"price":{price},"currency":"USD"}}']
    parts += [f'"pickupDateIso":"{day}"'] if day else []
    parts += [f'"leg1Stops":{stops}'] if stops is not None else []
    return "{" + ",".join([*parts, f'"note":"{note}"']) + "}"


def route_page(*deals, headline="", decoys=()):
    return (
        f'<main>{headline}</main><script>{{"cheapestPopularOneWayFlight" : {{"deals":[{",".join(deals)}]}},'
        f'"cheapestPopularRoundTrip":{{"deals":[{",".join(decoys)}]}}}}</script>'
    )


PAGE = route_page(
    deal("Meridian", 88, "2027-02-11", 0),
    deal("Kestrel", "64.50", "2027-03-01", 1),
    deal("Kestrel", 9, "2027-02-11", 0),
    deal("Undated", 71),
    deal("Harbour", 79, "2027-02-20"),
    headline="<h2>CHEAPEST one-way</h2><p>from $ 61, or</p><b>$61.25</b>",
    decoys=[deal("Back", 40, "2027-02-11", 0)],
)
CITY = "<tr><th>Cheapest one-way flight</th><td>in spring</td><td>$1,049.00</td></tr><tr><td>$50</td></tr>"


def pages(spark, *texts):
    rows = [("DEN", "MIA", t) for t in texts]
    return spark.createDataFrame(rows, "origin string, destination string, html string")


def leg(number, leaves, lands=None, **more):
    return {"departure_airport": {"id": "DEN", "time": leaves}, "arrival_airport": {"id": "MIA", "time": lands},
            "flight_number": number, **more}


NONSTOP = {"flights": [leg("mk 17", "2027-02-11 22:40", "2027-02-12 04:05", airline="Meridian", airline_logo="m.svg",
                           duration=205)], "total_duration": 205, "price": 88}
VIA = {"flights": [leg("KS 9", "2027-02-11 06:30", "2027-02-11 09:00", airline="Kestrel", duration=95),
                   leg(" KS 12", "2027-02-11 10:10", "2027-02-11 13:55", airline="Kestrel", duration=165)],
       "layovers": [{"id": "ATL"}, {"id": ""}], "price": "64.5"}
BARE = {"flights": [leg("", "5:55")], "airline": "Harbour", "price": 5000}
PAYLOAD = {
    "best_flights": [VIA],
    "other_flights": [NONSTOP, {**VIA, "airline": "again"}, {**NONSTOP, "price": None}, {**NONSTOP, "flights": []},
                      {**NONSTOP, "price": 19.99}, BARE],
}


def test_itineraries(spark):
    df = spark.createDataFrame([(7, json.dumps(PAYLOAD)), (8, "{}"), (9, None)], "payload_id int, payload string")
    found = extract.with_curve_pool(extract.itineraries(df))
    via, nonstop, bare = sorted(found.collect(), key=lambda r: r.id)
    assert [(r.payload_id, r.id, r.price) for r in (via, nonstop, bare)] == [(7, 0, 64.5), (7, 1, 88.0), (7, 2, 5000.0)]
    assert (via.airline, via.airline_code, via.flight_numbers) == ("Kestrel", "KS", ["KS 9", "KS 12"])
    assert (via.depart_time, via.arrive_time, via.duration_min) == ("06:30", "13:55", 260)
    assert (via.stops, via.stop_airports, via.curve_pool) == (2, ["ATL"], "connecting")
    assert (nonstop.airline_code, nonstop.airline_logo, nonstop.duration_min) == ("MK", "m.svg", 205)
    assert (nonstop.stops, nonstop.stop_airports, nonstop.curve_pool) == (0, [], "nonstop")
    assert (bare.airline, bare.airline_code, bare.flight_numbers) == ("Harbour", None, [])
    assert (bare.depart_time, bare.arrive_time, bare.duration_min) == ("5:55", None, None)
    assert [extract.filter_stops(found, c).count() for c in ("nonstop", "connecting", "all")] == [2, 1, 3]


def test_a_payload_with_many_copies(spark):
    payload = {"best_flights": [VIA] + [NONSTOP] * 3000 + [VIA], "other_flights": [NONSTOP] * 3000}
    df = spark.createDataFrame([(1, json.dumps(payload))], "payload_id int, payload string")
    rows = sorted(extract.itineraries(df).collect(), key=lambda r: r.id)
    assert [(r.id, r.price) for r in rows] == [(0, 64.5), (1, 88.0)]


def test_rejected_payloads_have_a_reason(spark):
    rows = [(1, json.dumps(PAYLOAD)), (2, '{"best_flights": ['), (3, None), (4, "[1]"), (5, ""), (6, " {} ")]
    found = extract.rejected_payloads(spark.createDataFrame(rows, "payload_id int, payload string")).collect()
    assert {r.payload_id: r.reason for r in found} == {2: "unreadable", 3: "missing", 4: "not an object", 5: "unreadable"}


def test_deals_of_the_one_way_block(spark):
    deals = sorted(extract.published_deals(pages(spark, PAGE)).collect(), key=lambda r: r.pos)
    assert [(d.pos, d.price, d.deal_date, d.stops, d.carrier) for d in deals] == [
        (0, 88.0, "2027-02-11", 0, "Meridian"), (1, 64.5, "2027-03-01", 1, "Kestrel"), (2, 79.0, "2027-02-20", None, "Harbour")]


def test_every_deal_of_a_block_is_read(spark):
    listed = [deal(f"C{i}", 10 if i <= 2 else 100 + i, f"2027-01-{i % 28 + 1:02d}", note="x" * 90_000 if i == 3 else "") for i in range(1, 90)]
    rows = extract.published_deals(pages(spark, route_page(*listed))).collect()
    assert sorted(r.price for r in rows) == [float(100 + i) for i in range(3, 90)]


@pytest.mark.parametrize(
    ("html", "fare"),
    [
        (PAGE, 61.25),
        (CITY, 1049.0),
        ("Cheapest one-way" + "<br>" * 5000 + "$77", 77.0),
        ("Cheapest one-way $12,345", None),  # no part of a number is a fare
        ("Cheapest one-way $12,345 then Cheapest one-way flight $140", 140.0),
        ('Cheapest one-way <i>soon</i> {"title":"Cheapest flight" , "dataText":"$1,234"}', 1234.0),
        ('Cheapest one-way "cheapestPopularOneWayFlight":{"deals":[{"shown":"$99"}]}', None),
        ("<tr>Cheapest one-way</tr><tr>$99</tr>", None),
        ("no prices here", None),
        (None, None),
    ],
)
def test_headlines(spark, html, fare):
    assert pages(spark, html).select(extract.headline_fare(F.col("html"))).first()[0] == fare


REQUEST = "request_id int, origin string, destination string, flight_date date, stops string"


@pytest.mark.parametrize(
    ("flight", "stops", "price", "match", "matched"),
    [
        (date(2027, 2, 20), "all", 79.0, "exact", "2027-02-20"),
        (date(2027, 2, 24), "all", 79.0, "nearby", "2027-02-20"),
        (date(2027, 2, 24), "connecting", 64.5, "nearby", "2027-03-01"),
        (date(2027, 6, 1), "all", 61.25, "route_lowest", "2027-03-01"),
        (date(2027, 2, 20), "nonstop", 88.0, "nearby", "2027-02-11"),
        (None, "nonstop", 61.25, "route_lowest", "2027-02-11"),
    ],
)
def test_nearest_deal(spark, flight, stops, price, match, matched):
    parsed = extract.parse_route_pages(pages(spark, PAGE))
    request = spark.createDataFrame([(1, "DEN", "MIA", flight, stops)], REQUEST)
    fare = extract.route_page_fare(extract.nearest_deal(request, parsed, ["origin", "destination"])).first()
    assert (fare.page_price, fare.page_match, fare.page_date) == (price, match, matched)


def test_the_exact_date_is_found_behind_many_deals(spark):
    listed = [deal("Far", 200 + i, "2027-08-01") for i in range(30)] + [deal("Late", 99, "2027-02-20")]
    parsed = extract.parse_route_pages(pages(spark, route_page(*listed)))
    request = spark.createDataFrame([(1, "DEN", "MIA", date(2027, 2, 20), "all")], REQUEST)
    fare = extract.route_page_fare(extract.nearest_deal(request, parsed, ["origin", "destination"])).first()
    assert (fare.page_price, fare.page_match) == (99.0, "exact")


def test_a_page_fetched_twice_answers_once(spark):
    older = route_page(deal("Old", 300, "2027-02-20"))
    request = spark.createDataFrame([(1, "DEN", "MIA", date(2027, 2, 20), "all")], REQUEST)
    parsed = extract.parse_route_pages(pages(spark, PAGE, PAGE, older))
    assert extract.nearest_deal(request, parsed, ["origin", "destination"]).count() == 1
    timed = pages(spark, PAGE).withColumn("fetched_at", F.lit(2)).unionByName(pages(spark, older).withColumn("fetched_at", F.lit(1)))
    fare = extract.route_page_fare(extract.nearest_deal(request, extract.parse_route_pages(timed), ["origin", "destination"]))
    assert [r.page_price for r in fare.collect()] == [79.0]


def test_second_source_is_asked_only_without_a_first(spark):
    day = date(2027, 2, 14)
    requests = spark.createDataFrame(
        [(1, "DEN", "MIA", day, "all"), (2, "DEN", "SFO", day, "all"), (3, "DEN", "OAK", day, "all")], REQUEST
    ).withColumns({"a": extract.city_of(F.col("origin")), "b": extract.city_of(F.col("destination"))})
    routes = spark.createDataFrame(
        [("DEN", "MIA", PAGE), ("DEN", "SFO", "no prices here")], "origin string, destination string, html string"
    )
    cities = spark.createDataFrame(
        [("denver", "miami", CITY), ("denver", "san-francisco", CITY), ("denver", "san-francisco", CITY)],
        "a string, b string, html string",
    )
    rows = extract.published_fare(
        requests, extract.parse_route_pages(routes), extract.parse_route_pages(cities),
        ["origin", "destination"], ["a", "b"], ("routes", "cities"),
    ).collect()
    assert len(rows) == 3
    got = {r.request_id: (r.published_price, r.source, r.match, r.live_matched_date) for r in rows}
    assert got[1] == (88.0, "routes", "nearby", "2027-02-11")
    assert got[2] == (1049.0, "cities", "route_lowest", None)
    assert got[3] == (None, None, None, None)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_deal_is_matched_once_per_field(spark):
    texts = spark.createDataFrame([("ATL", "LAX", PAGE)], "origin string, destination string, html string").repartition(1)
    found = texts.select(extract.deals_array(F.col("html")).alias("deals"))
    assert plan_of(found).count("regexp_extract(") == 4
    # the dates of deals are read below the join, once per page
    requests = spark.createDataFrame([(1, "ATL", "LAX", date(2027, 2, 14), "all")], REQUEST).repartition(1)
    plan = plan_of(extract.nearest_deal(requests, extract.parse_route_pages(texts), ["origin", "destination"]))
    above, below = plan.split("Join", 1)
    assert plan.count(" as date)") == 1 and " as date)" not in above and " as date)" in below


def test_payload_texts_are_written_without_structs(spark, tmp_path):
    from leadcurve.catalog import fixtures

    schema = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, "
              "l_tax double, l_returnflag string")
    rows = [
        (1, 1, 129, 45, 9300.0, 4.0, 0.05, "A"), (1, 2, 150, None, 800.0, 5.0, 0.0, "N"), (1, 4, None, 7, None, 2.0, None, "A"),
        (2, None, 5, 6, 400.0, None, 0.08, None), (3, 3, 1, 1, -1.0, 50.0, 0.03, "R"),
    ]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = fixtures.payloads(spark, str(tmp_path))
    assert "to_json" not in found._jdf.queryExecution().optimizedPlan().toString()

    def leg(dep, arr, minutes, airline, number):
        ends = {"departure_airport": {"id": "ATL", "time": dep}, "arrival_airport": {"id": "LAX", "time": arr}}
        return {**ends, "duration": minutes, "airline": airline, "flight_number": number}

    def option(_, line, part, supplier, price, quantity, tax, flag):
        two, day = line is not None and line % 2 == 0, "2022-09-15 "
        dep, arr = (f"{day}0{line}:15", f"{day}1{line}:45") if line is not None else (None, None)
        minutes = None if line is None else 30 + 5 * line
        airline = "Delta" if quantity is not None and quantity % 2 == 0 else None
        legs = [leg(dep, day + "09:00" if two else arr, minutes, airline, part if part is None else f"dl {part % 50}")]
        legs += [leg(day + "09:40", arr, minutes, "American", supplier if supplier is None else f"AA {supplier % 20}")] if two else []
        return {
            "flights": legs, "layovers": [{"id": "DFW"}] if two else None,
            "total_duration": 10 * line + 60 if tax is not None and tax > 0.02 and line is not None else None,
            "price": int(price // 400) + 15 if quantity is not None and quantity > 3 and price is not None else None, "airline": "Sky",
        }

    def bare(value):
        if isinstance(value, dict):
            return {k: bare(v) for k, v in value.items() if v is not None}
        return [bare(v) for v in value] if isinstance(value, list) else value

    for r in found.collect():
        own = [x for x in rows if x[0] == r.payload_id]
        others = own[2:] + [x for x in own if x[-1] == "A"]
        want = {"best_flights": [bare(option(*x)) for x in own[:2]], "other_flights": [bare(option(*x)) for x in others]}
        assert r.payload == json.dumps(want, separators=(",", ":"))
