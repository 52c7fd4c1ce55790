"""Quotes, requests, payloads and pages derived from the driver's whole tables.

The driver's tables hold no fares; these functions shape ``lineitem`` and
``orders`` into the inputs of the operators. ``catalog.oracle`` has the same
definitions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AIRPORT = "CASE {0} WHEN 0 THEN 'ATL' WHEN 1 THEN 'BOS' WHEN 2 THEN 'LAX' ELSE 'ORD' END"
PAGE_BLOCK = 400  # order keys whose deals share a page


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "*",
        "CAST(l_suppkey % 4 AS INT) AS oi",
        "CAST((l_suppkey + 1 + l_partkey % 3) % 4 AS INT) AS di",
    )


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = _routed(spark, sf_dir).selectExpr(
        "*",
        "CAST(datediff(l_shipdate, DATE'1995-01-01') % 63 AS INT) - 1 AS lead_raw",
        "date_add(DATE'2022-05-01', CAST(5 * (l_orderkey % 30) AS INT)) AS fd",
    )
    return dated.selectExpr(
        "date_sub(fd, lead_raw) AS searchDate",
        "fd AS flightDate",
        f"{AIRPORT.format('oi')} AS startingAirport",
        f"{AIRPORT.format('di')} AS destinationAirport",
        "CASE WHEN l_quantity = 1 THEN 10.0D WHEN l_quantity = 50 THEN 6000.0D"
        " WHEN l_quantity = 49 AND l_linenumber = 3 THEN NULL"
        " ELSE floor(l_extendedprice / 400) + 80 + 2 * abs(lead_raw - 21) END AS totalFare",
        "l_linenumber % 2 = 0 AS isNonStop",
        "CAST(CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL"
        " WHEN l_linenumber = 1 AND l_tax = 0.08D THEN -1 ELSE l_quantity % 10 END AS INT) AS seatsRemaining",
        "CASE WHEN l_discount = 0 THEN NULL"
        " ELSE CAST(400 + 150 * (oi + di) + l_suppkey % 7 AS DOUBLE) END AS totalTravelDistance",
        "l_returnflag = 'R' AS isBasicEconomy",
        "l_partkey",
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir).drop("l_partkey")


def offers_mixed_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes whose origin is spelled in lower case now and then."""
    lower = F.when(F.col("l_partkey") % 11 == 0, F.lower("startingAirport")).otherwise(
        F.col("startingAirport")
    )
    return _offers(spark, sf_dir).withColumn("startingAirport", lower).drop("l_partkey")


def offers_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as a text file would hold them, with unreadable and odd values."""
    return _offers(spark, sf_dir).selectExpr(
        "CASE WHEN l_partkey % 97 = 0 THEN 'bad' ELSE CAST(searchDate AS STRING) END AS searchDate",
        "CAST(flightDate AS STRING) AS flightDate",
        "startingAirport",
        "destinationAirport",
        "CASE WHEN l_partkey % 89 = 0 THEN 'n/a' ELSE CAST(totalFare AS STRING) END AS totalFare",
        "CASE WHEN l_partkey % 83 = 0 THEN 'maybe' WHEN isNonStop THEN 'TRUE' ELSE 'False' END AS isNonStop",
        "CAST(totalTravelDistance AS STRING) AS totalTravelDistance",
    )


def offers_all_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine columns as text; seats are decimals, negative decimals or unreadable now and then."""
    seats = (
        "CASE WHEN l_partkey % 101 = 0 THEN 'many' WHEN l_partkey % 103 = 0 THEN '-1.0'"
        " WHEN l_partkey % 7 = 0 THEN concat(seatsRemaining, '.0') WHEN l_partkey % 11 = 0 THEN concat(seatsRemaining, '.5')"
        " ELSE CAST(seatsRemaining AS STRING) END AS seatsRemaining"
    )
    others = [
        f"CAST({c} AS STRING) AS {c}"
        for c in ("searchDate", "flightDate", "startingAirport", "destinationAirport", "totalFare", "isNonStop",
                  "totalTravelDistance", "isBasicEconomy")
    ]
    return _offers(spark, sf_dir).selectExpr(*others, seats)


def offers_csv(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A CSV table of quotes at ``path``: some lines are cut short, too long or have an open quote."""
    names = ("searchDate", "flightDate", "startingAirport", "destinationAirport", "totalFare", "isNonStop",
             "seatsRemaining", "totalTravelDistance", "isBasicEconomy")
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    whole, cut = F.concat_ws(",", *values), F.concat_ws(",", *values[:6])
    key = F.col("l_partkey")
    line = F.when(key % 61 == 0, cut).when(key % 59 == 0, F.concat(whole, F.lit(",more"))).when(
        key % 53 == 0, F.concat(F.lit('"'), whole)
    ).otherwise(whole)
    # one text column whose name is the header line
    writer = _offers(spark, sf_dir).select(line.alias(",".join(names))).write.option("header", True)
    writer.option("sep", "\u0001").option("quote", "").mode("overwrite").csv(path)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS request_id",
        "CASE o_custkey % 5 WHEN 0 THEN 'ATL' WHEN 1 THEN 'BOS' WHEN 2 THEN 'LAX'"
        " WHEN 3 THEN 'ORD' ELSE IF(o_custkey % 10 = 9, 'DEN', 'XYZ') END AS origin",  # no quote leaves DEN
        "CASE o_orderkey % 4 WHEN 0 THEN 'ATL' WHEN 1 THEN 'BOS' WHEN 2 THEN 'LAX'"
        " ELSE 'ORD' END AS destination",
        "DATE'2022-06-01' AS today",
        "date_add(DATE'2022-05-29', CAST(o_orderkey % 70 AS INT)) AS flight_date",
        "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(100 + o_custkey % 200 AS DOUBLE) END AS current_price",
        "CASE o_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'Non-Stop' ELSE 'stop' END AS stops",
        f"CAST(floor(o_orderkey / {PAGE_BLOCK}) AS BIGINT) AS block",
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as text fields, with every kind of fault."""
    base = requests(spark, sf_dir).withColumn("o", F.col("request_id"))
    return base.selectExpr(
        "request_id",
        "CASE WHEN o % 13 = 0 THEN concat(' ', lower(origin), ' ')"
        " WHEN o % 17 = 0 THEN 'AT' ELSE origin END AS origin",
        "destination",
        "CASE o % 11 WHEN 0 THEN 'soon' WHEN 1 THEN '2022-02-30'"
        " ELSE CAST(flight_date AS STRING) END AS flightDate",
        "CASE o % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN '0' WHEN 4 THEN '-5'"
        " ELSE CAST(100 + o % 200 AS STRING) END AS currentPrice",
        "CASE o % 9 WHEN 0 THEN 'all' WHEN 1 THEN 'Non-Stop' WHEN 2 THEN 'stop' WHEN 3 THEN ' CONNECTING '"
        " WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'non_stop only' WHEN 7 THEN 'two' ELSE 'Stops' END AS stops",
    )


def _named(before: str, value: Column, after: str = "") -> Column:
    """A JSON field with its comma; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(before), value.cast("string"), F.lit(after)), F.lit(""))


def _option(row: Column) -> Column:
    """JSON text of one option. Written piece by piece: inside a lambda that costs less than structs and ``to_json``."""
    line, part, supplier = row["p"]["l_linenumber"], row["p"]["l_partkey"], row["p"]["l_suppkey"]
    two = line % 2 == 0
    arrival = _named(',"time":"2022-09-15 1', line, ':45"')
    minutes = _named('},"duration":', (F.lit(30) + line * 5).cast("int"))
    minutes = F.when(minutes == "", "}").otherwise(minutes)
    second = F.concat(
        F.lit(',{"departure_airport":{"id":"ATL","time":"2022-09-15 09:40"},"arrival_airport":{"id":"LAX"'),
        arrival, minutes, F.lit(',"airline":"American"'), _named(',"flight_number":"AA ', supplier % 20, '"'), F.lit("}"),
    )
    return F.concat(
        F.lit('{"flights":[{"departure_airport":{"id":"ATL"'),
        _named(',"time":"2022-09-15 0', line, ':15"'),
        F.lit('},"arrival_airport":{"id":"LAX"'),
        F.when(two, ',"time":"2022-09-15 09:00"').otherwise(arrival),
        minutes,
        F.when(row["f"]["l_quantity"] % 2 == 0, ',"airline":"Delta"').otherwise(""),
        _named(',"flight_number":"dl ', part % 50, '"'),
        F.lit("}"),
        F.when(two, F.concat(second, F.lit('],"layovers":[{"id":"DFW"}]'))).otherwise("]"),
        F.when(row["f"]["l_tax"] > 0.02, _named(',"total_duration":', (line * 10 + 60).cast("int"))).otherwise(""),
        F.when(row["f"]["l_quantity"] > 3, _named(',"price":', F.floor(row["p"]["l_extendedprice"] / 400) + 15)).otherwise(""),
        F.lit(',"airline":"Sky"}'),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON payload per order: two best options, the rest as other options.

    Options of flag A are listed a second time at the end.
    """
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    fields = F.struct("l_quantity", "l_tax", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("payload_id"), F.struct(place.alias("p"), fields.alias("f")).alias("row")
    )
    gathered = rows.groupBy("payload_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    written = gathered.withColumn("options", F.transform("rows", _option))
    copies = F.filter("options", lambda option, i: F.get(F.col("rows"), i)["f"]["l_returnflag"] == "A")
    others = F.concat(F.slice("options", 3, F.greatest(F.size("options"), F.lit(1))), copies)
    document = F.concat(
        F.lit('{"best_flights":['), F.array_join(F.slice("options", 1, 2), ","),
        F.lit('],"other_flights":['), F.array_join(others, ","), F.lit("]}"),
    )
    return written.select("payload_id", document.alias("payload"))


def payloads_as_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of which some were cut off, are missing or are no objects."""
    return payloads(spark, sf_dir).selectExpr(
        "payload_id",
        "CASE WHEN payload_id % 50 = 1 THEN substring(payload, 1, 20) WHEN payload_id % 50 = 2 THEN NULL"
        " WHEN payload_id % 50 = 3 THEN '[]' WHEN payload_id % 50 = 4 THEN '' ELSE payload END AS payload",
    )


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).selectExpr(
        f"{AIRPORT.format('oi')} AS origin",
        f"{AIRPORT.format('di')} AS destination",
        f"CAST(floor(l_orderkey / {PAGE_BLOCK}) AS BIGINT) AS block",
        "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place",
        "floor(l_extendedprice / 400) + 20 + CASE WHEN l_linenumber = 2 THEN 0.5D ELSE 0.0D END AS price",
        "CAST(date_add(DATE'2022-05-29', CAST(l_orderkey % 70 AS INT)) AS STRING) AS deal_date",
        "CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_linenumber % 3 AS INT) END AS stops",
        "l_returnflag AS carrier",
    )


def route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route pages: a headline in one of several forms, the one-way block, a decoy block.

    Every tenth block's page shows no price at all; every seventh was fetched twice, the
    first time with higher headlines and no deals.
    """
    text = """concat('{"providerName":"', d.carrier, '","price":{"price":', d.price, ',"currency":"USD"},',
        '"pickupDateIso":"', d.deal_date, '"',
        CASE WHEN d.stops IS NULL THEN '' ELSE concat(',"leg1Stops":', d.stops) END, '}')"""
    pages = (
        _deals(spark, sf_dir)
        .groupBy("origin", "destination", "block")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "price", "deal_date", "stops", "carrier"))).alias("deals"),
            (F.min("price") + 40).alias("headline"),
        )
        .withColumn("listed", F.expr(f"array_join(transform(deals, d -> {text}), ',\\n')"))
    )
    html = F.expr(
        """CASE WHEN block % 10 = 9 THEN '<html>no prices here</html>' ELSE concat(
        CASE WHEN block % 8 = 0 THEN '<div>Cheapest one-way</div><div class="p">$2,345</div>'
             WHEN block % 8 = 4 THEN '<div>Cheapest one-way</div><div class="p">$12,345</div>'
             WHEN block % 4 = 1 THEN concat('<div>cheapest ONE-WAY</div>\n', repeat('<br>', 9 * (block % 8) * (block % 8)),
               '<div class="p">$', headline, '</div>')
             ELSE '<div>Fares</div>' END,
        CASE WHEN block % 4 IN (0, 2)
             THEN concat('{"title":"Cheapest flight", "dataText":"$', headline, '","type":"x"}') ELSE '' END,
        '"cheapestPopularOneWayFlight": {"deals":[\n', listed, '\n]},"cheapestPopularDirectFlight":{"deals":[',
        '{"providerName":"Decoy","price":{"price":36},"pickupDateIso":"2022-06-10","leg1Stops":0}]}') END"""
    )
    latest = pages.select("origin", "destination", "block", F.lit(2).alias("fetched_at"), html.alias("html"))
    before = latest.filter("block % 7 = 3").withColumns(
        {"fetched_at": F.lit(1), "html": F.lit('<div>Cheapest one-way</div><div class="p">$1,400</div>')}
    )
    return latest.unionByName(before)


def city_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City-pair pages of the same routes; every twentieth block lacks them."""
    from leadcurve.operators.extract import city_of

    keys = _deals(spark, sf_dir).select("origin", "destination", "block").distinct()
    html = F.expr(
        """concat('<table><tr><th>Cheapest one-way flight</th>\n<td class="c">$', 90 + block % 7,
        '</td></tr></table>')"""
    )
    return keys.filter("block % 20 <> 19").select(
        city_of(F.col("origin")).alias("origin_city"),
        city_of(F.col("destination")).alias("destination_city"),
        "block",
        html.alias("html"),
    )
