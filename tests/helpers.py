"""Small tables shared by the tests."""

from datetime import date, timedelta

OFFER_SCHEMA = (
    "searchDate date, flightDate date, startingAirport string, destinationAirport string, "
    "totalFare double, isNonStop boolean, seatsRemaining int, totalTravelDistance double, "
    "isBasicEconomy boolean"
)
DAILY_SCHEMA = (
    "startingAirport string, destinationAirport string, flightDate date, isNonStop boolean, "
    "days_before_departure int, best_fare double, totalTravelDistance double"
)


def offer(search, flight, fare, origin="ATL", destination="LAX", nonstop=False, seats=5, distance=1940.0):
    read = date.fromisoformat
    return (
        read(search) if search else None, read(flight) if flight else None, origin, destination,
        fare, nonstop, seats, distance, False,
    )


def offers(spark, rows):
    return spark.createDataFrame(rows, OFFER_SCHEMA)


def daily(spark, curves):
    """``curves``: (origin, destination, flight date, nonstop) -> {lead day: fare}."""
    rows = [
        (o, d, flight, stop, day, float(fare), 1940.0)
        for (o, d, flight, stop), points in curves.items()
        for day, fare in points.items()
    ]
    return spark.createDataFrame(rows, DAILY_SCHEMA)


def ten_flights(spark):
    """Ten connecting ATL-LAX flights quoted 21, 14, 7 and 1 days ahead."""
    first = date(2022, 10, 1)
    points = {21: 200, 14: 180, 7: 150, 1: 170}
    return daily(spark, {("ATL", "LAX", first + timedelta(days=i), False): points for i in range(10)})
