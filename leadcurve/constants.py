"""Fixed values. Results depend on them, so they are stated once, here."""

# Accepted fares lie strictly between these bounds.
FARE_FLOOR = 20.0
FARE_CEILING = 5000.0

# A quote table must offer these columns; the backtest needs only the second set.
OFFER_COLUMNS = (
    "searchDate",
    "flightDate",
    "startingAirport",
    "destinationAirport",
    "totalFare",
    "isNonStop",
    "seatsRemaining",
    "totalTravelDistance",
    "isBasicEconomy",
)
BACKTEST_COLUMNS = (
    "searchDate",
    "flightDate",
    "startingAirport",
    "destinationAirport",
    "totalFare",
    "isNonStop",
    "totalTravelDistance",
)

CURVE_KEYS = ("startingAirport", "destinationAirport", "flightDate", "isNonStop")

FEATURE_COLUMNS = (
    "route_cat",
    "is_nonstop",
    "days_before_departure",
    "as_of_days",
    "log_current_fare",
    "departure_day_of_week",
    "departure_month",
    "search_day_of_week",
    "totalTravelDistance",
    "departure_is_weekend",
    "near_holiday",
)
ABSOLUTE_FEATURE_COLUMNS = (
    "route_cat",
    "days_before_departure",
    "departure_day_of_week",
    "departure_month",
    "search_day_of_week",
    "totalTravelDistance",
)

# Relative fares are clipped to this range before and after learning.
RELATIVE_MIN = 0.3
RELATIVE_MAX = 3.0

# Lead days at which a booking decision is taken.
DECISION_DAYS = (21, 14, 7)
MAX_LEAD_DAYS = 60
MEANINGFUL_SAVINGS = 8.0
HOLIDAY_WINDOW_DAYS = 3
DEFAULT_FARE = 150.0

# Chronological split fractions.
TRAIN_FRACTION = 0.70
VALIDATION_FRACTION = 0.85

# The model of fares in dollars is fitted on at most so many daily rows; everything else reads all.
MAX_FITTING_PAIRS = 3_000_000
MIN_CURVE_DAYS = 8
SCORING_TARGET_DAY = 21
SCORING_MIN_DAY = 5
SEED = 42

# Candidate thresholds, in dollars of predicted saving.
THRESHOLDS = (8.0, 10.0, 15.0, 20.0, 25.0, 30.0, 40.0, 50.0, 75.0)
MINIMUM_WAIT_RATE = 0.05
BOOTSTRAP_SAMPLES = 500

# Values reported when no curve can be scored.
EMPTY_TIMING = {
    "buy_wait": 0.0,
    "median_best_day_err": 99.0,
    "median_spearman": 0.0,
    "remain_rmse": 999.0,
}

SUPPORTED_AIRPORTS = (
    "ATL", "BOS", "CLT", "DEN", "DFW", "DTW", "EWR", "IAD",
    "JFK", "LAX", "LGA", "MIA", "OAK", "ORD", "PHL", "SFO",
)

# City of each airport, as used in the addresses of city-pair pages.
CITY_SLUGS = {
    "ATL": "atlanta",
    "BOS": "boston",
    "CLT": "charlotte",
    "DEN": "denver",
    "DFW": "dallas",
    "DTW": "detroit",
    "EWR": "newark",
    "IAD": "washington",
    "JFK": "new-york",
    "LAX": "los-angeles",
    "LGA": "new-york",
    "MIA": "miami",
    "OAK": "oakland",
    "ORD": "chicago",
    "PHL": "philadelphia",
    "SFO": "san-francisco",
}

# Spellings of the stops choice after trimming, lower-casing and dropping " _-".
STOPS_SPELLINGS = {
    "": "all",
    "all": "all",
    "connecting": "connecting",
    "nonstop": "nonstop",
    "nonstoponly": "nonstop",
    "stop": "connecting",
    "stops": "connecting",
}

# Published one-way fares: accepted range (inclusive), and how far a deal's date
# may lie from the wanted one.
PUBLISHED_MIN = 35.0
PUBLISHED_MAX = 1500.0
NEARBY_DAYS = 10

# Itinerary prices: accepted range (inclusive).
ITINERARY_MIN = 20.0
ITINERARY_MAX = 5000.0

# Text patterns of the published pages.
DEALS_BLOCK = r'"cheapestPopularOneWayFlight"\s*:\s*\{'
NEXT_BLOCK = r'"cheapestPopular(?:Direct|RoundTrip|LastMinute)'
DEAL_START = '"providerName":'
DEAL_PRICE = r'"price"\s*:\s*\{\s*"price"\s*:\s*(\d+(?:\.\d+)?)'
DEAL_DATE = r'"pickupDateIso"\s*:\s*"(\d{4}-\d{2}-\d{2})"'
DEAL_STOPS = r'"leg1Stops"\s*:\s*(\d+)'
DEAL_CARRIER = r'^"([^"]+)"'
# A headline's price stands before the next headline, the end of its table row, or data.
HEADLINE = r"(?i)Cheapest one-way"
HEADLINE_OF_FLIGHT = r"(?i)Cheapest one-way flight"
HEADLINE_END = r'(?i)</tr>|"cheapestPopular|"title"\s*:'
HEADLINE_PRICE = r"\$([0-9][0-9,]*(?:\.[0-9]+)?)"
CARD_PRICE = r'(?is)"title"\s*:\s*"Cheapest flight"\s*,\s*"dataText"\s*:\s*"\$([0-9][0-9,]*(?:\.[0-9]+)?)"'

# Messages of request checks and recommendations; %s stands for what is filled in.
MSG_SAME_AIRPORT = "Origin and destination must be different airports."
MSG_UNSUPPORTED = "Pick both airports from the supported list."
MSG_NOT_FUTURE = "Flight date must be in the future."
MSG_TOO_FAR = (
    "Flight is %s days out - the model only has reliable data up to 60 days before departure. "
    "Check back closer to the flight."
)
MSG_STOPS = "Stops must be ALL, non-stop, or stop."
MSG_PRICE_TYPE = "Current price must be a number."
MSG_PRICE_SIGN = "Current price must be greater than 0."
MSG_CODE_LENGTH = "Enter valid 3-letter airport codes."
MSG_DATE = "Enter a valid flight date."
MSG_BUY = "Buy %s. Waiting isn't expected to save $8+ before departure."
MSG_WAIT = "Wait, then buy %s. Lowest predicted fare is around %s. You could save around $%s by waiting."
WINDOW_OF_ONE_DAY = "by %s"
WINDOW_OF_DAYS = "between %s and %s"
