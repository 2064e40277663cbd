"""Fixed dimensions: cities, state tariffs and tariff anchors.

Each list has at most 50 entries. Lookups are expressions over literals, so no join is
planned for the anchors and the state table is a local relation of known size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Latitude, longitude, time zone and display name of the known cities.
CITIES = (
    ("new_york", 40.7128, -74.0060, "America/New_York", "New York, NY"),
    ("los_angeles", 34.0522, -118.2437, "America/Los_Angeles", "Los Angeles, CA"),
    ("chicago", 41.8781, -87.6298, "America/Chicago", "Chicago, IL"),
    ("denver", 39.7392, -104.9903, "America/Denver", "Denver, CO"),
    ("miami", 25.7617, -80.1918, "America/New_York", "Miami, FL"),
    ("seattle", 47.6062, -122.3321, "America/Los_Angeles", "Seattle, WA"),
    ("phoenix", 33.4484, -112.0740, "America/Phoenix", "Phoenix, AZ"),
    ("atlanta", 33.7490, -84.3880, "America/New_York", "Atlanta, GA"),
    ("london", 51.5074, -0.1278, "Europe/London", "London, UK"),
    ("berlin", 52.5200, 13.4050, "Europe/Berlin", "Berlin, Germany"),
    ("tokyo", 35.6762, 139.6503, "Asia/Tokyo", "Tokyo, Japan"),
    ("sydney", -33.8688, 151.2093, "Australia/Sydney", "Sydney, Australia"),
)

# Residential cents per kWh by state, 2025.
STATE_RATES = (
    ("idaho", "ID", 11.69), ("north_dakota", "ND", 11.70), ("louisiana", "LA", 11.80),
    ("utah", "UT", 11.81), ("nebraska", "NE", 11.90), ("nevada", "NV", 11.42),
    ("washington", "WA", 12.05), ("oregon", "OR", 12.25), ("wyoming", "WY", 12.30),
    ("south_dakota", "SD", 12.45), ("oklahoma", "OK", 12.60), ("montana", "MT", 12.75),
    ("kansas", "KS", 13.10), ("iowa", "IA", 13.25), ("missouri", "MO", 13.40),
    ("tennessee", "TN", 13.55), ("kentucky", "KY", 13.70), ("west_virginia", "WV", 13.85),
    ("arkansas", "AR", 14.00), ("north_carolina", "NC", 14.15), ("colorado", "CO", 14.30),
    ("texas", "TX", 14.45), ("alabama", "AL", 14.60), ("minnesota", "MN", 14.75),
    ("mississippi", "MS", 14.90), ("indiana", "IN", 15.05), ("georgia", "GA", 15.20),
    ("wisconsin", "WI", 15.35), ("south_carolina", "SC", 15.50), ("ohio", "OH", 15.65),
    ("arizona", "AZ", 15.80), ("virginia", "VA", 15.95), ("illinois", "IL", 16.10),
    ("florida", "FL", 16.25), ("michigan", "MI", 16.40), ("new_mexico", "NM", 16.55),
    ("delaware", "DE", 16.70), ("pennsylvania", "PA", 16.85), ("maryland", "MD", 17.00),
    ("maine", "ME", 17.15), ("alaska", "AK", 24.50), ("vermont", "VT", 18.25),
    ("new_hampshire", "NH", 22.15), ("new_jersey", "NJ", 17.80), ("new_york", "NY", 25.30),
    ("massachusetts", "MA", 27.40), ("rhode_island", "RI", 27.84), ("connecticut", "CT", 30.24),
    ("california", "CA", 30.62), ("hawaii", "HI", 42.49),
)
NATIONAL_RATE = 16.22

# Anchor cities of the coordinate lookup, in order of precedence.
RATE_ANCHORS = (
    (37.7749, -122.4194, "CA"), (34.0522, -118.2437, "CA"), (47.6062, -122.3321, "WA"),
    (45.5152, -122.6784, "OR"), (39.7392, -104.9903, "CO"), (40.7589, -111.8883, "UT"),
    (33.4484, -112.0740, "AZ"), (36.1699, -115.1398, "NV"), (29.7604, -95.3698, "TX"),
    (32.7767, -96.7970, "TX"), (30.2672, -97.7431, "TX"), (41.8781, -87.6298, "IL"),
    (39.0458, -76.6413, "MD"), (38.9072, -77.0369, "VA"), (40.7128, -74.0060, "NY"),
    (42.3601, -71.0589, "MA"), (39.9526, -75.1652, "PA"), (25.7617, -80.1918, "FL"),
    (33.7490, -84.3880, "GA"), (35.2271, -80.8431, "NC"),
)
ANCHOR_RADIUS_DEGREES = 5.0

# Defaults of a system's financial inputs.
FINANCE_DEFAULTS = {"system_size_kw": 10.0, "cost_per_kw": 2500.0,
                    "federal_tax_credit_percent": 30.0, "state_rebate": 0.0,
                    "utility_rebate": 0.0, "other_rebates": 0.0}


def _structs(rows, names) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def city_of(position: Column) -> Column:
    """A city for a running number, round robin."""
    names = ("city", "latitude", "longitude", "timezone", "location_name")
    return F.element_at(_structs(CITIES, names), (position % len(CITIES) + 1).cast("int"))


def cities(spark: SparkSession) -> DataFrame:
    names = ("city", "latitude", "longitude", "timezone", "location_name")
    return spark.range(1).select(F.inline(_structs(CITIES, names)))


def city_key(name: Column) -> Column:
    """Lookup key of a typed city name."""
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit(","), F.lit(""))


def state_rates(spark: SparkSession) -> DataFrame:
    """50 rows."""
    rows = _structs(STATE_RATES, ("state_name", "state", "rate"))
    return spark.range(1).select(F.inline(rows))


def state_rate(abbreviation: Column) -> Column:
    """Rate of a state abbreviation from a literal map."""
    pairs = [x for _, abbr, rate in STATE_RATES for x in (F.lit(abbr), F.lit(rate))]
    return F.try_element_at(F.create_map(*pairs), abbreviation)


def anchors() -> Column:
    rows = [(pos, *a) for pos, a in enumerate(RATE_ANCHORS)]
    return _structs(rows, ("pos", "lat", "lon", "state"))
