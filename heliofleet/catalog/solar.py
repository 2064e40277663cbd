"""Solar geometry of sites, and readings enriched with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import location
from ..schema import ENERGY as COLS
from ..sources import adapters as A
from .base import DAILY, INTERVALS, catalog, with_
from .common import daily
from .joins import SITES

CATALOG, query = catalog()
KEY = "site_id:i day:d"


def decl(doy):
    return f"(23.45 * sin(radians(360.0 * (284 + {doy}) / 365.0)))"


def light(lat, doy):
    return (f"(2.0 * degrees(acos(greatest(-1.0, least(1.0, -tan(radians({lat})) * tan(radians({decl(doy)})))))) / 15.0)")


def elev(lat, doy, clock):
    return (f"greatest(0.0, degrees(asin(greatest(-1.0, least(1.0, sin(radians({lat})) * sin(radians({decl(doy)})) + "
            f"cos(radians({lat})) * cos(radians({decl(doy)})) * cos(radians(15.0 * ({clock} - 12.0))))))))")


def irr(el, lat):
    """Clear-sky irradiance of an elevation."""
    return (f"CASE WHEN {el} <= 0 THEN 0.0 ELSE greatest(0.0, 1361.0 * pow(0.75 - abs({lat}) * 0.002, "
            f"least(1.0 / sin(radians({el})), 10.0)) * sin(radians({el}))) END")


def climate(lat):
    return f"""CASE WHEN abs({lat}) < 23.5 THEN 'Tropical' WHEN abs({lat}) < 35 THEN 'Subtropical' WHEN abs({lat}) < 50 THEN 'Temperate'
  WHEN abs({lat}) < 66.5 THEN 'Subarctic/Subantarctic' ELSE 'Arctic/Antarctic' END"""


def by_lat(lat, a, b, c, e):
    return f"CASE WHEN abs({lat}) < 23.5 THEN {a} WHEN abs({lat}) < 35 THEN {b} WHEN abs({lat}) < 50 THEN {c} ELSE {e} END"


def variation(lat):
    return by_lat(lat, 0.1, 0.3, 0.5, 0.8)


def seasonal(lat, doy):
    return (f"greatest(0.2, 1 + ({variation(lat)}) * cos(2 * pi() * ({doy} - CASE WHEN {lat} >= 0 THEN 172 ELSE 355 END) / 365.0))")


def cloud(lat, doy):
    return f"(({by_lat(lat, 0.7, 0.8, 0.75, 0.6)}) * (0.8 + 0.2 * cos(2 * pi() * ({doy} - 172) / 365.0)))"


CODE = f"CASE WHEN ({climate('latitude')}) = 'Subtropical' THEN 0.8 ELSE 0.7 END"
YEAR = """cal AS (SELECT site_id, latitude, CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day FROM sites),
geo AS (SELECT *, dayofyear(day) AS doy FROM cal)"""


def _geometry(name, columns, kinds):
    @query(name, with_(SITES, YEAR, select="SELECT site_id, day, " + ", ".join(
        f"{sql} AS {c}" for c, sql in columns.items()) + " FROM geo"),
        f"{KEY} " + " ".join(f"{c}:f" for c in columns))
    def run(spark, d):
        return location.geometry_calendar(A.sites(spark, d), 2024).select("site_id", "day", *kinds)


_geometry("j1_declination", {"declination": decl("doy")}, ["declination"])
_geometry("j2_daylight", {"sunrise_hour": f"12 - {light('latitude', 'doy')} / 2", "sunset_hour": f"12 + {light('latitude', 'doy')} / 2",
                          "daylight_hours": light("latitude", "doy")}, ["sunrise_hour", "sunset_hour", "daylight_hours"])
_geometry("j5_seasonal_factor", {"seasonal_factor": seasonal("latitude", "doy")}, ["seasonal_factor"])
_geometry("j9_geometry_calendar", {
    "daylight_hours": light("latitude", "doy"), "noon_elevation": elev("latitude", "doy", "12.0"),
    "seasonal_factor": seasonal("latitude", "doy"), "declination": decl("doy")},
    ["daylight_hours", "noon_elevation", "seasonal_factor", "declination"])

CLOCK = "(hour(ts) + minute(ts) / 60.0)"
ENRICHED = f"""e0 AS (SELECT i.*, latitude, longitude, dayofyear(ts) AS doy, {elev('latitude', 'dayofyear(ts)', CLOCK)} AS solar_elevation
  FROM intervals i JOIN sites USING (site_id)),
enriched AS (SELECT site_id, ts, production_kwh, consumption_kwh, export_kwh, import_kwh, latitude, longitude, solar_elevation,
  {irr('solar_elevation', 'latitude')} AS theoretical_irradiance, {seasonal('latitude', 'doy')} AS seasonal_factor,
  {cloud('latitude', 'doy')} AS weather_factor, 12 - {light('latitude', 'doy')} / 2 AS sunrise_hour,
  12 + {light('latitude', 'doy')} / 2 AS sunset_hour, {light('latitude', 'doy')} AS daylight_hours FROM e0)"""


def enriched(spark, d):
    return location.enrich_readings(A.intervals(spark, d), A.sites(spark, d))


def _readings(name, *cols):
    @query(name, with_(INTERVALS, SITES, ENRICHED, select=f"SELECT site_id, ts, {', '.join(cols)} FROM enriched"),
           "site_id:i ts:t " + " ".join(f"{c}:f" for c in cols))
    def run(spark, d):
        return enriched(spark, d).select("site_id", "ts", *cols)


_readings("j3_elevation", "solar_elevation")
_readings("j4_irradiance", "theoretical_irradiance")
_readings("j6_cloud_factor", "weather_factor")
_readings("j8_enrich_readings", *COLS, "latitude", "longitude", "solar_elevation", "theoretical_irradiance", "seasonal_factor",
          "weather_factor", "sunrise_hour", "sunset_hour", "daylight_hours")


@query("j7_climate", with_(SITES, select=f"""
SELECT site_id, latitude, {climate('latitude')} AS climate_type, {CODE} AS climate_type_encoded,
  {by_lat('latitude', 0.7, 0.8, 0.75, 0.6)} AS cloud_factor, {by_lat('latitude', 0.8, 0.6, 0.5, 0.4)} AS humidity_factor,
  {variation('latitude')} AS seasonal_variation, 0.75 - abs(latitude) * 0.002 AS atmospheric_transmission FROM sites"""),
    "site_id:i latitude:f climate_type:s climate_type_encoded:f cloud_factor:f humidity_factor:f seasonal_variation:f atmospheric_transmission:f")
def j7(spark, d):
    return location.site_climate(location.checked_sites(A.sites(spark, d))).select(
        "site_id", "latitude", "climate_type", "climate_type_encoded", "cloud_factor", "humidity_factor",
        "seasonal_variation", "atmospheric_transmission")


DAILY_GEO = f"""d0 AS (SELECT d.*, latitude, longitude, dayofyear(day) AS doy, {light('latitude', 'dayofyear(day)')} AS theoretical_daylight_hours,
  {elev('latitude', 'dayofyear(day)', '12.0')} AS max_solar_elevation FROM daily d JOIN sites USING (site_id)),
d1 AS (SELECT *, {irr('max_solar_elevation', 'latitude')} AS theoretical_irradiance FROM d0)"""
B16 = """production_kwh / (theoretical_daylight_hours + 0.1) AS daylight_utilization,
  production_kwh / (theoretical_irradiance + 0.1) AS irradiance_efficiency, production_kwh / (max_solar_elevation + 0.1) AS elevation_efficiency,
  production_kwh / (theoretical_daylight_hours + 0.1) * 0.5 + production_kwh / (theoretical_irradiance + 0.1) * 0.5 AS solar_efficiency_score"""
B16_F = "daylight_utilization:f irradiance_efficiency:f elevation_efficiency:f solar_efficiency_score:f"
SUMMER, WINTER = light("latitude", "dayofyear(DATE '2024-06-21')"), light("latitude", "dayofyear(DATE '2024-12-21')")
B17 = f"""latitude, longitude, {CODE} AS climate_type_encoded,
  1 + ({variation('latitude')}) * cos(2 * pi() * (doy - 172) / 365.25) AS theoretical_seasonal_factor,
  (theoretical_daylight_hours - {WINTER}) / ({SUMMER} - {WINTER} + 0.1) AS daylight_hours_normalized,
  CASE WHEN avg(theoretical_irradiance) OVER (PARTITION BY site_id) > 0 THEN avg(production_kwh) OVER (PARTITION BY site_id) /
    avg(theoretical_irradiance) OVER (PARTITION BY site_id) ELSE 0.15 END AS location_capacity_factor"""
B17_F = "latitude:f longitude:f climate_type_encoded:f theoretical_seasonal_factor:f daylight_hours_normalized:f location_capacity_factor:f"
GEO_F = "theoretical_daylight_hours:f max_solar_elevation:f theoretical_irradiance:f"
GEO = "theoretical_daylight_hours, max_solar_elevation, theoretical_irradiance"


@query("j8_enrich_daily", with_(DAILY, SITES, DAILY_GEO, select=f"SELECT site_id, day, {GEO} FROM d1"), f"{KEY} {GEO_F}")
def j8_daily(spark, d):
    return location.enrich_daily(daily(spark, d), A.sites(spark, d)).select("site_id", "day", *GEO.split(", "))


@query("b16_location_efficiency", with_(DAILY, SITES, DAILY_GEO, select=f"SELECT site_id, day, {B16} FROM d1"), f"{KEY} {B16_F}")
def b16(spark, d):
    df = location.location_efficiency(location.enrich_daily(daily(spark, d), A.sites(spark, d)))
    return df.select("site_id", "day", *[c.split(":")[0] for c in B16_F.split()])


@query("b17_theoretical_features", with_(DAILY, SITES, DAILY_GEO, select=f"SELECT site_id, day, {B17} FROM d1"), f"{KEY} {B17_F}")
def b17(spark, d):
    df = location.theoretical_features(location.enrich_daily(daily(spark, d), A.sites(spark, d)))
    return df.select("site_id", "day", *[c.split(":")[0] for c in B17_F.split()])


@query("j9_geometry_extremes", with_(SITES, YEAR, f"""g AS (SELECT site_id, day, {light('latitude', 'doy')} AS l,
  {elev('latitude', 'doy', '12.0')} AS el FROM geo)""", select="""
SELECT site_id, (SELECT day FROM g q WHERE q.site_id = g.site_id ORDER BY round(l, 9) DESC, day LIMIT 1) AS longest_day, max(l) AS longest_hours,
  (SELECT day FROM g q WHERE q.site_id = g.site_id ORDER BY round(l, 9), day LIMIT 1) AS shortest_day, min(l) AS shortest_hours,
  max(el) AS max_elevation, min(el) AS min_elevation FROM g GROUP BY site_id"""),
    "site_id:i longest_day:d longest_hours:f shortest_day:d shortest_hours:f max_elevation:f min_elevation:f")
def j9_extremes(spark, d):
    return location.geometry_extremes(location.geometry_calendar(A.sites(spark, d), 2024))


@query("j10_solar_profile", with_(SITES, "p AS (SELECT *, dayofyear(DATE '2024-06-21') AS doy FROM sites)", select=f"""
SELECT site_id, 12 - {light('latitude', 'doy')} / 2 AS sunrise_hour, 12 + {light('latitude', 'doy')} / 2 AS sunset_hour,
  {light('latitude', 'doy')} AS daylight_hours, {seasonal('latitude', 'doy')} AS seasonal_factor, {cloud('latitude', 'doy')} AS weather_factor,
  {irr(elev('latitude', 'doy', '12.0'), 'latitude')} AS peak_irradiance,
  {seasonal('latitude', 'doy')} * {cloud('latitude', 'doy')} AS daily_solar_factor FROM p"""),
    "site_id:i sunrise_hour:f sunset_hour:f daylight_hours:f seasonal_factor:f weather_factor:f peak_irradiance:f daily_solar_factor:f")
def j10(spark, d):
    return location.solar_profile(A.sites(spark, d), "2024-06-21").select(
        "site_id", "sunrise_hour", "sunset_hour", "daylight_hours", "seasonal_factor", "weather_factor",
        "peak_irradiance", "daily_solar_factor")


SUMMARY = f"""location_name, latitude, longitude, timezone, {climate('latitude')} AS climate_type, {CODE} AS climate_type_encoded,
  {SUMMER} AS summer_daylight_hours, {WINTER} AS winter_daylight_hours, {variation('latitude')} AS seasonal_variation,
  {by_lat('latitude', 0.7, 0.8, 0.75, 0.6)} AS typical_cloud_factor, 0.75 - abs(latitude) * 0.002 AS atmospheric_clarity"""
SUMMARY_F = ("location_name:s latitude:f longitude:f timezone:s climate_type:s climate_type_encoded:f summer_daylight_hours:f "
             "winter_daylight_hours:f seasonal_variation:f typical_cloud_factor:f atmospheric_clarity:f")


@query("j10_location_summary", with_(SITES, select=f"SELECT site_id, city, {SUMMARY} FROM sites"), f"site_id:i city:s {SUMMARY_F}")
def j10_summary(spark, d):
    return location.location_summary(A.sites(spark, d))


@query("j10_compare_cities", with_(SITES, select=f"""
SELECT site_id, city, {SUMMARY} FROM sites WHERE city IN ('phoenix', 'miami', 'seattle', 'denver')"""), f"site_id:i city:s {SUMMARY_F}")
def j10_cities(spark, d):
    sites = A.sites(spark, d).where(F.col("city").isin("phoenix", "miami", "seattle", "denver"))
    return location.location_summary(sites)


@query("j11_approximate_daylight", with_(DAILY, select="""
SELECT site_id, day, 12 + 4 * sin(2 * pi() * (dayofyear(day) - 81) / 365.0) AS approx_daylight_hours FROM daily"""),
    f"{KEY} approx_daylight_hours:f")
def j11(spark, d):
    return location.daylight_profile(daily(spark, d)).select("site_id", "day", "approx_daylight_hours")


LOCATION_DAILY = """ld AS (SELECT site_id, CAST(ts AS DATE) AS day, coalesce(sum(production_kwh), 0) AS production_kwh,
  coalesce(sum(consumption_kwh), 0) AS consumption_kwh, max(solar_elevation) AS solar_elevation, max(theoretical_irradiance) AS theoretical_irradiance,
  avg(seasonal_factor) AS seasonal_factor, avg(weather_factor) AS weather_factor, arg_min(daylight_hours, ts) AS daylight_hours
  FROM enriched GROUP BY 1, 2)"""


@query("e53_location_daily", with_(INTERVALS, SITES, ENRICHED, LOCATION_DAILY, select="""
SELECT *, production_kwh / daylight_hours AS production_per_daylight_hour, month(day) AS month, dayofyear(day) AS day_of_year FROM ld"""),
    f"{KEY} production_kwh:f consumption_kwh:f solar_elevation:f theoretical_irradiance:f seasonal_factor:f weather_factor:f "
    "daylight_hours:f production_per_daylight_hour:f month:i day_of_year:i")
def e53(spark, d):
    return location.location_daily(enriched(spark, d))


@query("e53_location_monthly", with_(INTERVALS, SITES, ENRICHED, LOCATION_DAILY, select="""
SELECT site_id, month(day) AS month, avg(production_kwh) AS mean, stddev_samp(production_kwh) AS std, min(production_kwh) AS min, max(production_kwh) AS max,
  avg(daylight_hours) AS daylight_hours, avg(theoretical_irradiance) AS theoretical_irradiance, avg(seasonal_factor) AS seasonal_factor,
  avg(weather_factor) AS weather_factor FROM ld GROUP BY 1, 2"""),
    "site_id:i month:i mean:f std:f min:f max:f daylight_hours:f theoretical_irradiance:f seasonal_factor:f weather_factor:f")
def e53_monthly(spark, d):
    return location.location_monthly(location.location_daily(enriched(spark, d)))


