"""Energy-shaped views of a retail star schema and an event log.

The given tables hold no meter readings, so thin projections give them that shape. A site
is a group of 10 suppliers, 150 customers or 15 users: those groups are the same ids at
every scale factor, so the number of sites grows with the data and the number of rows per
site stays put. Energies are whole pulses of 1/8 kWh or 1/32 of a unit, hence exact in
binary and independent of the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import CONSUMPTION, DAY, EXPORT, IMPORT, PRODUCTION, SITE, TS
from .files import read_energy_parquet

SUPPLIERS_PER_SITE, CUSTOMERS_PER_SITE, USERS_PER_SITE = 10, 150, 15


def table(spark: SparkSession, sf_dir: str, name: str, as_is=()) -> DataFrame:
    return read_energy_parquet(spark, f"{sf_dir}/{name}.parquet", as_is)


def _site(key: str, size: int):
    return F.expr(f"{key} div {size}").alias(SITE)


def _nearest(c):
    """Nearest whole number, without the decimal arithmetic of ``round``."""
    return F.floor(c + F.lit(0.5))


def daily_raw(spark, sf_dir) -> DataFrame:
    """Site-days with shipments; days without one are absent (gaps)."""
    df = table(spark, sf_dir, "lineitem", ("l_shipdate",)).select(
        _site("l_suppkey", SUPPLIERS_PER_SITE), F.to_date("l_shipdate").alias(DAY),
        F.col("l_quantity").alias("q"),
        (F.col("l_quantity") * _nearest(F.col("l_discount") * 100) / 32).alias("x"),
        (F.floor(F.col("l_extendedprice") / 125) / F.lit(8.0)).alias("c"))
    out = df.groupBy(SITE, DAY).agg(F.sum("q").alias(PRODUCTION), F.sum("c").alias(CONSUMPTION),
                                    F.sum("x").alias(EXPORT))
    need = F.col(CONSUMPTION) - (F.col(PRODUCTION) - F.col(EXPORT))
    return out.withColumn(IMPORT, F.greatest(need, F.lit(0.0)))


def api_daily(spark, sf_dir) -> DataFrame:
    """The second, production-only daily feed."""
    return (table(spark, sf_dir, "orders", ("o_orderdate",))
            .select(_site("o_custkey", CUSTOMERS_PER_SITE), F.to_date("o_orderdate").alias(DAY),
                    (F.floor(F.col("o_totalprice") / 1250) / F.lit(8.0)).alias("p"))
            .groupBy(SITE, DAY).agg(F.sum("p").alias(PRODUCTION)))


# event_type of the reading behind each energy column
CHANNELS = {"production": "purchase", "consumption": "click", "export": "signup",
            "import": "view"}


def _slot():
    """Start of the quarter hour."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(TS) / 900) * 900).alias(TS)


def intervals_wh(spark, sf_dir) -> DataFrame:
    """Quarter-hour readings in Wh; a channel without an event stays NULL."""
    cents = _nearest(F.col("value") * 100)
    events = table(spark, sf_dir, "events").select(
        _site("user_id", USERS_PER_SITE), _slot(), "event_type", cents.alias("v"))
    wh = [(F.sum(F.when(F.col("event_type") == kind, F.col("v"))) / F.lit(100.0))
          .alias(f"{name}_wh") for name, kind in CHANNELS.items()]
    faults = F.count_if(F.col("event_type") == "error").alias("faults")
    return events.groupBy(SITE, TS).agg(*wh, faults)


def intervals(spark, sf_dir) -> DataFrame:
    from .files import wh_to_kwh

    return wh_to_kwh(intervals_wh(spark, sf_dir)).drop("faults")


def readings(spark, sf_dir) -> DataFrame:
    """Single readings before any grouping: one row per production or consumption event,
    resends included (several rows may share a quarter hour)."""
    kwh = _nearest(F.col("value") * 100) / F.lit(100000.0)
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        _site("user_id", USERS_PER_SITE), _slot(),
        *[F.when(kind == k, kwh).alias(f"{n}_kwh") for n, k in CHANNELS.items()])


def weather_daily(spark, sf_dir) -> DataFrame:
    """One row per site-day: the order with the lowest key decides all numbers."""
    first = (table(spark, sf_dir, "orders", ("o_orderdate",))
             .groupBy(_site("o_custkey", CUSTOMERS_PER_SITE), F.to_date("o_orderdate").alias(DAY))
             .agg(F.min(F.struct("o_orderkey", "o_custkey")).alias("o"))
             .select(SITE, DAY, F.col("o.o_orderkey").alias("k"), F.col("o.o_custkey").alias("c")))
    numbers = {
        "sunshine_hours": "c % 13", "cloudcover_mean_pct": "c % 101", "temp_mean_c": "k % 41 - 5",
        "temp_max_c": "k % 41 - 5 + k % 8", "temp_min_c": "k % 41 - 5 - c % 8",
        "precipitation_mm": "k % 7", "solar_radiation_mj": "k % 31"}
    return first.select(SITE, DAY, *[F.expr(f"CAST({e} AS DOUBLE)").alias(n)
                                     for n, e in numbers.items()])


def weather_hourly(spark, sf_dir) -> DataFrame:
    """One row per site-hour of the event log: the event with the lowest id decides."""
    first = (table(spark, sf_dir, "events")
             .groupBy(_site("user_id", USERS_PER_SITE), F.date_trunc("hour", TS).alias(TS))
             .agg(F.min("event_id").alias("k")))
    numbers = {
        "temperature": "k % 41 - 5", "humidity": "20 + k % 71", "cloud_cover": "(k * 7) % 101",
        "visibility": "1 + k % 10", "wind_speed": "k % 16", "wind_direction": "(k * 13) % 360",
        "pressure": "990 + k % 51", "ghi": "(k * 11) % 1001", "dni": "(k * 17) % 801",
        "dhi": "(k * 5) % 301", "uv_index": "k % 12"}
    return first.select(SITE, TS, *[F.expr(f"CAST({e} AS DOUBLE)").alias(n)
                                    for n, e in numbers.items()])


def sites(spark, sf_dir) -> DataFrame:
    """Site dimension: one row per supplier group, placed in one of the listed cities."""
    from .dims import city_of

    ids = (table(spark, sf_dir, "supplier")
           .select(_site("s_suppkey", SUPPLIERS_PER_SITE)).distinct())
    return ids.select(SITE, city_of(F.col(SITE)).alias("c")).select(SITE, "c.*")


def site_finance(spark, sf_dir) -> DataFrame:
    """Per-site cost inputs; every eighth site leaves its size to the default."""
    ids = (table(spark, sf_dir, "supplier")
           .select(_site("s_suppkey", SUPPLIERS_PER_SITE)).distinct())
    none = F.lit(None).cast("double")
    return ids.select(
        SITE, F.when(F.col(SITE) % 8 != 7, (5 + F.col(SITE) % 8).cast("double"))
        .alias("system_size_kw"), none.alias("cost_per_kw"), none.alias("total_cost"),
        none.alias("federal_tax_credit_percent"),
        (F.col(SITE) % 3 * 500).cast("double").alias("state_rebate"),
        none.alias("utility_rebate"), none.alias("other_rebates"))
