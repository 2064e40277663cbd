"""Electricity rates of sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import SITE
from ..sources import dims

FEED_IN_SHARE = 0.80


def nearest_state(latitude, longitude) -> Column:
    """State of the nearest anchor city closer than the radius, as an expression over the
    20 literal anchors: nothing is joined. The earlier anchor wins a tie."""
    lat, lon = F.col(latitude), F.col(longitude)

    def distance(a):
        return F.sqrt((lat - a["lat"]) * (lat - a["lat"]) + (lon - a["lon"]) * (lon - a["lon"]))

    ranked = F.transform(dims.anchors(), lambda a: F.struct(
        distance(a).alias("d"), a["pos"].alias("pos"), a["state"].alias("state")))
    near = F.filter(ranked, lambda a: a["d"] < dims.ANCHOR_RADIUS_DEGREES)
    return F.array_min(near)["state"]


def _graded(df: DataFrame) -> DataFrame:
    known = F.col("rate").isNotNull()
    return df.withColumns({
        "residential_rate": F.coalesce("rate", F.lit(dims.NATIONAL_RATE)),
        "source": F.when(known, "state_average").otherwise("national_average"),
        "confidence": F.when(known, "medium").otherwise("low")}).drop("rate")


def nearest_tariff(sites: DataFrame) -> DataFrame:
    """Rate of the nearest anchor's state, else the national average."""
    df = sites.withColumn("state", nearest_state("latitude", "longitude"))
    return _graded(df.withColumn("rate", dims.state_rate(F.col("state"))))


def tariff_by_state(df: DataFrame, column="state") -> DataFrame:
    """Rate by state name or abbreviation, else the national average.

    The 50-row table is a local relation; its size is known to the planner.
    """
    key = F.replace(F.lower(F.col(column)), F.lit(" "), F.lit("_"))
    rates = dims.state_rates(df.sparkSession)
    by_name = rates.select(F.col("state_name").alias("_key"), F.col("state").alias("_abbr"), "rate")
    by_abbr = rates.select(F.lower("state").alias("_key"), F.col("state").alias("_abbr"), "rate")
    lookup = by_name.unionByName(by_abbr)
    joined = df.withColumn("_key", key).join(lookup, "_key", "left")
    return _graded(joined).withColumnRenamed("_abbr", "state_code").drop("_key")


def rate_summary(rates: DataFrame) -> DataFrame:
    """Feed-in estimate, dollars per kWh and distance from the national average."""
    rate = F.col("residential_rate")
    feed_in = rate * F.lit(FEED_IN_SHARE)
    return rates.withColumns({
        "feed_in_tariff": feed_in, "annual_cost_per_kwh": rate / F.lit(100.0),
        "feed_in_rate_per_kwh": feed_in / F.lit(100.0),
        "vs_national_avg": rate - F.lit(dims.NATIONAL_RATE),
        "is_above_average": rate > dims.NATIONAL_RATE})


def site_tariffs(sites: DataFrame) -> DataFrame:
    """The tariff columns other operators need, one row per site."""
    return rate_summary(nearest_tariff(sites)).select(
        SITE, "state", "residential_rate", "feed_in_tariff", "annual_cost_per_kwh",
        "feed_in_rate_per_kwh")


#: Cells are cut into FINER x FINER at most FINEST times, until none holds more than FEW places of anchors.
FINER, FINEST, FEW = 4, 8, 8


def _depth(places: DataFrame, cell) -> int:
    """How often the cells are to be cut."""
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), cell("_lat", k).alias("y"), cell("_lon", k).alias("x"))
                                for k in range(FINEST + 1)])).alias("c")
    full = places.select(every).groupBy("c").agg(F.count(F.lit(1)).alias("n")).groupBy("c.k").agg(F.max("n").alias("n"))
    return min([r.k for r in full.collect() if r.n <= FEW], default=FINEST)  # a row per level


def nearest_anchor(sites: DataFrame, anchors: DataFrame, radius: float = dims.ANCHOR_RADIUS_DEGREES) -> DataFrame:
    """``sites`` with ``anchor`` and ``anchor_distance``: the nearest row of a table of anchors.

    ``anchors`` has anchor, latitude and longitude, and any number of rows. The plane is cut into cells of
    the radius, so an anchor closer than that lies in a site's cell or one of the eight around it. These
    are cut finer step by step, and at each step only cells are kept that can hold the nearest anchor of
    a site: no site's cell meets all anchors of its surroundings, however many there are. Exactly
    ``radius`` away is too far; of equally near anchors the smallest wins; NULL where none is near.
    """
    def cell(c, k):
        return F.floor(F.col(c) * F.lit(float(FINER ** k)) / F.lit(float(radius)))

    def finite(*columns):
        return reduce(lambda a, b: a & b, [F.abs(F.col(c)) < F.lit(float("inf")) for c in columns])

    places = anchors.where(finite("latitude", "longitude")).groupBy(
        F.col("latitude").cast("double").alias("_lat"), F.col("longitude").cast("double").alias("_lon")).agg(
        F.min(F.struct("anchor")).alias("_a"))
    depth = _depth(places, cell)
    placed = sites.where(finite("latitude", "longitude")).select(
        SITE, "latitude", "longitude", cell("latitude", depth).alias("_y"), cell("longitude", depth).alias("_x"))

    def box(prefix, lat, lon):
        return [f(c).alias(f"{prefix}{n}") for c, n in ((lat, "lat"), (lon, "lon")) for f, n in ((F.min, f"{n}0"), (F.max, f"{n}1"))]

    def boxes(k):
        return places.groupBy(cell("_lat", k).alias("_cy"), cell("_lon", k).alias("_cx")).agg(*box("_c", "_lat", "_lon"))

    def gap(n):
        return F.greatest(F.lit(0.0), F.col(f"_c{n}0") - F.col(f"_s{n}1"), F.col(f"_s{n}0") - F.col(f"_c{n}1"))

    def reach(n):
        return F.greatest(F.col(f"_c{n}1") - F.col(f"_s{n}0"), F.col(f"_s{n}1") - F.col(f"_c{n}0"))

    def possible(found):
        """Those no farther than another cell's anchors are for sure; with some room for rounding."""
        least, most = (F.sqrt(f("lat") * f("lat") + f("lon") * f("lon")) for f in (gap, reach))
        told = found.withColumn("_least", least).withColumn("_bound", F.min(most).over(Window.partitionBy("_y", "_x")))
        kept = told.where((F.col("_least") <= F.col("_bound") * 1.000001 + 1e-9) & (F.col("_least") <= F.lit(float(radius) * 1.000001)))
        return kept.select("_y", "_x", "_slat0", "_slat1", "_slon0", "_slon1", "_cy", "_cx")

    def coarser(c, k):
        return F.floor(F.col(c) / F.lit(float(FINER ** k)))

    around = F.array(*[F.struct((coarser("_y", depth) + i).alias("_cy"), (coarser("_x", depth) + j).alias("_cx"))
                       for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cells = placed.groupBy("_y", "_x").agg(*box("_s", "latitude", "longitude"))
    near = possible(cells.select("*", F.inline(around)).join(boxes(0), ["_cy", "_cx"]))
    for k in range(1, depth + 1):
        finer = boxes(k).withColumns({"_py": coarser("_cy", 1), "_px": coarser("_cx", 1)})
        near = possible(near.withColumnsRenamed({"_cy": "_py", "_cx": "_px"}).join(finer, ["_py", "_px"]))
    listed = near.select("_y", "_x", "_cy", "_cx").join(
        places.select("*", cell("_lat", depth).alias("_cy"), cell("_lon", depth).alias("_cx")), ["_cy", "_cx"])
    lat, lon = F.col("latitude") - F.col("_lat"), F.col("longitude") - F.col("_lon")
    best = (placed.join(listed, ["_y", "_x"]).withColumn("_d", F.sqrt(lat * lat + lon * lon))
            .where(F.col("_d") < F.lit(float(radius))).groupBy(SITE)
            .agg(F.min(F.struct("_d", F.col("_a.anchor").alias("anchor"))).alias("_n")))
    return sites.join(best, SITE, "left").select(
        *sites.columns, F.col("_n.anchor").alias("anchor"), F.col("_n._d").alias("anchor_distance"))
