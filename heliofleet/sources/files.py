"""CSV and Parquet readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import DAY, SITE, TS
from ..session import pin_utc

# Accepted timestamp layouts of meter exports.
TS_FORMATS = ("yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm")
WH_NAMES = ("production", "consumption", "export", "import")


def parse_timestamp(c: Column, formats=TS_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def read_interval_csv(spark: SparkSession, paths, schema=None, ts_col="Date/Time",
                      site_id=None) -> DataFrame:
    """Meter export with a header. Values come back as DOUBLE, the time as TIMESTAMP.

    The site comes from a ``site_id`` column or folder, else from ``site_id``.
    Without ``schema`` all columns are read as text and cast, which keeps one pass
    over the files (no inference scan).
    """
    pin_utc(spark)
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(paths) if schema else reader.csv(paths)
    if ts_col not in df.columns:
        raise ValueError(f"timestamp column {ts_col!r} not in {df.columns}")
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == ts_col:
            ts = c if isinstance(f.dataType, T.TimestampType) else parse_timestamp(c.cast("string"))
            out.append(ts.alias(TS))
        elif f.name == SITE:
            out.append(c.cast("bigint").alias(SITE))
        else:
            value = c.try_cast("double")
            out.append(F.when(~F.isnan(value), value).alias(f.name))
    if SITE not in df.columns:
        out.insert(0, F.lit(site_id).cast("bigint").alias(SITE))
    return df.select(*out)


def is_wh(name: str) -> bool:
    """The name says watt-hours and not kilowatt-hours."""
    text = name.lower()
    return bool(re.search(r"(?<!k)wh", text))


def wh_to_kwh(df: DataFrame, cols=None) -> DataFrame:
    """Divide watt-hour columns by 1000 and give them their standard name.

    By default only columns whose name says Wh (not kWh) are converted; ``cols`` forces a list.
    """
    chosen = set(cols if cols is not None else [c for c in df.columns if is_wh(c)])
    out = []
    for c in df.columns:
        if c in chosen:
            role = next((r for r in WH_NAMES if r in c.lower()), None)
            name = f"{role}_kwh" if role else re.sub(r"(?i)wh", "kwh", c, count=1)
            out.append((F.col(f"`{c}`") / F.lit(1000.0)).alias(name))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def read_energy_parquet(spark: SparkSession, path, as_is=()) -> DataFrame:
    """Parquet with zone-less times cast to TIMESTAMP and NaN turned into NULL.

    Columns in ``as_is`` stay untouched: a date taken straight from a stored time keeps its
    filter pushable to the scan.
    """
    pin_utc(spark)
    df = spark.read.parquet(path)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in as_is:
            pass
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", partition_by="year",
                  mode: str = "errorifexists") -> str:
    """Write partitioned by year so that a date filter prunes folders."""
    if partition_by == "year" and "year" not in df.columns:
        source = DAY if DAY in df.columns else TS
        df = df.withColumn("year", F.year(source))
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
    return path
