"""Reading what others have written, with the rows that can't be read set aside and explained.

Nothing is dropped: a row is either good and typed, or listed with its file, its text and the reasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import SITE, TS
from ..session import pin_utc
from .files import parse_timestamp

CORRUPT = "_corrupt_record"


def read_csv_checked(spark: SparkSession, paths, columns, ts_col="Date/Time", header=True) -> DataFrame:
    """The rows of meter exports as text columns, with the typed values beside them.

    ``columns`` names the fields in order; all but the time and the site are numbers. Result: site, ts,
    the numbers, ``file``, ``line`` (the row as it came) and ``problems``, an array of reasons that is
    empty for a good row: "fields" (their number is wrong), "time", "site" or "number:<column>".
    An empty field is missing and no problem, but for the time and the site.
    """
    pin_utc(spark)
    kinds = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField(CORRUPT, T.StringType())])
    rows = (spark.read.schema(kinds).option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", True)
            .option("columnNameOfCorruptRecord", CORRUPT).csv(paths).withColumn("file", F.col("_metadata.file_name")))
    numbers = [c for c in columns if c not in (ts_col, SITE)]
    ragged = F.col(CORRUPT).isNotNull()
    ts = parse_timestamp(F.col(f"`{ts_col}`"))
    site = F.col(SITE).try_cast("bigint") if SITE in columns else None
    value = {c: F.col(f"`{c}`").try_cast("double") for c in numbers}
    reasons = [F.when(ragged, "fields"), F.when(~ragged & ts.isNull(), "time")]
    if site is not None:
        reasons.append(F.when(~ragged & site.isNull(), "site"))
    reasons += [F.when(~ragged & F.col(f"`{c}`").isNotNull() & v.isNull(), f"number:{c}") for c, v in value.items()]
    line = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]))
    own = [site.alias(SITE)] if site is not None else []
    return rows.select(*own, ts.alias(TS), *[F.when(~F.isnan(v), v).alias(c) for c, v in value.items()], "file", line.alias("line"),
                       F.array_compact(F.array(*reasons)).alias("problems"))


def check_payloads(raw: DataFrame, payload: str, required, column="payload") -> DataFrame:
    """``raw`` with ``problems``: "json" (the text is none, or doesn't fit the ``payload`` schema) or
    "missing:<path>" for each of the ``required`` paths that is absent."""
    kinds = f"{payload}, {CORRUPT} STRING"
    doc = F.from_json(F.col(column), kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    told = raw.withColumn("_doc", doc)
    broken = F.col(column).isNull() | F.col("_doc").isNull() | F.col(f"_doc.{CORRUPT}").isNotNull()
    reasons = [F.when(broken, "json")] + [F.when(~broken & F.col(f"_doc.{p}").isNull(), f"missing:{p}") for p in required]
    return told.withColumn("problems", F.array_compact(F.array(*reasons))).drop("_doc")


def good(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("problems") == 0).drop("problems", "file", "line")


def bad(checked: DataFrame) -> DataFrame:
    """One row per problem."""
    return checked.where(F.size("problems") > 0).withColumn("problem", F.explode("problems")).drop("problems")
