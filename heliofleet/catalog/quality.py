"""Data quality of interval feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q, sketches, timeline
from ..sources import adapters as A
from .base import API, ENERGY, INTERVALS, RAW_DAILY, READINGS, catalog, with_
from .projections import GAPS, GAP_ROWS

CATALOG, query = catalog()

LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT site_id, ts, '{c}' AS col, {i} AS pos, {c} AS value FROM intervals"
    for i, c in enumerate(ENERGY)) + ")"
FENCES = """fences AS (SELECT site_id, col, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75,
  quantile_cont(value, 0.25) - (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) * 1.5 AS lower,
  quantile_cont(value, 0.75) + (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) * 1.5 AS upper
  FROM long WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4)"""
COMPLETE = """complete AS (SELECT site_id, col, count(*) AS cells, count(value) AS present FROM long GROUP BY 1, 2
  UNION ALL SELECT site_id, '*', count(*), count(value) FROM long GROUP BY 1)"""


@query("e21_completeness", with_(INTERVALS, LONG, COMPLETE, select="""
SELECT site_id, col AS "column", cells, present, cells - present AS missing, present / cells * 100 AS completeness_pct FROM complete"""),
    'site_id:i "column":s cells:i present:i missing:i completeness_pct:f')
def e21(spark, d):
    return Q.completeness(A.intervals(spark, d))


@query("e22_missing_values", with_(INTERVALS, LONG, """m AS (SELECT site_id, col, pos, count(*) - count(value) AS missing,
  (count(*) - count(value)) / count(*) * 100 AS missing_pct FROM long GROUP BY 1, 2, 3)""", select="""
SELECT site_id, col AS "column", missing, missing_pct,
  CASE WHEN missing_pct > 50 THEN 'drop' WHEN missing_pct > 10 THEN 'investigate' ELSE 'keep' END AS action,
  CASE WHEN max(missing) OVER (PARTITION BY site_id) > 0 THEN first_value(col) OVER (PARTITION BY site_id ORDER BY missing DESC, pos) END AS worst_column,
  max(missing_pct) OVER (PARTITION BY site_id) AS worst_column_pct FROM m"""),
    'site_id:i "column":s missing:i missing_pct:f action:s worst_column:s worst_column_pct:f')
def e22(spark, d):
    return Q.missing_values(A.intervals(spark, d))


RULES = """rules AS (
  SELECT site_id, 'negative_production' AS rule, 'issue' AS level, count(*) FILTER (production_kwh < 0) AS records FROM intervals GROUP BY 1
  UNION ALL SELECT site_id, 'excess_export', 'issue', count(*) FILTER (export_kwh > production_kwh) FROM intervals GROUP BY 1
  UNION ALL SELECT site_id, 'energy_balance', 'warning', count(*) FILTER (abs((production_kwh - consumption_kwh) - (export_kwh - import_kwh)) > 0.1) FROM intervals GROUP BY 1
  UNION ALL SELECT site_id, 'negative_consumption', 'note', count(*) FILTER (consumption_kwh < 0) FROM intervals GROUP BY 1
  UNION ALL SELECT site_id, 'negative_export', 'note', count(*) FILTER (export_kwh < 0) FROM intervals GROUP BY 1
  UNION ALL SELECT site_id, 'negative_import', 'note', count(*) FILTER (import_kwh < 0) FROM intervals GROUP BY 1
  UNION ALL SELECT site_id, 'high_production', 'note', count(*) FILTER (production_kwh > 0.5) FROM intervals GROUP BY 1
  UNION ALL SELECT site_id, 'missing_values', 'note', count(*) * 4 - count(production_kwh) - count(consumption_kwh) - count(export_kwh) - count(import_kwh) FROM intervals GROUP BY 1
  UNION ALL SELECT l.site_id, 'outliers:' || l.col, 'warning', count(*) FILTER (value < lower OR value > upper) FROM long l JOIN fences f ON f.site_id = l.site_id AND f.col = l.col GROUP BY 1, 2
  UNION ALL SELECT site_id, 'duplicate_timestamps', 'note', count(*) - count(DISTINCT ts) FROM intervals GROUP BY 1)"""


@query("e23_integrity", with_(INTERVALS, LONG, FENCES, RULES, select="SELECT * FROM rules"),
       "site_id:i rule:s level:s records:i")
def e23(spark, d):
    return Q.integrity(A.intervals(spark, d))


@query("e24_iqr_outlier_counts", with_(INTERVALS, LONG, FENCES, select="""
SELECT l.site_id, l.col AS "column", p25, p75, lower, upper, count(*) FILTER (value < lower OR value > upper) AS outliers
FROM long l JOIN fences f ON f.site_id = l.site_id AND f.col = l.col WHERE value IS NOT NULL GROUP BY ALL"""),
    'site_id:i "column":s p25:f p75:f lower:f upper:f outliers:i')
def e24(spark, d):
    return Q.iqr_outlier_counts(A.intervals(spark, d))


@query("e24_iqr_outliers", with_(INTERVALS, LONG, FENCES, select="""
SELECT l.site_id, ts, l.col AS "column", value, lower, upper FROM long l JOIN fences f ON f.site_id = l.site_id AND f.col = l.col
WHERE value < lower OR value > upper"""), 'site_id:i ts:t "column":s value:f lower:f upper:f')
def e24_rows(spark, d):
    return Q.iqr_outliers(A.intervals(spark, d))


@query("e25_quality_score", with_(INTERVALS, LONG, FENCES, RULES, COMPLETE, """k AS (SELECT site_id,
  count(*) FILTER (level = 'issue' AND records > 0) AS issues, count(*) FILTER (level = 'warning' AND records > 0) AS warnings FROM rules GROUP BY 1),
s AS (SELECT c.site_id, c.cells - c.present AS missing, c.present / c.cells * 100 AS completeness_pct, issues, warnings,
  greatest(0, least(100, 100 - (c.cells - c.present) / c.cells * 100 * 0.5 - issues * 10 - warnings * 2)) AS quality_score
  FROM complete c JOIN k USING (site_id) WHERE c.col = '*')""", select="""
SELECT *, CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 75 THEN 'Good' WHEN quality_score >= 60 THEN 'Fair' ELSE 'Poor' END AS assessment FROM s"""),
    "site_id:i missing:i completeness_pct:f issues:i warnings:i quality_score:f assessment:s")
def e25(spark, d):
    return Q.quality_score(A.intervals(spark, d))


NAME = """CASE WHEN expected_seconds = 900 THEN '15min' WHEN expected_seconds = 3600 THEN 'hourly'
  WHEN expected_seconds = 86400 THEN 'daily' ELSE 'custom_' || expected_seconds || 's' END"""


@query("e26_granularity", with_(INTERVALS, GAPS, select=f"""
SELECT site_id, expected_seconds AS step_seconds, steps, {NAME} AS granularity FROM common
JOIN (SELECT site_id, count(*) AS steps FROM steps GROUP BY 1) n USING (site_id)"""),
    "site_id:i step_seconds:i steps:i granularity:s")
def e26(spark, d):
    return timeline.granularity(A.intervals(spark, d))


@query("e27_temporal_completeness", with_(INTERVALS, GAPS, """t AS (SELECT s.site_id, expected_seconds, sum(step) AS span_seconds,
  count(*) + 1 AS actual_records, count(*) FILTER (step > expected_seconds * 1.5) AS gaps_detected,
  max(step) FILTER (step > expected_seconds * 1.5) AS largest_gap_seconds FROM steps s JOIN common USING (site_id) GROUP BY 1, 2),
u AS (SELECT *, floor(span_seconds / expected_seconds) + 1 AS expected_records FROM t)""", select="""
SELECT *, actual_records / expected_records * 100 AS temporal_completeness_pct, expected_records - actual_records AS missing_intervals FROM u"""),
    "site_id:i expected_seconds:i span_seconds:i actual_records:i gaps_detected:i largest_gap_seconds:i expected_records:i "
    "temporal_completeness_pct:f missing_intervals:i")
def e27(spark, d):
    return timeline.temporal_completeness(A.intervals(spark, d))


@query("e28_duplicate_timestamps", with_(READINGS, select="""
SELECT site_id, count(*) AS rows, count(*) - count(DISTINCT ts) AS duplicates FROM readings GROUP BY 1"""),
    "site_id:i rows:i duplicates:i")
def e28(spark, d):
    return timeline.duplicate_timestamps(A.readings(spark, d))


@query("e19_dataset_overview", with_(INTERVALS, GAPS, f"""o AS (SELECT site_id, count(*) AS records, min(ts) AS start, max(ts) AS "end",
  floor((epoch(max(ts)) - epoch(min(ts))) / 86400) + 1 AS duration_days FROM intervals GROUP BY 1),
g AS (SELECT site_id, {NAME} AS granularity FROM common),
x AS (SELECT o.*, coalesce(granularity, 'insufficient_data') AS granularity, duration_days *
  CASE granularity WHEN '15min' THEN 96 WHEN 'hourly' THEN 24 WHEN 'daily' THEN 1 END AS expected_records FROM o LEFT JOIN g USING (site_id))""", select="""
SELECT *, 4 AS columns, records / expected_records * 100 AS completeness_pct FROM x"""),
    'site_id:i records:i start:t "end":t columns:i duration_days:i granularity:s expected_records:i completeness_pct:f')
def e19(spark, d):
    return timeline.dataset_overview(A.intervals(spark, d))


def _source(name, table, stamp, filled, cols):
    """Records, range, completeness and granularity of one source."""
    return f"""SELECT a.site_id, records, start_day, end_day, completeness_pct, granularity, '{name}' AS source FROM (
  SELECT site_id, count(*) AS records, CAST(min({stamp}) AS DATE) AS start_day, CAST(max({stamp}) AS DATE) AS end_day,
    ({filled}) / (count(*) * {cols}) * 100 AS completeness_pct FROM {table} GROUP BY 1) a
  LEFT JOIN (SELECT site_id, {NAME} AS granularity FROM (
    SELECT site_id, step AS expected_seconds FROM (SELECT site_id, step, count(*) AS n FROM (
      SELECT site_id, CAST(epoch({stamp}) - epoch(lag({stamp}) OVER (PARTITION BY site_id ORDER BY {stamp})) AS BIGINT) AS step FROM {table}) q
      WHERE step IS NOT NULL GROUP BY 1, 2) c QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY n DESC, step) = 1) e) g USING (site_id)"""


_FILLED = " + ".join(f"count({c})" for c in ENERGY)


@query("e54_source_summary", with_(INTERVALS, API, select=_source("csv", "intervals", "ts", _FILLED, 4)
       + " UNION ALL " + _source("api", "api", "day", "count(production_kwh)", 1)),
    "site_id:i records:i start_day:d end_day:d completeness_pct:f granularity:s source:s")
def e54(spark, d):
    return Q.source_summary({"csv": A.intervals(spark, d), "api": A.api_daily(spark, d)})


@query("e55_feature_readiness", with_(INTERVALS, """m AS (SELECT site_id, count(*) AS days, greatest(""" + ", ".join(
    f"(count(*) - count({c})) / count(*)" for c in ENERGY) + """) * 100 AS worst_missing_pct FROM intervals GROUP BY 1)""", select="""
SELECT *, 1 AS valid, CASE WHEN days < 30 THEN 1 ELSE 0 END AS short_rolling, CASE WHEN days < 14 THEN 1 ELSE 0 END AS short_lags,
  CASE WHEN worst_missing_pct > 10 THEN 1 ELSE 0 END AS high_missing, 1 AS has_consumption FROM m"""),
    "site_id:i days:i worst_missing_pct:f valid:i short_rolling:i short_lags:i high_missing:i has_consumption:i")
def e55(spark, d):
    return Q.feature_readiness(A.intervals(spark, d))


@query("f14_time_gaps", with_(INTERVALS, GAPS, select=GAP_ROWS),
       "site_id:i gap_start:t gap_end:t gap_seconds:i expected_seconds:i")
def f14(spark, d):
    return timeline.time_gaps(A.intervals(spark, d))


@query("f14_daily_gaps", with_(RAW_DAILY, """t AS (SELECT site_id, day, lag(day) OVER (PARTITION BY site_id ORDER BY day) AS p FROM raw_daily)""", select="""
SELECT site_id, CAST(p AS TIMESTAMP) AS gap_start, CAST(day AS TIMESTAMP) AS gap_end, date_diff('day', p, day) * 86400 AS gap_seconds, 86400 AS expected_seconds
FROM t WHERE date_diff('day', p, day) >= 2"""),
    "site_id:i gap_start:t gap_end:t gap_seconds:i expected_seconds:i")
def f14_daily(spark, d):
    return timeline.time_gaps(A.daily_raw(spark, d))


PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("e24_sketched_quantiles", with_(INTERVALS, "r AS (SELECT site_id, count(production_kwh) AS n FROM intervals WHERE CAST(ts AS DATE) >= DATE '2024-01-05' GROUP BY 1)", select=f"""
SELECT site_id, prob, n, 1 AS within FROM r, LATERAL (SELECT unnest([{', '.join(map(str, PROBS))}]) AS prob) p WHERE n > 0"""),
    "site_id:i prob:f n:i within:i")
def e24_sketched(spark, d):
    """Quantiles of a range of days from daily sketches: the rank of each is held against all values."""
    rows = A.intervals(spark, d)
    first = "2024-01-05"
    told = sketches.range_quantiles(sketches.daily_sketches(rows, ["production_kwh"]), PROBS, first)
    errors = sketches.rank_errors(rows.where(F.to_date("ts") >= F.lit(first).cast("date")), told, "production_kwh", PROBS)
    # a few values leave steps of 1 / n between ranks
    return errors.select("site_id", "prob", "n", (F.col("rank_error") <= sketches.RANK_ERROR + 1 / F.col("n")).alias("within"))
