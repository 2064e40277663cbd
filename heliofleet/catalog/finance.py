"""Costs, savings, payback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finance as Fi, windows as W
from ..sources import adapters as A
from .base import DAILY, ENERGY, catalog, values, with_
from .common import daily, tariffs
from .joins import TARIFFS
from .windows import over

CATALOG, query = catalog()
KEY = "site_id:i day:d"

COSTS = """costs AS (SELECT *, total_cost * 0.3 AS federal_tax_credit, total_cost * (30.0 / 100.0) + state_rebate AS total_rebates,
  total_cost - (total_cost * (30.0 / 100.0) + state_rebate) AS net_system_cost FROM (
  SELECT site_id, CASE WHEN site_id % 8 = 7 THEN 10.0 ELSE CAST(5 + site_id % 8 AS DOUBLE) END AS system_size_kw,
    CASE WHEN site_id % 8 = 7 THEN 10.0 ELSE CAST(5 + site_id % 8 AS DOUBLE) END * 2500 AS total_cost, CAST(site_id % 3 * 500 AS DOUBLE) AS state_rebate
  FROM (SELECT DISTINCT s_suppkey // 10 AS site_id FROM supplier) s) c)"""
ANNUAL = """annual AS (SELECT *, p * (365.25 / days_analyzed) AS annual_production_kwh, c * (365.25 / days_analyzed) AS annual_consumption_kwh,
  x * (365.25 / days_analyzed) AS annual_export_kwh, i * (365.25 / days_analyzed) AS annual_import_kwh, p / days_analyzed AS daily_average_kwh,
  CASE WHEN p > 0 THEN (p - x) / p * 100 ELSE 0 END AS self_consumption_rate, CASE WHEN c > 0 THEN (1 - i / c) * 100 ELSE 0 END AS grid_independence_rate
  FROM (SELECT site_id, sum(production_kwh) AS p, sum(consumption_kwh) AS c, sum(export_kwh) AS x, sum(import_kwh) AS i, count(*) AS days_analyzed,
    min(day) AS start_day, max(day) AS end_day FROM daily GROUP BY 1) t)"""
BENEFITS = """benefits AS (SELECT a.*, annual_cost_per_kwh, feed_in_rate_per_kwh, annual_export_kwh * feed_in_rate_per_kwh AS annual_export_income,
  (annual_production_kwh - annual_export_kwh) * annual_cost_per_kwh AS annual_import_savings,
  annual_export_kwh * feed_in_rate_per_kwh + (annual_production_kwh - annual_export_kwh) * annual_cost_per_kwh AS total_annual_savings,
  annual_consumption_kwh * annual_cost_per_kwh AS without_solar_cost,
  annual_import_kwh * annual_cost_per_kwh - annual_export_kwh * feed_in_rate_per_kwh AS net_electricity_cost,
  annual_consumption_kwh * annual_cost_per_kwh - (annual_import_kwh * annual_cost_per_kwh - annual_export_kwh * feed_in_rate_per_kwh) AS solar_savings_vs_no_solar
  FROM annual a JOIN tariffs USING (site_id))"""
LIFE = "(SELECT sum(pow(0.995, k)) FROM range(25) g(k))"
ROI = f"""roi AS (SELECT b.*, system_size_kw, total_cost, total_rebates, net_system_cost, CASE WHEN total_annual_savings > 0 THEN net_system_cost / total_annual_savings END AS simple_payback_years,
  total_annual_savings * {LIFE} AS lifetime_savings, total_annual_savings * {LIFE} - net_system_cost AS net_lifetime_benefit,
  CASE WHEN net_system_cost > 0 THEN (total_annual_savings * {LIFE} - net_system_cost) / net_system_cost * 100 ELSE 0 END AS roi_percentage,
  annual_production_kwh / (system_size_kw * 8760) * 100 AS capacity_factor FROM benefits b JOIN costs USING (site_id))"""
ANNUAL_F = ("annual_production_kwh:f annual_consumption_kwh:f annual_export_kwh:f annual_import_kwh:f daily_average_kwh:f "
            "self_consumption_rate:f grid_independence_rate:f")
BENEFITS_F = ("annual_export_income:f annual_import_savings:f total_annual_savings:f without_solar_cost:f net_electricity_cost:f "
              "solar_savings_vs_no_solar:f")
ROI_F = "simple_payback_years:f lifetime_savings:f net_lifetime_benefit:f roi_percentage:f"


def names(kinds):
    return [k.split(":")[0] for k in kinds.split()]


@query("e29_annual_metrics", with_(DAILY, ANNUAL, select="SELECT * FROM annual"),
       f"site_id:i days_analyzed:i start_day:d end_day:d {ANNUAL_F}", 4)
def e29(spark, d):
    return Fi.annual_metrics(daily(spark, d))


@query("e30_financial_benefits", with_(DAILY, TARIFFS, ANNUAL, BENEFITS, select="SELECT * FROM benefits"), f"site_id:i {BENEFITS_F}", 4)
def e30(spark, d):
    rates = tariffs(spark, d).select("site_id", "annual_cost_per_kwh", "feed_in_rate_per_kwh")
    df = Fi.financial_benefits(Fi.annual_metrics(daily(spark, d)).join(rates, "site_id"))
    return df.select("site_id", *names(BENEFITS_F))


def analysis(spark, d):
    return Fi.financial_analysis(daily(spark, d), tariffs(spark, d), A.site_finance(spark, d))


@query("e31_roi_metrics", with_(DAILY, TARIFFS, ANNUAL, BENEFITS, COSTS, ROI, select="SELECT * FROM roi"), f"site_id:i {ROI_F}", 4)
def e31(spark, d):
    rates = tariffs(spark, d).select("site_id", "annual_cost_per_kwh", "feed_in_rate_per_kwh")
    df = Fi.financial_benefits(Fi.annual_metrics(daily(spark, d)).join(rates, "site_id"))
    costs = Fi.net_system_cost(A.site_finance(spark, d)).select("site_id", "net_system_cost")
    return Fi.roi_metrics(df.join(costs, "site_id")).select("site_id", *names(ROI_F))


@query("e31_quick_roi", with_(DAILY, TARIFFS, ANNUAL, BENEFITS, COSTS, ROI, select="""
SELECT *, total_annual_savings AS annual_savings FROM roi"""),
    f"site_id:i annual_production_kwh:f annual_savings:f net_system_cost:f {ROI_F}", 4)
def e31_quick(spark, d):
    given = analysis(spark, d).select("site_id", F.col("total_annual_savings").alias("annual_savings"), "net_system_cost")
    return Fi.quick_roi(daily(spark, d), given)


@query("e32_financial_analysis", with_(DAILY, TARIFFS, ANNUAL, BENEFITS, COSTS, ROI, select="SELECT * FROM roi"),
       f"site_id:i days_analyzed:i start_day:d end_day:d {ANNUAL_F} annual_cost_per_kwh:f feed_in_rate_per_kwh:f system_size_kw:f total_cost:f "
       f"total_rebates:f net_system_cost:f {BENEFITS_F} {ROI_F} capacity_factor:f", 4)
def e32(spark, d):
    return analysis(spark, d)


@query("e32_financial_summary", with_(DAILY, TARIFFS, ANNUAL, BENEFITS, COSTS, ROI, select="""
SELECT *, roi_percentage AS system_roi_percentage, coalesce(simple_payback_years, 25) AS payback_years, total_annual_savings AS annual_savings_dollars FROM roi"""),
    "site_id:i system_roi_percentage:f payback_years:f annual_production_kwh:f annual_savings_dollars:f capacity_factor:f self_consumption_rate:f "
    "grid_independence_rate:f lifetime_savings:f", 4)
def e32_summary(spark, d):
    return Fi.financial_summary(analysis(spark, d))


@query("e32_simple_capacity_factor", with_(DAILY, select="""
SELECT site_id, sum(production_kwh) AS total_kwh, avg(production_kwh) AS average_daily_kwh, max(production_kwh) AS best_day_kwh,
  avg(production_kwh) / 240.0 * 100 AS capacity_factor_pct FROM daily GROUP BY 1"""),
    "site_id:i total_kwh:f average_daily_kwh:f best_day_kwh:f capacity_factor_pct:f")
def e32_simple(spark, d):
    return Fi.simple_capacity_factor(daily(spark, d))


@query("e33_net_system_cost", with_(COSTS, select="SELECT * FROM costs"),
       "site_id:i system_size_kw:f total_cost:f state_rebate:f federal_tax_credit:f total_rebates:f net_system_cost:f")
def e33(spark, d):
    return Fi.net_system_cost(A.site_finance(spark, d)).select(
        "site_id", "system_size_kw", "total_cost", "state_rebate", "federal_tax_credit", "total_rebates", "net_system_cost")


PERIOD = """t AS (SELECT site_id, count(*) AS days, sum(production_kwh) AS p, sum(consumption_kwh) AS c, sum(export_kwh) AS x, sum(import_kwh) AS i FROM daily GROUP BY 1),
u AS (SELECT t.*, annual_cost_per_kwh AS r, (p - x) * annual_cost_per_kwh AS sv, x * feed_in_rate_per_kwh AS ea, i * annual_cost_per_kwh AS gr,
  c * annual_cost_per_kwh AS wo, 365.0 / days AS k FROM t JOIN tariffs USING (site_id))"""


@query("e34_period_benefit", with_(DAILY, TARIFFS, PERIOD, select="""
SELECT site_id, days, p - x AS self_consumed_kwh, sv AS self_consumption_savings, ea AS export_earnings, gr AS import_cost, sv + ea AS total_benefit,
  gr - ea AS net_cost, p * k AS annual_production_kwh, (sv + ea) * k AS annual_benefit, (gr - ea) * k AS annual_net_cost, wo AS without_solar_cost,
  wo * k AS annual_without_solar_cost, wo - (gr - ea) AS savings_vs_no_solar, (wo - (gr - ea)) / wo * 100 AS reduction_pct,
  (sv + ea) - (sv + ea) * (0.1622 / r) AS value_vs_national FROM u"""),
    "site_id:i days:i self_consumed_kwh:f self_consumption_savings:f export_earnings:f import_cost:f total_benefit:f net_cost:f annual_production_kwh:f "
    "annual_benefit:f annual_net_cost:f without_solar_cost:f annual_without_solar_cost:f savings_vs_no_solar:f reduction_pct:f value_vs_national:f", 4)
def e34(spark, d):
    return Fi.period_benefit(daily(spark, d), tariffs(spark, d))


SCENARIOS = values("scenarios", Fi.CLIMATE_MULTIPLIERS, "climate, multiplier")


@query("e35_climate_scenarios", with_(DAILY, TARIFFS, ANNUAL, BENEFITS, COSTS, ROI, SCENARIOS, select="""
SELECT site_id, climate, multiplier, annual_production_kwh * multiplier AS adjusted_production_kwh,
  annual_production_kwh * multiplier * annual_cost_per_kwh AS adjusted_savings,
  net_system_cost / (annual_production_kwh * multiplier * annual_cost_per_kwh) AS adjusted_payback_years FROM roi, scenarios"""),
    "site_id:i climate:s multiplier:f adjusted_production_kwh:f adjusted_savings:f adjusted_payback_years:f", 4)
def e35(spark, d):
    return Fi.climate_scenarios(analysis(spark, d))


def system(spark, d):
    """Cost and savings of each system in the form of the projections."""
    credit = Fi.net_system_cost(A.site_finance(spark, d)).select("site_id", "federal_tax_credit")
    return analysis(spark, d).select(
        "site_id", F.col("total_cost").alias("system_cost"),
        F.col("total_annual_savings").alias("annual_savings")).join(credit, "site_id")


SYSTEM = "sys AS (SELECT site_id, r.total_cost AS system_cost, total_annual_savings AS annual_savings, federal_tax_credit FROM roi r JOIN costs USING (site_id))"
FULL = (DAILY, TARIFFS, ANNUAL, BENEFITS, COSTS, ROI, SYSTEM)


@query("e36_roi_projection", with_(*FULL, "y AS (SELECT *, unnest(range(1, 26)) AS year FROM sys)", select="""
SELECT site_id, system_cost, annual_savings, year, annual_savings * year AS cumulative_savings, annual_savings * year - system_cost AS net_benefit,
  min(CASE WHEN annual_savings * year - system_cost > 0 THEN year END) OVER (PARTITION BY site_id) AS payback_year FROM y"""),
    "site_id:i system_cost:f annual_savings:f year:i cumulative_savings:f net_benefit:f payback_year:i", 4)
def e36(spark, d):
    return Fi.roi_projection(system(spark, d))


@query("e37_payback_timeline", with_(*FULL, select="""
SELECT site_id, system_cost - federal_tax_credit AS effective_cost,
  CASE WHEN annual_savings > 0 THEN (system_cost - federal_tax_credit) / annual_savings ELSE 25 END AS payback_years,
  annual_savings * (25 - CASE WHEN annual_savings > 0 THEN (system_cost - federal_tax_credit) / annual_savings ELSE 25 END) AS profit_year_25 FROM sys"""),
    "site_id:i effective_cost:f payback_years:f profit_year_25:f", 4)
def e37(spark, d):
    return Fi.payback_timeline(system(spark, d))


@query("e38_savings_breakdown", with_(*FULL, """v AS (SELECT site_id, category, amount FROM sys, LATERAL (VALUES ('Federal Tax Credit', federal_tax_credit),
  ('Energy Bill Savings', annual_savings * 10), ('SREC Income', 5000.0), ('Other', 1000.0)) x(category, amount))""", select="""
SELECT *, amount / sum(amount) OVER (PARTITION BY site_id) * 100 AS share_pct FROM v"""),
    "site_id:i category:s amount:f share_pct:f", 4)
def e38(spark, d):
    return Fi.savings_breakdown(system(spark, d))


FIN_DAILY = """fd AS (SELECT d.*, residential_rate / 100.0 AS pr, feed_in_tariff / 100.0 AS fr FROM daily d JOIN tariffs USING (site_id)),
fin AS (SELECT *, export_kwh * fr AS daily_export_value, (consumption_kwh - import_kwh) * pr AS daily_import_savings,
  export_kwh * fr + (consumption_kwh - import_kwh) * pr AS daily_total_savings,
  (export_kwh * fr + (consumption_kwh - import_kwh) * pr) / (production_kwh + 0.01) AS financial_efficiency,
  (export_kwh * fr + (consumption_kwh - import_kwh) * pr) / (consumption_kwh * pr + 0.01) AS savings_rate FROM fd)"""
FIN_F = "daily_export_value:f daily_import_savings:f daily_total_savings:f financial_efficiency:f savings_rate:f"


def fin_daily(spark, d):
    return Fi.financial_daily(daily(spark, d), tariffs(spark, d))


@query("b10_financial_daily", with_(DAILY, TARIFFS, FIN_DAILY, select="SELECT * FROM fin"), f"{KEY} {FIN_F}")
def b10(spark, d):
    return fin_daily(spark, d).select("site_id", "day", *names(FIN_F))


@query("b11_daily_net_cost", with_(DAILY, TARIFFS, select="""
SELECT site_id, day, export_kwh * feed_in_rate_per_kwh AS export_income, import_kwh * annual_cost_per_kwh AS import_cost,
  import_kwh * annual_cost_per_kwh - export_kwh * feed_in_rate_per_kwh AS daily_net_cost, (production_kwh - export_kwh) * annual_cost_per_kwh AS self_consumption_savings,
  export_kwh * feed_in_rate_per_kwh + (production_kwh - export_kwh) * annual_cost_per_kwh AS total_daily_benefit,
  coalesce((consumption_kwh - import_kwh) / nullif(production_kwh, 0), 0) AS self_consumption_rate FROM daily JOIN tariffs USING (site_id)"""),
    f"{KEY} export_income:f import_cost:f daily_net_cost:f self_consumption_savings:f total_daily_benefit:f self_consumption_rate:f")
def b11(spark, d):
    return Fi.daily_net_cost(daily(spark, d), tariffs(spark, d)).drop(*ENERGY, "annual_cost_per_kwh", "feed_in_rate_per_kwh")


ROLL = ", ".join(f"avg(daily_total_savings) {over(n)} AS rolling_savings_{n}d, avg(financial_efficiency) {over(n)} AS rolling_fin_efficiency_{n}d"
                 for n in (7, 14, 30)) + f""", stddev_samp(daily_total_savings) {over(7)} AS savings_volatility_7d,
  CASE WHEN daily_total_savings > first_value(daily_total_savings) {over(14)} THEN 1 ELSE 0 END AS savings_trend_14d"""
ROLL_F = " ".join(f"rolling_savings_{n}d:f rolling_fin_efficiency_{n}d:f" for n in (7, 14, 30)) + " savings_volatility_7d:f savings_trend_14d:i"


@query("f11_financial_rolling", with_(DAILY, TARIFFS, FIN_DAILY, select=f"SELECT site_id, day, {ROLL} FROM fin"), f"{KEY} {ROLL_F}")
def f11(spark, d):
    return Fi.financial_rolling(fin_daily(spark, d)).select("site_id", "day", *names(ROLL_F))


P95 = "p95 AS (SELECT site_id, quantile_cont(production_kwh, 0.95) AS best FROM daily GROUP BY 1)"
OPP = """(best - production_kwh) * pr AS daily_financial_opportunity,
  (best - production_kwh) * pr / (coalesce(daily_total_savings, 1) + 0.01) AS opportunity_ratio"""


@query("f12_opportunity", with_(DAILY, TARIFFS, FIN_DAILY, P95, select=f"SELECT site_id, day, {OPP} FROM fin JOIN p95 USING (site_id)"),
       f"{KEY} daily_financial_opportunity:f opportunity_ratio:f")
def f12(spark, d):
    return Fi.opportunity(fin_daily(spark, d)).select("site_id", "day", "daily_financial_opportunity", "opportunity_ratio")


@query("f15_normalised_performance", with_(DAILY, TARIFFS, ANNUAL, BENEFITS, COSTS, ROI, select="""
SELECT site_id, day, production_kwh / nullif(daily_average_kwh, 0) AS daily_performance_ratio,
  production_kwh / nullif(daily_average_kwh, 0) * (capacity_factor / 100) AS efficiency_normalized FROM daily JOIN roi USING (site_id)"""),
    f"{KEY} daily_performance_ratio:f efficiency_normalized:f")
def f15_normalised(spark, d):
    df = Fi.economic_constants(daily(spark, d), tariffs(spark, d), A.site_finance(spark, d))
    return W.daily_performance(df).select("site_id", "day", "daily_performance_ratio", "efficiency_normalized")


ECON = """econ AS (SELECT site_id, capacity_factor / 100 AS capacity_factor, self_consumption_rate / 100 AS self_consumption_rate,
  grid_independence_rate / 100 AS grid_independence, total_annual_savings AS annual_savings_potential, annual_export_income AS annual_export_income_potential,
  coalesce(simple_payback_years, 25) AS simple_payback_years, roi_percentage / 100 AS roi_percentage, lifetime_savings,
  1.0 / greatest(coalesce(simple_payback_years, 25), 1) AS payback_efficiency,
  (greatest(0, least(1, roi_percentage / 100 / 2)) + greatest(0, least(1, 1 - (coalesce(simple_payback_years, 25) - 5) / 20))) / 2 AS financial_health_score FROM roi)"""
ECON_F = ("capacity_factor:f self_consumption_rate:f grid_independence:f annual_savings_potential:f annual_export_income_potential:f simple_payback_years:f "
          "roi_percentage:f lifetime_savings:f payback_efficiency:f financial_health_score:f")


@query("f16_economic_constants", with_(DAILY, TARIFFS, ANNUAL, BENEFITS, COSTS, ROI, ECON, select="SELECT d.site_id, d.day, econ.* EXCLUDE (site_id) FROM daily d JOIN econ USING (site_id)"),
       f"{KEY} {ECON_F}", 4)
def f16(spark, d):
    df = Fi.economic_constants(daily(spark, d), tariffs(spark, d), A.site_finance(spark, d))
    return df.select("site_id", "day", *names(ECON_F))


