"""Costs, savings and payback. Per-site results are rows, never driver values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import clip, positive_ratio, ratio
from ..schema import CONSUMPTION, DAY, EXPORT, IMPORT, PRODUCTION, SITE
from ..sources.dims import FINANCE_DEFAULTS, NATIONAL_RATE
from .tariffs import FEED_IN_SHARE
from .windows import trailing

DEGRADATION, LIFETIME_YEARS, DAYS_PER_YEAR = 0.005, 25, 365.25
HOURS_PER_YEAR = 8760.0

# Production multipliers of the climate comparison.
CLIMATE_MULTIPLIERS = (("Desert (Phoenix)", 1.4), ("Sunny Subtropical (Miami)", 1.2),
                       ("Temperate (Denver)", 1.0), ("Cloudy Maritime (Seattle)", 0.7))


def _require(df, *names):
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


#: What a site without a tariff row pays and gets: the national average.
NATIONAL = {"residential_rate": NATIONAL_RATE, "feed_in_tariff": NATIONAL_RATE * FEED_IN_SHARE,
            "annual_cost_per_kwh": NATIONAL_RATE / 100.0,
            "feed_in_rate_per_kwh": NATIONAL_RATE * FEED_IN_SHARE / 100.0}


def _with_rates(df: DataFrame, tariffs: DataFrame, *names) -> DataFrame:
    """Every row of ``df`` with its site's rates, or the national ones where it has none."""
    _require(tariffs, *names)
    joined = df.join(tariffs.select(SITE, *names), SITE, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(NATIONAL[n])) for n in names})


def net_system_cost(finance: DataFrame) -> DataFrame:
    """Fill defaults and derive total cost, rebates and the net cost."""
    out = finance.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in finance.columns else F.lit(v)
        for c, v in FINANCE_DEFAULTS.items()})
    product = F.col("system_size_kw") * F.col("cost_per_kw")
    total = F.coalesce("total_cost", product) if "total_cost" in finance.columns else product
    out = out.withColumn("total_cost", total)
    out = out.withColumn("federal_tax_credit", F.col("total_cost")
                         * (F.col("federal_tax_credit_percent") / F.lit(100.0)))
    out = out.withColumn("total_rebates", F.col("federal_tax_credit") + F.col("state_rebate")
                         + F.col("utility_rebate") + F.col("other_rebates"))
    return out.withColumn("net_system_cost", F.col("total_cost") - F.col("total_rebates"))


def _annual_columns(p, c, x, i, days):
    p, c, x, i, days = (F.col(n) for n in (p, c, x, i, days))
    scale = F.lit(DAYS_PER_YEAR) / days
    return {
        "annual_production_kwh": p * scale, "annual_consumption_kwh": c * scale,
        "annual_export_kwh": x * scale, "annual_import_kwh": i * scale,
        "daily_average_kwh": ratio(p, days),
        "self_consumption_rate": positive_ratio(p - x, p) * F.lit(100.0),
        "grid_independence_rate": F.when(c > 0, (F.lit(1.0) - ratio(i, c)) * F.lit(100.0))
        .otherwise(F.lit(0.0))}


TOTALS = {"_p": PRODUCTION, "_c": CONSUMPTION, "_x": EXPORT, "_i": IMPORT}


def annual_metrics(daily: DataFrame) -> DataFrame:
    """Totals scaled to 365.25 days; the number of days is the number of rows."""
    out = daily.groupBy(SITE).agg(
        *[F.sum(c).alias(n) for n, c in TOTALS.items()], F.count(F.lit(1)).alias("days_analyzed"),
        F.min(DAY).alias("start_day"), F.max(DAY).alias("end_day"))
    return out.withColumns(_annual_columns(*TOTALS, "days_analyzed")).drop(*TOTALS)


def annual_over_site(daily: DataFrame) -> DataFrame:
    """The annual metrics repeated on each day: a window on the partitioning the daily table
    already has, so the table is neither read twice nor joined to itself."""
    w = Window.partitionBy(SITE)
    df = daily.withColumns({**{n: F.sum(c).over(w) for n, c in TOTALS.items()},
                            "days_analyzed": F.count(F.lit(1)).over(w)})
    return df.withColumns(_annual_columns(*TOTALS, "days_analyzed")).drop(*TOTALS)


def financial_benefits(annual: DataFrame) -> DataFrame:
    """Needs ``annual_cost_per_kwh`` and ``feed_in_rate_per_kwh`` next to the annual metrics."""
    _require(annual, "annual_cost_per_kwh", "feed_in_rate_per_kwh")
    rate, feed_in = F.col("annual_cost_per_kwh"), F.col("feed_in_rate_per_kwh")
    income = F.col("annual_export_kwh") * feed_in
    savings = (F.col("annual_production_kwh") - F.col("annual_export_kwh")) * rate
    without = F.col("annual_consumption_kwh") * rate
    net = F.col("annual_import_kwh") * rate - income
    return annual.withColumns({
        "annual_export_income": income, "annual_import_savings": savings,
        "total_annual_savings": income + savings, "without_solar_cost": without,
        "net_electricity_cost": net, "solar_savings_vs_no_solar": without - net})


def lifetime_factor() -> float:
    """Sum of the yearly shares of first-year savings over the lifetime."""
    keep = 1.0 - DEGRADATION
    return (1.0 - keep ** LIFETIME_YEARS) / (1.0 - keep)


def roi_metrics(df: DataFrame, savings="total_annual_savings") -> DataFrame:
    """Payback (NULL when nothing is saved), lifetime savings, net benefit and ROI."""
    _require(df, savings, "net_system_cost")
    cost, saved = F.col("net_system_cost"), F.col(savings)
    lifetime = saved * F.lit(lifetime_factor())
    return df.withColumns({
        "simple_payback_years": F.when(saved > 0, ratio(cost, saved)),
        "lifetime_savings": lifetime, "net_lifetime_benefit": lifetime - cost,
        "roi_percentage": positive_ratio(lifetime - cost, cost) * F.lit(100.0)})


def _with_costs(df: DataFrame, tariffs: DataFrame, finance: DataFrame) -> DataFrame:
    """Benefits, ROI and capacity factor (percent) next to the annual metrics."""
    rated = _with_rates(df, tariffs, "annual_cost_per_kwh", "feed_in_rate_per_kwh")
    inputs = [c for c in (*FINANCE_DEFAULTS, "total_cost") if c in finance.columns]
    # defaults are filled after the join, so that a site without a finance row has them too
    costs = net_system_cost(rated.join(finance.select(SITE, *inputs), SITE, "left"))
    df = financial_benefits(costs.select(
        *rated.columns, "system_size_kw", "total_cost", "total_rebates", "net_system_cost"))
    limit = F.col("system_size_kw") * F.lit(HOURS_PER_YEAR)
    return roi_metrics(df).withColumn(
        "capacity_factor", ratio("annual_production_kwh", limit) * F.lit(100.0))


def financial_analysis(daily: DataFrame, tariffs: DataFrame, finance: DataFrame) -> DataFrame:
    """Annual metrics, benefits, ROI and capacity factor, one row per site."""
    return _with_costs(annual_metrics(daily), tariffs, finance)


def quick_roi(daily: DataFrame, analysis: DataFrame) -> DataFrame:
    """Annual production, payback and ROI from given savings and cost."""
    out = roi_metrics(analysis.select(SITE, "annual_savings", "net_system_cost"), "annual_savings")
    return annual_metrics(daily).select(SITE, "annual_production_kwh").join(out, SITE)


def simple_capacity_factor(daily: DataFrame, system_kw=10.0) -> DataFrame:
    """Total, mean and best day, and the mean against a full day of rated power."""
    return daily.groupBy(SITE).agg(
        F.sum(PRODUCTION).alias("total_kwh"), F.avg(PRODUCTION).alias("average_daily_kwh"),
        F.max(PRODUCTION).alias("best_day_kwh")).withColumn(
        "capacity_factor_pct", F.col("average_daily_kwh") / F.lit(system_kw * 24) * F.lit(100.0))


def period_benefit(daily: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Benefit of the recorded period, scaled to 365 days and against the national rate."""
    totals = daily.groupBy(SITE).agg(
        F.sum(PRODUCTION).alias("_p"), F.sum(CONSUMPTION).alias("_c"), F.sum(EXPORT).alias("_x"),
        F.sum(IMPORT).alias("_i"), F.count(F.lit(1)).alias("days"))
    df = _with_rates(totals, tariffs, "annual_cost_per_kwh", "feed_in_rate_per_kwh")
    rate = F.col("annual_cost_per_kwh")
    earned = F.col("_x") * F.col("feed_in_rate_per_kwh")
    saved = (F.col("_p") - F.col("_x")) * rate
    grid, without = F.col("_i") * rate, F.col("_c") * rate
    scale = F.lit(365.0) / F.col("days")
    benefit, net = saved + earned, grid - earned
    national = benefit * ratio(F.lit(NATIONAL_RATE / 100.0), rate)
    return df.select(
        SITE, "days", (F.col("_p") - F.col("_x")).alias("self_consumed_kwh"),
        saved.alias("self_consumption_savings"), earned.alias("export_earnings"),
        grid.alias("import_cost"), benefit.alias("total_benefit"), net.alias("net_cost"),
        (F.col("_p") * scale).alias("annual_production_kwh"),
        (benefit * scale).alias("annual_benefit"), (net * scale).alias("annual_net_cost"),
        without.alias("without_solar_cost"), (without * scale).alias("annual_without_solar_cost"),
        (without - net).alias("savings_vs_no_solar"),
        (ratio(without - net, without) * F.lit(100.0)).alias("reduction_pct"),
        (benefit - national).alias("value_vs_national"))


def climate_scenarios(analysis: DataFrame) -> DataFrame:
    """Production, savings and payback under each climate multiplier.

    Input: ``annual_production_kwh``, ``annual_cost_per_kwh``, ``net_system_cost``.
    """
    options = F.array(*[F.struct(F.lit(n).alias("climate"), F.lit(m).alias("multiplier"))
                        for n, m in CLIMATE_MULTIPLIERS])
    produced = F.col("annual_production_kwh") * F.col("multiplier")
    savings = produced * F.col("annual_cost_per_kwh")
    return analysis.select(SITE, "annual_production_kwh", "annual_cost_per_kwh",
                           "net_system_cost", F.inline(options)).select(
        SITE, "climate", "multiplier", produced.alias("adjusted_production_kwh"),
        savings.alias("adjusted_savings"),
        ratio("net_system_cost", savings).alias("adjusted_payback_years"))


def roi_projection(sites: DataFrame, years=25) -> DataFrame:
    """Cumulative savings and net benefit by year with the first positive year.

    Input: ``system_cost``, ``annual_savings``.
    """
    year = F.explode(F.sequence(F.lit(1), F.lit(years))).alias("year")
    df = sites.select(SITE, "system_cost", "annual_savings", year)
    cumulative = F.col("annual_savings") * F.col("year")
    df = df.withColumns({"cumulative_savings": cumulative,
                         "net_benefit": cumulative - F.col("system_cost")})
    first = F.min(F.when(F.col("net_benefit") > 0, F.col("year"))).over(Window.partitionBy(SITE))
    return df.withColumn("payback_year", first)


def payback_timeline(sites: DataFrame) -> DataFrame:
    """Effective cost, years to pay it back (25 without savings) and profit at year 25.

    Input: ``system_cost``, ``federal_tax_credit``, ``annual_savings``.
    """
    cost = F.col("system_cost") - F.col("federal_tax_credit")
    saved = F.col("annual_savings")
    years = F.when(saved > 0, ratio(cost, saved)).otherwise(F.lit(float(LIFETIME_YEARS)))
    return sites.select(SITE, cost.alias("effective_cost"), years.alias("payback_years"),
                        (saved * (F.lit(float(LIFETIME_YEARS)) - years)).alias("profit_year_25"))


def savings_breakdown(sites: DataFrame, years=10, certificates=500.0, other=1000.0) -> DataFrame:
    """Sources of savings over ``years`` and their shares."""
    parts = {"Federal Tax Credit": F.col("federal_tax_credit"),
             "Energy Bill Savings": F.col("annual_savings") * F.lit(float(years)),
             "SREC Income": F.lit(certificates * years), "Other": F.lit(other)}
    total = sum(parts.values(), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(n).alias("category"), v.alias("amount"),
                              (ratio(v, total) * F.lit(100.0)).alias("share_pct"))
                     for n, v in parts.items()])
    return sites.select(SITE, F.inline(rows))


def financial_daily(df: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Daily export value, import savings, their total and two efficiency ratios."""
    names = {"residential_rate": "purchase_rate", "feed_in_tariff": "feed_in_rate"}
    rated = _with_rates(df, tariffs, *names)
    rated = rated.withColumns({n: F.col(n) / F.lit(100.0) for n in names}).withColumnsRenamed(names)
    value = F.col(EXPORT) * F.col("feed_in_rate")
    saved = (F.col(CONSUMPTION) - F.col(IMPORT)) * F.col("purchase_rate")
    small = F.lit(0.01)
    return rated.withColumns({
        "daily_export_value": value, "daily_import_savings": saved,
        "daily_total_savings": value + saved,
        "financial_efficiency": ratio(value + saved, F.col(PRODUCTION) + small),
        "savings_rate": ratio(value + saved, F.col(CONSUMPTION) * F.col("purchase_rate") + small)})


def daily_net_cost(df: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Export income, import cost, net cost, savings and the self-consumption rate of a day."""
    rated = _with_rates(df, tariffs, "annual_cost_per_kwh", "feed_in_rate_per_kwh")
    income = F.col(EXPORT) * F.col("feed_in_rate_per_kwh")
    cost = F.col(IMPORT) * F.col("annual_cost_per_kwh")
    savings = (F.col(PRODUCTION) - F.col(EXPORT)) * F.col("annual_cost_per_kwh")
    used = ratio(F.col(CONSUMPTION) - F.col(IMPORT), PRODUCTION)
    return rated.withColumns({
        "export_income": income, "import_cost": cost, "daily_net_cost": cost - income,
        "self_consumption_savings": savings, "total_daily_benefit": income + savings,
        "self_consumption_rate": F.coalesce(used, F.lit(0.0))})


def financial_rolling(df: DataFrame) -> DataFrame:
    """Rolling means of savings and efficiency, weekly deviation and the 14-row trend flag."""
    saved = "daily_total_savings"
    out = {}
    for n in (7, 14, 30):
        out[f"rolling_savings_{n}d"] = F.avg(saved).over(trailing(n))
        out[f"rolling_fin_efficiency_{n}d"] = F.avg("financial_efficiency").over(trailing(n))
    out["savings_volatility_7d"] = F.stddev_samp(saved).over(trailing(7))
    rising = F.col(saved) > F.first(saved).over(trailing(14))
    out["savings_trend_14d"] = F.coalesce(rising, F.lit(False)).cast("int")
    return df.withColumns(out)


def opportunity(df: DataFrame) -> DataFrame:
    """Value of the distance to the site's 95th percentile day, absolute and against savings."""
    best = F.percentile(PRODUCTION, F.lit(0.95)).over(Window.partitionBy(SITE))
    df = df.withColumn("daily_financial_opportunity",
                       (best - F.col(PRODUCTION)) * F.col("purchase_rate"))
    return df.withColumn("opportunity_ratio", ratio(
        "daily_financial_opportunity", F.coalesce("daily_total_savings", F.lit(1.0)) + F.lit(0.01)))


def _economic_columns():
    years = F.coalesce("simple_payback_years", F.lit(float(LIFETIME_YEARS)))
    roi = F.col("roi_percentage") / F.lit(100.0)
    health = (clip(roi / F.lit(2.0), 0, 1)
              + clip(F.lit(1.0) - (years - F.lit(5.0)) / F.lit(20.0), 0, 1)) / F.lit(2.0)
    return {
        "capacity_factor": F.col("capacity_factor") / F.lit(100.0),
        "self_consumption_rate": F.col("self_consumption_rate") / F.lit(100.0),
        "grid_independence": F.col("grid_independence_rate") / F.lit(100.0),
        "annual_savings_potential": F.col("total_annual_savings"),
        "annual_export_income_potential": F.col("annual_export_income"),
        "simple_payback_years": years, "roi_percentage": roi,
        "lifetime_savings": F.col("lifetime_savings"),
        "payback_efficiency": F.lit(1.0) / F.greatest(years, F.lit(1.0)),
        "financial_health_score": health}


def economic_constants(daily: DataFrame, tariffs: DataFrame, finance: DataFrame) -> DataFrame:
    """Per-site ROI constants repeated on the rows, with payback efficiency and health score.

    A site without savings counts as a 25-year payback.
    """
    df = _with_costs(annual_over_site(daily), tariffs, finance)
    return df.select(*daily.columns, *[c.alias(n) for n, c in _economic_columns().items()])


def financial_summary(analysis: DataFrame) -> DataFrame:
    """The key figures of an analysis, one row per site."""
    return analysis.select(
        SITE, F.col("roi_percentage").alias("system_roi_percentage"),
        F.coalesce("simple_payback_years", F.lit(float(LIFETIME_YEARS))).alias("payback_years"),
        "annual_production_kwh", F.col("total_annual_savings").alias("annual_savings_dollars"),
        "capacity_factor", "self_consumption_rate", "grid_independence_rate", "lifetime_savings")
