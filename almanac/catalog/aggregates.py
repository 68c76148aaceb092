"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog import panels as P
from almanac.catalog.panels import COVARIATES, check, query, r, settle
from almanac.catalog.projections import backtest_steps
from almanac.operators import distribution, metrics, quality, rollup, summary
from almanac.plans import forecasts


@query("a1_monthly_sum", check("select series_id, year, month, value from pm", "pm"))
def monthly_sum(spark, d):
    return P.price_monthly(spark, d)


@query("a1_monthly_sum_many_series", check("select series_id, year, month, value from sm", "sm"))
def monthly_sum_many(spark, d):
    return P.supplier_monthly(spark, d)


@query("a2_monthly_covariate_means", check(
    f"select series_id, year, month, {', '.join(r(c, c, 6) for c in COVARIATES)} from cm", "cd", "cm"))
def monthly_covariate_means(spark, d):
    return settle(rollup.monthly_means(P.covariates_daily(spark, d)), 6)


@query("a2_monthly_covariate_means_required_only", check(
    f"select series_id, year, month, {', '.join(r(c, c, 6) for c in COVARIATES[:3])} from cm", "cd", "cm"))
def monthly_covariate_means_required(spark, d):
    return settle(rollup.monthly_means(P.covariates_daily(spark, d).drop("cloud_cover", "surface_pressure")), 6)


@query("a3_yearly_totals", check(
    f"select series_id, year, {r('sum(value)', 'value', 2)} from pm group by 1, 2 order by 1, 2", "pm"))
def yearly_totals(spark, d):
    return settle(rollup.yearly_totals(P.price_monthly(spark, d)), 2).orderBy("series_id", "year")


@query("a4_month_climatology", check(
    """select s.series_id, m.month, round(coalesce(v, 0), 2) as value from
    (select distinct series_id from sm) s cross join (select cast(unnest(range(1, 13)) as int) as month) m
    left join (select series_id, month, avg(value) as v from sm group by 1, 2) c
    on c.series_id = s.series_id and c.month = m.month""", "sm"))
def month_climatology(spark, d):
    return rollup.dense_month_climatology(P.supplier_monthly(spark, d))


@query("a5_day_climatology", check(
    f"""select series_id, cast(dayofyear(date) as int) as day_of_year, {r("avg(value)", "value")},
    {r("avg(temperature)", "temperature")}, {r("avg(humidity)", "humidity")}, {r("avg(wind_speed)", "wind_speed")}
    from dd group by 1, 2""", "dd"))
def day_climatology(spark, d):
    columns = ["value", "temperature", "humidity", "wind_speed"]
    return settle(rollup.day_climatology(P.combined_daily(spark, d), columns))


@query("a6_daily_summary", check(
    f"""select series_id, count(*) as n, min(date) as first_date, max(date) as last_date,
    cast(max(date) - min(date) as int) as duration_days, {r("avg(value)", "mean")},
    {r("quantile_cont(value, 0.5)", "median")}, {r("stddev_samp(value)", "std")}, {r("min(value)", "min")},
    {r("max(value)", "max")}, {r("quantile_cont(value, 0.25)", "q25")}, {r("quantile_cont(value, 0.75)", "q75")}
    from pd group by 1""", "pd"))
def daily_summary(spark, d):
    return settle(summary.daily_summary(P.partial_daily(spark, d)))


@query("a7_wet_dry_days", check(
    f"""select series_id, count(*) filter (value > 0) as wet_days, count(*) - count(*) filter (value > 0) as dry_days,
    {r("count(*) filter (value > 0) * 100.0 / count(*)", "wet_percent")},
    {r("(count(*) - count(*) filter (value > 0)) * 100.0 / count(*)", "dry_percent")} from pd group by 1""", "pd"))
def wet_dry(spark, d):
    out = summary.wet_dry(P.partial_daily(spark, d))
    return settle(out.withColumns({c: F.col(c).cast("double") for c in ("wet_percent", "dry_percent")}))


@query("a8_month_statistics", check(
    """select series_id, cast(month(date) as int) as month, round(sum(value), 2) as sum, round(avg(value), 2) as mean,
    round(stddev_samp(value), 2) as std, round(max(value), 2) as max, round(min(value), 2) as min
    from qd group by 1, 2""", "qd"))
def month_statistics(spark, d):
    daily = P.quantity_daily(spark, d).withColumn("month", F.month("date").cast("int"))
    return settle(summary.month_statistics(daily), 2)


@query("a9_monthly_summary", check(
    f"""select series_id, count(*) as n, min(year) as first_year, max(year) as last_year, {r("avg(value)", "mean")},
    {r("quantile_cont(value, 0.5)", "median")}, {r("stddev_samp(value)", "std")}, {r("min(value)", "min")},
    {r("max(value)", "max")} from sm group by 1""", "sm"))
def monthly_summary(spark, d):
    return settle(summary.monthly_summary(P.supplier_monthly(spark, d)))


@query("a10_extreme_periods", check(
    """select hi.series_id, hi.year as wettest_year, hi.month as wettest_month, hi.value as wettest_value,
    lo.year as driest_year, lo.month as driest_month, lo.value as driest_value from
    (select *, row_number() over (partition by series_id order by value desc, year, month) as k from sm) hi join
    (select *, row_number() over (partition by series_id order by value, year, month) as k from sm) lo
    on hi.series_id = lo.series_id where hi.k = 1 and lo.k = 1""", "sm"))
def extremes(spark, d):
    return summary.extremes(P.supplier_monthly(spark, d))


@query("a11_seasonal_profile", check(
    f"""select series_id, month, {r("avg(value)", "mean")}, {r("stddev_samp(value)", "std")} from sm group by 1, 2""",
    "sm"))
def seasonal_profile(spark, d):
    return settle(summary.seasonal_profile(P.supplier_monthly(spark, d)))


_BY_MONTH = {"bm": """select series_id, month, avg(value) as mean, stddev_samp(value) as std, min(value) as min,
    max(value) as max from sm group by 1, 2"""}


@query("a12_seasonality_by_month", check(
    f"""select series_id, month, {r("mean", "mean")}, {r("std", "std")}, {r("min", "min")}, {r("max", "max")},
    {r("std / nullif(mean, 0)", "cv")} from bm""", "sm", **_BY_MONTH))
def seasonality_by_month(spark, d):
    return settle(summary.seasonality_by_month(P.supplier_monthly(spark, d)))


@query("a12_seasonality_strength", check(
    f"""select series_id, {r("avg(std / nullif(mean, 0))", "mean_cv")},
    case when avg(std / nullif(mean, 0)) > 0.5 then 'strong' else 'weak' end as strength from bm group by 1""",
    "sm", **_BY_MONTH))
def seasonality_strength(spark, d):
    return settle(summary.seasonality_strength(P.supplier_monthly(spark, d)))


@query("a13_seasonal_ratio", check(
    f"""select series_id, {r("max(mean) / nullif(min(mean), 0)", "ratio")},
    coalesce(max(mean) / nullif(min(mean), 0) > 1.5, false) as is_seasonal from bm group by 1""", "sm", **_BY_MONTH))
def seasonal_ratio(spark, d):
    return settle(summary.seasonal_ratio(P.supplier_monthly(spark, d)))


@query("a14_data_quality", check(
    f"""select st.series_id, total_records, missing, duplicates,
    (first_ym // 100) || '-' || lpad(cast(first_ym % 100 as varchar), 2, '0') as first_period,
    (last_ym // 100) || '-' || lpad(cast(last_ym % 100 as varchar), 2, '0') as last_period,
    {r("mean", "mean")}, {r("median", "median")}, {r("std", "std")}, {r("min", "min")}, {r("max", "max")},
    {r("q3 - q1", "iqr")}, outliers, {r("outliers * 100.0 / total_records", "outlier_percent")}, expected_months,
    {r("total_records * 100.0 / expected_months", "completeness")},
    case when total_records * 100.0 / expected_months > 95 then 'excellent'
    when total_records * 100.0 / expected_months > 80 then 'good' else 'needs attention' end as status
    from st join ou on st.series_id = ou.series_id""", "dm",
    du="select distinct series_id, year, month, value from dm",
    st="""select *, tr - (select count(*) from du where du.series_id = g.series_id) as duplicates, tr as total_records from (
        select series_id, count(*) as tr, count(*) filter (value is null) as missing,
        min(year * 100 + month) as first_ym, max(year * 100 + month) as last_ym, avg(value) as mean,
        quantile_cont(value, 0.5) as median, stddev_samp(value) as std, min(value) as min, max(value) as max,
        quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3,
        (max(year) - min(year) + 1) * 12 as expected_months from dm group by 1) g""",
    ou="""select st.series_id, count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as outliers
        from dm d join st on d.series_id = st.series_id group by 1"""))
def data_quality(spark, d):
    out = quality.quality_report(P.delivered_monthly(spark, d))
    return settle(out.withColumns({c: F.col(c).cast("double") for c in ("outlier_percent", "completeness")}))


@query("a15_year_month_matrix", check(
    "select series_id, year, " + ", ".join(
        f"{r(f'avg(value) filter (month = {m})', f'm{m:02d}', 2)}" for m in range(1, 13)) + " from sm group by 1, 2",
    "sm"))
def year_month_matrix(spark, d):
    return settle(rollup.year_month_matrix(P.supplier_monthly(spark, d)), 2)


def _histogram_sql(source: str, bins: int) -> str:
    return check(
        f"""select b.series_id, b.bin, {r(f"lo + b.bin * ((hi - lo) / {bins})", "left_edge")},
        {r(f"lo + (b.bin + 1) * ((hi - lo) / {bins})", "right_edge")}, coalesce(c.n, 0) as n from (
        select *, cast(unnest(range({bins})) as int) as bin from lim) b left join (
        select v.series_id, cast(least({bins - 1}, floor((value - lo) / ((hi - lo) / {bins}))) as int) as bin, count(*) as n
        from src v join lim on v.series_id = lim.series_id group by 1, 2) c
        on b.series_id = c.series_id and b.bin = c.bin""",
        src=source,
        lim="select series_id, min(value) as lo, max(value) as hi from src group by 1",
    )


@query("a16_histogram_all", _histogram_sql("select event_type as series_id, value from events where value is not null", 50))
def histogram_all(spark, d):
    return settle(distribution.histogram(P.event_values(spark, d), 50))


@query("a16_histogram_positive", _histogram_sql("select event_type as series_id, value from events where value > 0", 50))
def histogram_positive(spark, d):
    return settle(distribution.histogram(P.event_values(spark, d).filter(F.col("value") > 0), 50))


@query("a17_box_plot", """
    with q as (select event_type as series_id, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
      quantile_cont(value, 0.75) as q3 from events group by 1),
    f as (select *, q1 - 1.5 * (q3 - q1) as lf, q3 + 1.5 * (q3 - q1) as hf from q)
    select series_id, round(any_value(q1), 4) as q1, round(any_value(median), 4) as median, round(any_value(q3), 4) as q3,
    min(value) filter (value between lf and hf) as whisker_low, max(value) filter (value between lf and hf) as whisker_high,
    count(*) filter (value not between lf and hf) as n_fliers from events join f on event_type = series_id group by 1""")
def box_plot(spark, d):
    return settle(distribution.box_plot(P.event_values(spark, d)))


@query("a18_regression_metrics", check(
    f"select series_id, model_key, n, {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('r2', 'r2')} from lb",
    "qm", **backtest_steps("qm")))
def regression_metrics(spark, d):
    predictions = forecasts.backtest_baselines(P.quantity_monthly(spark, d))
    return settle(metrics.regression_metrics(predictions, ["series_id", "model_key"]))


@query("a19_month_trends", check(
    f"""select series_id, month, {r("sum(t) / sum(c)", "mean")}, cast(sum(c) as bigint) as n_rows, count(*) as n_years,
    {r("avg(year)", "mean_year")}, {r("regr_sxy(v, year) / (regr_sxx(v, year) + 1e-8)", "slope")} from (
    select series_id, month, year, avg(value) as v, sum(value) as t, count(value) as c from sm group by 1, 2, 3)
    group by 1, 2""", "sm"))
def month_trends(spark, d):
    return settle(forecasts.month_trends(P.supplier_monthly(spark, d)))


_KPI = """count(*) as total_records, round(avg(value), 2) as avg_value, round(max(value), 2) as max_value,
    round(min(value), 2) as min_value, """ + ", ".join(f"round(avg({c}), 1) as avg_{c}" for c in COVARIATES)


@query("a20_dashboard_kpis", check(f"select series_id, {_KPI} from mm group by 1", "mm"))
def dashboard_kpis(spark, d):
    return summary.dashboard_kpis(P.combined_monthly(spark, d), ["series_id"])


@query("a20_dashboard_kpis_overall", check(f"select {_KPI} from mm", "mm"))
def dashboard_kpis_overall(spark, d):
    return summary.dashboard_kpis(P.combined_monthly(spark, d))


@query("a21_residual_spread", check(
    f"""select series_id, model_key, {r("stddev_pop(actual - predicted)", "std_error")}, count(*) as n from bt
    where predicted is not null group by 1, 2""", "sm", **backtest_steps("sm")))
def residual_spread(spark, d):
    predictions = forecasts.backtest_baselines(P.supplier_monthly(spark, d))
    return settle(forecasts.residual_spread(predictions, ["series_id", "model_key"]))


@query("a22_latest_same_month", check(
    f"""select series_id, month, max(year) as latest_year, arg_max(value, year) as latest_value,
    {r("avg(value)", "mean_value")} from sm group by 1, 2""", "sm"))
def latest_same_month(spark, d):
    return settle(summary.latest_same_month(P.supplier_monthly(spark, d)))
