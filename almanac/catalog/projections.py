"""Projections and filters (P and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog import panels as P
from almanac.catalog.panels import check, query, r, settle
from almanac.functions import calendar as C
from almanac.functions import scoring as S
from almanac.operators import distribution, scaling, summary, windows
from almanac.operators.split import chronological_split
from almanac.plans import features as X
from almanac.plans import requests as R
from almanac.plans.forecasts import backtest_baselines
from almanac.operators.metrics import leaderboard
from almanac.sources.tables import read_table


def _orders(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))


@query("p1_calendar_parts", """
    select o_orderkey, cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month,
    cast(day(o_orderdate) as int) as day, cast(dayofyear(o_orderdate) as int) as day_of_year,
    monthname(o_orderdate) as month_name from orders""")
def calendar_parts(spark, d):
    parts = C.date_parts("date")
    return _orders(spark, d).select(
        "o_orderkey", *[c.alias(n) for n, c in parts.items()], C.month_name("date").alias("month_name")
    )


@query("p2_quarter", """
    select o_orderkey, cast(quarter(o_orderdate) as int) as quarter from orders""")
def quarter(spark, d):
    return _orders(spark, d).select("o_orderkey", C.quarter_of(F.month("date")).alias("quarter"))


@query("p3_month_start", """
    select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month_start from orders""")
def month_start(spark, d):
    return _orders(spark, d).select(
        "o_orderkey", C.month_start(F.year("date"), F.month("date")).alias("month_start")
    )


@query("p4_month_cycle", f"""
    select o_orderkey, {r("sin(2 * pi() * month(o_orderdate) / 12)", "month_sin", 6)},
    {r("cos(2 * pi() * month(o_orderdate) / 12)", "month_cos", 6)} from orders""")
def month_cycle(spark, d):
    sin, cos = C.cyclic(F.month("date"), 12)
    return settle(_orders(spark, d).select("o_orderkey", sin.alias("month_sin"), cos.alias("month_cos")), 6)


@query("p5_day_cycle", f"""
    select o_orderkey, {r("sin(2 * pi() * dayofyear(o_orderdate) / 365)", "doy_sin", 6)},
    {r("cos(2 * pi() * dayofyear(o_orderdate) / 365)", "doy_cos", 6)} from orders""")
def day_cycle(spark, d):
    sin, cos = C.cyclic(F.dayofyear("date"), 365)
    return settle(_orders(spark, d).select("o_orderkey", sin.alias("doy_sin"), cos.alias("doy_cos")), 6)


@query("p6_day_trend", """
    select o_orderkey, cast((year(o_orderdate) - 1979) * 365 + dayofyear(o_orderdate) as int) as trend from orders""")
def day_trend(spark, d):
    return _orders(spark, d).select("o_orderkey", C.day_trend(F.year("date"), F.dayofyear("date")).alias("trend"))


@query("p7_month_trend", """
    select o_orderkey, cast(greatest(0, (year(o_orderdate) - 1997) * 12 + month(o_orderdate) - 1) as int) as trend
    from orders""")
def month_trend(spark, d):
    return _orders(spark, d).select("o_orderkey", C.month_trend(F.year("date"), F.month("date"), 1997).alias("trend"))


def _interaction(names):
    def run(spark, d):
        w = windows.series_window(windows.DAILY_ORDER)
        cols = []
        for n in names:
            value = X.INTERACTIONS[n][1]()
            cols += [value.alias(n), F.lag(value, 1).over(w).alias(f"{n}_lag_1")]
        return settle(P.covariates_daily(spark, d).select("series_id", "date", *cols), 6)

    return run


def _interaction_sql(exprs):
    cols = ", ".join(
        f"{r(e, n, 6)}, {r(f'lag({e}) over (partition by series_id order by date)', n + '_lag_1', 6)}"
        for n, e in exprs.items()
    )
    return check(f"select series_id, date, {cols} from cd", "cd")


query("p8_ratio_interaction", _interaction_sql({"temp_humidity_ratio": "temperature / (humidity + 1)"}))(
    _interaction(["temp_humidity_ratio"])
)
query("p9_product_interactions", _interaction_sql({
    "temp_humidity": "temperature * humidity / 100", "cloud_humidity": "cloud_cover * humidity / 100"}))(
    _interaction(["temp_humidity", "cloud_humidity"])
)
query("p10_wind_pressure", _interaction_sql({"wind_pressure_ratio": "wind_speed / (surface_pressure / 1000)"}))(
    _interaction(["wind_pressure_ratio"])
)


@query("p11_non_negative", check(
    f"""select series_id, year, month, {r("greatest(0.0, v)", "clamped", 2)} from (
    select series_id, year, month, value - avg(value) over (partition by series_id) as v from sm)""", "sm"))
def non_negative(spark, d):
    from pyspark.sql import Window

    anomaly = F.col("value") - F.avg("value").over(Window.partitionBy("series_id"))
    return settle(
        P.supplier_monthly(spark, d).select("series_id", "year", "month", S.non_negative(anomaly).alias("clamped")), 2
    )


# The backtest of the simple models, as steps of a DuckDB check over a monthly panel.
def backtest_steps(panel: str, prefix: str = "") -> dict[str, str]:
    x = prefix
    return {
        f"{x}po": f"""select *, row_number() over (partition by series_id order by year, month) as pos,
            count(*) over (partition by series_id) as n from {panel}""",
        f"{x}sp": f"select *, case when pos <= n - cast(ceil(0.2 * n) as bigint) then 'train' else 'test' end as split from {x}po",
        f"{x}yr": f"""select series_id, month, year, avg(value) as value, sum(value) as total, count(value) as c from {x}sp
            where split = 'train' group by 1, 2, 3""",
        f"{x}tr": f"""select series_id, month, sum(total) / sum(c) as mean, sum(c) as nr, count(*) as ny, avg(year) as my,
            regr_sxy(value, year) / (regr_sxx(value, year) + 1e-8) as slope from {x}yr group by 1, 2""",
        f"{x}te": f"""select s.series_id, s.year, s.month, s.value as actual, l1.value as lag1, l12.value as lag12,
            coalesce(mean, 100) as base, nr, ny, my, slope from {x}sp s left join {x}tr f
            on s.series_id = f.series_id and s.month = f.month
            left join {panel} l1 on l1.series_id = s.series_id and l1.year * 12 + l1.month = s.year * 12 + s.month - 1
            left join {panel} l12 on l12.series_id = s.series_id and l12.year = s.year - 1 and l12.month = s.month
            where s.split = 'test'""",
        f"{x}bt": f"""select series_id, year, month, actual, 'climatology' as model_key, base as predicted from {x}te
            union all select series_id, year, month, actual, 'climatology_trend', greatest(0.0,
              case when nr >= 5 and ny >= 2 then base + slope * (year - my) else base * (1 + 0.004 * (year - 2020)) end) from {x}te
            union all select series_id, year, month, actual, 'lag_12', lag12 from {x}te
            union all select series_id, year, month, actual, 'last_value', lag1 from {x}te""",
        f"{x}lb": f"""select series_id, model_key, count(predicted) as n, avg(abs(actual - predicted)) as mae,
            sqrt(avg((actual - predicted) * (actual - predicted))) as rmse,
            case when var_pop(case when predicted is not null then actual end) > 0 then
              1 - sum((actual - predicted) * (actual - predicted)) /
              (var_pop(case when predicted is not null then actual end) * count(predicted)) end as r2
            from {x}bt group by 1, 2""",
    }


def board(spark, d):
    return leaderboard(backtest_baselines(P.quantity_monthly(spark, d)), ["series_id"])


@query("p12_accuracy_percent", check(
    "select series_id, model_key, round(least(100, greatest(0, r2 * 100)), 1) as accuracy_percent from lb",
    "qm", **backtest_steps("qm")))
def accuracy_percent(spark, d):
    return board(spark, d).select("series_id", "model_key", S.accuracy_percent(F.col("r2")).alias("accuracy_percent"))


@query("p13_accuracy_from_mae", check(
    """select lb.series_id, model_key, round(greatest(0, 100 - mae / a * 100), 1) as accuracy_percent
    from lb join (select series_id, avg(value) as a from qm group by 1) m on lb.series_id = m.series_id""",
    "qm", **backtest_steps("qm")))
def accuracy_from_mae(spark, d):
    mean = P.quantity_monthly(spark, d).groupBy("series_id").agg(F.avg("value").alias("average"))
    no_r2 = F.lit(None).cast("double")
    return board(spark, d).join(mean, "series_id").select(
        "series_id", "model_key",
        S.accuracy_with_fallback(no_r2, F.col("mae"), F.col("average")).alias("accuracy_percent"),
    )


@query("p14_r2_band", check(
    """select series_id, model_key, case when r2 > 0.8 then 'excellent' when r2 > 0.6 then 'good'
    when r2 > 0.4 then 'moderate' else 'weak' end as band, case when r2 > 0.75 then 'excellent'
    when r2 > 0.65 then 'good' else 'weak' end as display_band from lb where r2 is not null""",
    "qm", **backtest_steps("qm")))
def r2_bands(spark, d):
    return board(spark, d).filter(F.col("r2").isNotNull()).select(
        "series_id", "model_key", S.r2_band(F.col("r2")).alias("band"),
        S.r2_display_band(F.col("r2")).alias("display_band"),
    )


@query("p15_completeness_band", check(
    f"""select series_id, {r("pct", "completeness")}, case when pct > 95 then 'excellent' when pct > 80 then 'good'
    else 'needs attention' end as status from (select series_id,
    count(*) * 100.0 / ((max(year) - min(year) + 1) * 12) as pct from sm group by 1)""", "sm"))
def completeness(spark, d):
    share = P.supplier_monthly(spark, d).groupBy("series_id").agg(
        (F.count(F.lit(1)) * 100.0 / ((F.max("year") - F.min("year") + 1) * 12)).cast("double").alias("completeness")
    )
    return settle(share.withColumn("status", S.completeness_band(F.col("completeness"))))


@query("p16_period_label", check(
    """select request_id, case when day is null then month || '/' || year
    else lpad(cast(day as varchar), 2, '0') || '/' || lpad(cast(month as varchar), 2, '0') || '/' || year end as label
    from ur""", "ur"))
def period_label(spark, d):
    return P.unchecked_requests(spark, d).select(
        "request_id", S.period_label(F.col("year"), F.col("month"), F.col("day")).alias("label")
    )


@query("p17_feature_alignment", check(
    f"""select series_id, date, cast(year as double) as year, {r("temperature", "temperature")}, cast(0 as double) as value_lag_30,
    {r("humidity", "humidity")} from dd""", "dd"))
def feature_alignment(spark, d):
    wanted = ["year", "temperature", "value_lag_30", "humidity"]
    df = P.combined_daily(spark, d)
    return settle(df.select("series_id", "date", *X.align_features(df, wanted)))


@query("p18_min_max", check(
    f"""select qd.series_id, date, {r("(value - lo) / (hi - lo)", "scaled", 6)}, {r("value", "restored")} from qd
    join (select series_id, min(value) as lo, max(value) as hi from qd group by 1) s on qd.series_id = s.series_id""",
    "qd"))
def min_max(spark, d):
    daily = P.quantity_daily(spark, d)
    scaled = daily.join(scaling.fit_min_max(daily), "series_id").withColumn("scaled", scaling.min_max(F.col("value")))
    out = scaled.select("series_id", "date", "scaled", scaling.inverse_min_max(F.col("scaled")).alias("restored"))
    return settle(out, restored=4, scaled=6)


@query("p19_standard_scale", check(
    f"""select sp.series_id, date, split, {r("(value - mu) / sigma", "scaled")} from sp
    join (select series_id, avg(value) as mu, stddev_pop(value) as sigma from sp where split = 'train' group by 1) s
    on sp.series_id = s.series_id""", "qd",
    sp="""select *, case when row_number() over (partition by series_id order by date)
        <= count(*) over (partition by series_id) - cast(ceil(0.2 * count(*) over (partition by series_id)) as bigint)
        then 'train' else 'test' end as split from qd"""))
def standard_scale(spark, d):
    rows = chronological_split(P.quantity_daily(spark, d), windows.DAILY_ORDER)
    fitted = scaling.fit_standard(rows, rows=F.col("split") == "train")
    return settle(
        rows.join(fitted, "series_id").select("series_id", "date", "split", scaling.standard(F.col("value")).alias("scaled"))
    )


@query("p20_presented_series", check(
    "select series_id, date, round(coalesce(value, 0), 2) as value from pd", "pd"))
def presented(spark, d):
    return P.partial_daily(spark, d).select("series_id", "date", S.presented(F.col("value")).alias("value"))


# --- Filters ----------------------------------------------------------------------------


@query("f1_drop_incomplete", check(
    """select * from (select series_id, date, value, lag(value, 1) over w as value_lag_1, lag(value, 30) over w as value_lag_30
    from pd window w as (partition by series_id order by date))
    where value is not null and value_lag_1 is not null and value_lag_30 is not null""", "pd"))
def drop_incomplete(spark, d):
    w = windows.series_window(windows.DAILY_ORDER)
    return P.partial_daily(spark, d).select("*", *windows.row_lags("value", [1, 30], w)).dropna()


@query("f2_positive_rows", check("select series_id, date, value from pd where value > 0", "pd"))
def positive_rows(spark, d):
    return P.partial_daily(spark, d).filter(F.col("value") > 0)


@query("f3_same_month_history", check(
    """select series_id, month, string_agg(year || ':' || cast(value as bigint), ',' order by year) as points
    from qm group by 1, 2""", "qm"))
def same_month_history(spark, d):
    points = F.transform(
        "points", lambda p: F.concat_ws(":", p["year"].cast("string"), p["value"].cast("bigint").cast("string"))
    )
    return summary.same_month_history(P.quantity_monthly(spark, d)).select(
        "series_id", "month", F.array_join(points, ",").alias("points")
    )


@query("f4_request_validation", check(
    """select *, case when year not between 1979 and 2100 then 'year out of range'
    when month not between 1 and 12 then 'month out of range'
    when day is not null and day not between 1 and 31 then 'day out of range'
    when day is not null and try_cast(year || '-' || month || '-' || day as date) is null then 'no such date'
    when day is not null and model_key not like 'daily%' then 'unknown model'
    when day is null and model_key not in ('gradient_boosting_weather', 'random_forest_weather', 'sarimax')
    then 'unknown model' end as reason from ur""", "ur"))
def request_validation(spark, d):
    return R.validate(P.unchecked_requests(spark, d))


@query("f5_iqr_outliers", """
    select event_type as series_id, event_id, value from events join (
      select event_type as t, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by 1)
    on event_type = t where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers(spark, d):
    return distribution.iqr_outliers(P.event_values(spark, d)).select("series_id", "event_id", "value")
