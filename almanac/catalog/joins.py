"""Joins and lookups (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog import panels as P
from almanac.catalog.panels import COVARIATES, check, query, r, settle
from almanac.catalog.projections import backtest_steps, board
from almanac.functions.scoring import accuracy_percent
from almanac.operators import relate, rollup
from almanac.operators.metrics import regression_metrics
from almanac.plans import lookback, tuning
from almanac.plans.forecasts import backtest_baselines
from almanac.session import shared_dir
from almanac.sources.sinks import overwrite_metrics, read_metrics, stored


@query("j1_daily_with_covariates", check(
    f"select series_id, date, value, {', '.join(r(c, c) for c in COVARIATES)}, year, month, day from dd", "dd"))
def daily_with_covariates(spark, d):
    return settle(P.combined_daily(spark, d))


@query("j2_monthly_with_covariates", check(
    f"select series_id, year, month, value, {', '.join(r(c, c, 6) for c in COVARIATES)}, date from mm", "mm"))
def monthly_with_covariates(spark, d):
    return settle(P.combined_monthly(spark, d), 6)


def monthly_lookback_steps(panel: str, series: str) -> dict[str, str]:
    """History features ``lk`` of every request in ``rq``, one join per lag."""
    known = " + ".join(f"(case when p{k} is null then 0 else 1 end)" for k in (1, 2, 3))
    return {
        "cl": f"select series_id, month, avg(value) as m from {panel} group by 1, 2",
        "ov": "select series_id, avg(m) as o from cl group by 1",
        "base": f"""select q.request_id, q.{series} as series_id, q.year, q.month, f1.value as p1, f2.value as p2,
            f3.value as p3, f12.value as p12, coalesce(c0.m, ov.o) as def, coalesce(c1.m, c0.m, ov.o) as nl1 from rq q
            left join {panel} f1 on f1.series_id = q.{series} and f1.year * 12 + f1.month = q.year * 12 + q.month - 1
            left join {panel} f2 on f2.series_id = q.{series} and f2.year * 12 + f2.month = q.year * 12 + q.month - 2
            left join {panel} f3 on f3.series_id = q.{series} and f3.year * 12 + f3.month = q.year * 12 + q.month - 3
            left join {panel} f12 on f12.series_id = q.{series} and f12.year = q.year - 1 and f12.month = q.month
            left join cl c0 on c0.series_id = q.{series} and c0.month = q.month
            left join cl c1 on c1.series_id = q.{series} and c1.month = (q.month + 10) % 12 + 1
            left join ov on ov.series_id = q.{series}""",
        "lk": f"""select request_id, base.series_id, base.year, base.month, coalesce(p1, nl1) as value_lag_1,
            coalesce(p12, def) as value_lag_12, case when {known} >= 2
            then (coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0)) / ({known})
            else coalesce((nl1 + c2.m + c3.m) / 3, def) end as value_ma_3, def as value_ma_12 from base
            left join cl c2 on c2.series_id = base.series_id and c2.month = (base.month + 9) % 12 + 1
            left join cl c3 on c3.series_id = base.series_id and c3.month = (base.month + 8) % 12 + 1""",
    }


_MONTHLY_SLOTS = ["value_lag_1", "value_lag_12", "value_ma_3", "value_ma_12"]


@query("j3_monthly_lookback", check(
    f"select request_id, series_id, year, month, {', '.join(r(c, c, 2) for c in _MONTHLY_SLOTS)} from lk",
    "pm", "rq", **monthly_lookback_steps("pm", "priority")))
def monthly_lookback(spark, d):
    requests = P.lookback_requests(spark, d).select("request_id", F.col("priority").alias("series_id"), "year", "month")
    out = lookback.monthly_lookback(requests, P.price_monthly(spark, d))
    return settle(out.select("request_id", "series_id", "year", "month", *_MONTHLY_SLOTS), 2)


DAILY_LOOKBACK_STEPS = {
    "doy": """select series_id, dayofyear(date) as doy, avg(value) as v, avg(temperature) as t, avg(humidity) as h,
        avg(wind_speed) as w from dd group by 1, 2""",
    "allrows": """select series_id, avg(value) as v, avg(temperature) as t, avg(humidity) as h, avg(wind_speed) as w
        from dd group by 1""",
    "tail": """select series_id, date, avg(value) over x as m, count(value) over x as c from dd
        window x as (partition by series_id order by date rows between 6 preceding and current row)""",
    "lk": """select q.request_id, q.flag as series_id, q.date, coalesce(f1.value, vc.v, g.v) as value_lag_1,
        coalesce(f7.value, vc.v, g.v) as value_lag_7, coalesce(f30.value, vc.v, g.v) as value_lag_30,
        case when t.c >= 2 then t.m else coalesce(vc.v, g.v) end as value_ma_7,
        coalesce(f1.temperature, vc.t, g.t) as temperature_lag_1, coalesce(vc.t, g.t) as temperature_ma_7,
        coalesce(vc.h, g.h) as humidity_lag_1, coalesce(vc.w, g.w) as wind_speed_lag_1 from rq q
        left join dd f1 on f1.series_id = q.flag and f1.date = q.date - 1
        left join dd f7 on f7.series_id = q.flag and f7.date = q.date - 7
        left join dd f30 on f30.series_id = q.flag and f30.date = q.date - 30
        left join doy vc on vc.series_id = q.flag and vc.doy = dayofyear(q.date)
        left join allrows g on g.series_id = q.flag
        asof left join tail t on t.series_id = q.flag and q.date > t.date""",
}
_DAILY_SLOTS = [
    "value_lag_1", "value_lag_7", "value_lag_30", "value_ma_7", "temperature_lag_1", "temperature_ma_7",
    "humidity_lag_1", "wind_speed_lag_1",
]


@query("j4_daily_lookback", check(
    f"select request_id, series_id, date, {', '.join(r(c, c) for c in _DAILY_SLOTS)} from lk", "dd", "rq",
    **DAILY_LOOKBACK_STEPS))
def daily_lookback(spark, d):
    requests = P.lookback_requests(spark, d).select("request_id", F.col("flag").alias("series_id"), "date")
    out = lookback.daily_lookback(requests, stored(P.combined_daily(spark, d), "daily"))
    return settle(out.select("request_id", "series_id", "date", *_DAILY_SLOTS))


@query("j5_last_rows_before", check(
    f"""select q.request_id, q.flag as series_id, q.date, {r("t.m", "tail_mean")}, coalesce(t.c, 0) as tail_n from rq q
    asof left join tail t on t.series_id = q.flag and q.date > t.date""", "qd", "rq",
    tail="""select series_id, date, avg(value) over x as m, count(value) over x as c from qd
        window x as (partition by series_id order by date rows between 6 preceding and current row)"""))
def last_rows_before(spark, d):
    requests = P.lookback_requests(spark, d).select("request_id", F.col("flag").alias("series_id"), "date")
    cells = requests.select("series_id", "date").distinct()
    tails = lookback.tail_mean(cells, P.quantity_daily(spark, d))
    out = lookback.rejoined(requests, tails, ["series_id", "date"])
    return settle(out.select("request_id", "series_id", "date", "tail_mean", "tail_n"))


@query("j6_covariate_lookup", check(
    f"""select q.request_id, q.flag as series_id, q.month, {', '.join(r('n.' + c, c) for c in COVARIATES)} from rq q
    left join (select series_id, month, {', '.join(f'avg({c}) as {c}' for c in COVARIATES)} from cm group by 1, 2) n
    on n.series_id = q.flag and n.month = q.month""", "cd", "cm", "rq"))
def covariate_lookup(spark, d):
    requests = P.lookback_requests(spark, d).select("request_id", F.col("flag").alias("series_id"), "month")
    monthly = rollup.monthly_means(P.covariates_daily(spark, d))
    out = relate.covariate_lookup(requests, monthly)
    return settle(out.select("request_id", "series_id", "month", *COVARIATES))


_OVERALL = """select model_key, avg(abs(actual - predicted)) as mae,
    sqrt(avg((actual - predicted) * (actual - predicted))) as rmse,
    1 - sum((actual - predicted) * (actual - predicted)) /
    (var_pop(case when predicted is not null then actual end) * count(predicted)) as r2_score from {} group by 1"""


def overall_metrics(monthly):
    """Errors of the simple models over all series of a panel, in the metrics-table layout."""
    m = regression_metrics(backtest_baselines(monthly), ["model_key"]).withColumnRenamed("r2", "r2_score")
    return m.select("model_key", "mae", "rmse", "r2_score", accuracy_percent(F.col("r2_score")).alias("accuracy_percent"))


def stored_metrics(spark, metrics):
    """Metrics written to a store of their own and read back, so that several readers cost one backtest."""
    path = shared_dir(spark, "metrics")
    overwrite_metrics(metrics, path)
    return read_metrics(spark, path)


_TWO_STORES = {
    **backtest_steps("qm"),
    **backtest_steps("sm", "x"),
    "pri": f"select * from ({_OVERALL.format('bt')}) where model_key in ('climatology', 'lag_12')",
    "sec": f"""select 'daily_' || model_key as model_key, mae, rmse, r2_score,
        round(least(100, greatest(0, r2_score * 100)), 1) as accuracy_percent from ({_OVERALL.format('xbt')})
        union all select model_key, mae, rmse, r2_score, round(least(100, greatest(0, r2_score * 100)), 1) from ({_OVERALL.format('xbt')})""",
    "reg": "select distinct model_key, 'Model ' || model_key as name from bt",
}


@query("j7_metrics_fallback", check(
    f"""select reg.model_key, name, round(coalesce(pri.mae, sec.mae), 2) as mae, round(coalesce(pri.rmse, sec.rmse), 2) as rmse,
    round(coalesce(pri.r2_score, sec.r2_score), 4) as r2_score,
    case when pri.r2_score is not null then round(least(100, greatest(0, pri.r2_score * 100)), 1)
    else sec.accuracy_percent end as accuracy_percent from reg left join pri on pri.model_key = reg.model_key
    left join sec on sec.model_key = reg.model_key
    union all select model_key, 'Climatology' as name, round(mae, 2), round(rmse, 2), round(r2_score, 4), accuracy_percent
    from sec where model_key = 'daily_climatology'
    union all select model_key, 'Climatology Trend' as name, round(mae, 2), round(rmse, 2), round(r2_score, 4), accuracy_percent
    from sec where model_key = 'daily_climatology_trend'
    union all select model_key, 'Lag 12' as name, round(mae, 2), round(rmse, 2), round(r2_score, 4), accuracy_percent
    from sec where model_key = 'daily_lag_12'
    union all select model_key, 'Last Value' as name, round(mae, 2), round(rmse, 2), round(r2_score, 4), accuracy_percent
    from sec where model_key = 'daily_last_value'""",
    "qm", "sm", **_TWO_STORES))
def metrics_fallback(spark, d):
    first = stored_metrics(spark, overall_metrics(P.quantity_monthly(spark, d)))
    second = stored_metrics(spark, overall_metrics(P.supplier_monthly(spark, d)))
    registry = first.select("model_key", F.concat(F.lit("Model "), "model_key").alias("name"))
    primary = first.filter(F.col("model_key").isin("climatology", "lag_12"))
    secondary = second.withColumn("model_key", F.concat(F.lit("daily_"), "model_key")).unionByName(second)
    merged = relate.fallback_merge(registry, primary, secondary)
    return settle(merged, mae=2, rmse=2)


@query("j8_side_by_side", check(
    f"""select a.series_id, a.model_key as model_a, b.model_key as model_b,
    {', '.join(r(f'{t}.{m}', f'{m}_{t}') for m in ('mae', 'rmse', 'r2') for t in 'ab')},
    {', '.join(r(f'a.{m} - b.{m}', f'{m}_delta') for m in ('mae', 'rmse', 'r2'))}
    from lb a join lb b on a.series_id = b.series_id
    where a.model_key = 'climatology' and b.model_key = 'lag_12'""", "qm", **backtest_steps("qm")))
def side_by_side(spark, d):
    metrics = board(spark, d)
    asked = P.quantity_monthly(spark, d).select("series_id").distinct().select(
        "series_id", F.lit("climatology").alias("model_a"), F.lit("lag_12").alias("model_b")
    )
    return settle(relate.side_by_side(metrics, asked))


@query("j9_parameter_grid", check(
    """select a.v as trees, b.v as rate, c.v as depth, f.v as leaf, e.v as subsample, n_rows from
    (select cast(unnest([100, 200, 300, 400]) as double) as v) a, (select cast(unnest([0.01, 0.05, 0.1, 0.15]) as double) as v) b,
    (select cast(unnest([3, 4, 5, 6, 7]) as double) as v) c, (select cast(unnest([3, 5, 7, 10]) as double) as v) f,
    (select cast(unnest([0.6, 0.8, 0.9, 1.0]) as double) as v) e, (select count(*) as n_rows from sm)""", "sm"))
def parameter_grid(spark, d):
    """The search grid, once, with the rows of the panel that each combination would be fitted on."""
    size = P.supplier_monthly(spark, d).agg(F.count(F.lit(1)).alias("n_rows"))
    plan = tuning.expand_grid(size, tuning.HOLD_OUT_GRID)
    return plan.select(*[F.col("params")[n].alias(n) for n in tuning.HOLD_OUT_GRID], "n_rows")
