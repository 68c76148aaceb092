"""Models, validation and forecasting jobs (M), and what hangs on a fitted model (S8, T3).

The trained models here are small so that a run takes seconds; the defaults in
``plans.training`` and ``plans.tuning`` are the full sizes.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from almanac.catalog import panels as P
from almanac.catalog.joins import DAILY_LOOKBACK_STEPS, monthly_lookback_steps
from almanac.catalog.panels import check, query, r, settle
from almanac.catalog.projections import backtest_steps
from almanac.catalog.rolling import daily_body
from almanac.catalog.stored import FORECAST_STEPS
from almanac.functions import calendar as C
from almanac.operators import distribution, metrics, rollup, scaling, split, windows
from almanac.plans import autoregression as A
from almanac.plans import features as X
from almanac.plans import arma, forecasts, sarima, scoring, second_order, stationarity, training, tuning
from almanac.session import shared_dir
from almanac.sources.sinks import stored

# --- Closed-form forecasters ------------------------------------------------------------


def _asked(spark, d):
    return P.lookback_requests(spark, d).select("request_id", F.col("priority").alias("series_id"), "year", "month")


@query("m17_climatology_trend_forecast", check(
    f"select request_id, series_id, year, month, {r('predicted', 'predicted', 2)} from fc", "pm", "rq", **FORECAST_STEPS))
def climatology_trend_forecast(spark, d):
    return settle(forecasts.climatology_trend_forecast(_asked(spark, d), P.price_monthly(spark, d)), 2)


Z95, Z90 = 1.959963984540054, 1.6448536269514722
_SPREAD = """select series_id, stddev_pop(actual - predicted) as se from bt
    where model_key = 'climatology_trend' and predicted is not null group by 1"""


def _interval_sql(columns: str, source: str, z: float, level: str) -> str:
    return f"""select {columns}, round(greatest(0.0, predicted), 2) as point_estimate,
    round(greatest(0.0, predicted - {z} * se), 2) as lower_bound, round(predicted + {z} * se, 2) as upper_bound,
    round({z} * se, 2) as margin_of_error, round(se, 2) as std_error, '{level}' as confidence_level
    from {source} f left join spread on spread.series_id = f.series_id"""


def _spread(monthly):
    predictions = forecasts.backtest_baselines(monthly).filter(F.col("model_key") == "climatology_trend")
    return forecasts.residual_spread(predictions, ["series_id"])


@query("m9_forecast_interval", check(
    _interval_sql("request_id, f.series_id, f.year, f.month", "fc", Z95, "95%"), "pm", "rq",
    **FORECAST_STEPS, **backtest_steps("pm"), spread=_SPREAD))
def forecast_interval(spark, d):
    monthly = P.price_monthly(spark, d)
    points = forecasts.climatology_trend_forecast(_asked(spark, d), monthly)
    return forecasts.with_interval(points, _spread(monthly), 0.95)


@query("m10_month_range_forecast", check(
    _interval_sql("f.series_id, f.year, f.month", "mf", Z90, "90%"), "sm", **backtest_steps("sm"), spread=_SPREAD,
    fy="select series_id, month, year, avg(value) as v, sum(value) as t, count(value) as c from sm group by 1, 2, 3",
    ft="""select series_id, month, sum(t) / sum(c) as mean, sum(c) as nr, count(*) as ny, avg(year) as my,
        regr_sxy(v, year) / (regr_sxx(v, year) + 1e-8) as slope from fy group by 1, 2""",
    mf="""select q.series_id, q.year, q.month, greatest(0.0, case when nr >= 5 and ny >= 2
        then coalesce(mean, 100) + slope * (q.year - my) else coalesce(mean, 100) * (1 + 0.004 * (q.year - 2020)) end) as predicted
        from (select series_id, last_year + 1 as year, cast(unnest(range(1, 13)) as int) as month from
        (select series_id, max(year) as last_year from sm group by 1)) q
        left join ft on ft.series_id = q.series_id and ft.month = q.month"""))
def month_range_forecast(spark, d):
    """All months of the year after each series ends."""
    monthly = P.supplier_monthly(spark, d)
    years = monthly.groupBy("series_id").agg((F.max("year") + 1).cast("int").alias("year"))
    asked = forecasts.month_range(
        years.select("*", F.lit(1).alias("start_month"), F.lit(12).alias("end_month"))
    )
    points = forecasts.climatology_trend_forecast(asked, monthly)
    return forecasts.with_interval(points, _spread(monthly), 0.90)


@query("m16_leaderboard", check(
    f"""select series_id, model_key, n, {r("mae", "mae")}, {r("rmse", "rmse")}, {r("r2", "r2")},
    round(least(100, greatest(0, r2 * 100)), 1) as accuracy_percent, case when r2 > 0.8 then 'excellent'
    when r2 > 0.6 then 'good' when r2 > 0.4 then 'moderate' when r2 is not null then 'weak' end as band from lb""",
    "sm", **backtest_steps("sm")))
def leaderboard(spark, d):
    return settle(metrics.leaderboard(forecasts.backtest_baselines(P.supplier_monthly(spark, d)), ["series_id"]))


def _ar1_steps(panel: str) -> dict[str, str]:
    return {
        "po": f"""select *, row_number() over w as pos, count(*) over (partition by series_id) as n,
            lag(value, 1) over w as prev, value - lag(value, 1) over w as diff,
            lag(value, 1) over w - lag(value, 2) over w as pdiff from {panel}
            window w as (partition by series_id order by year, month)""",
        "sp": "select *, case when pos <= n - cast(ceil(0.2 * n) as bigint) then 'train' else 'test' end as split from po",
        "ft": """select series_id, regr_slope(diff, pdiff) as phi, regr_intercept(diff, pdiff) as c, max(pos) as nt,
            arg_max(value, pos) as lv, arg_max(diff, pos) as ld from sp where split = 'train' group by 1""",
        "pr": """select sp.series_id, year, month, value, split, phi, c, case when split = 'train' then prev + c + phi * pdiff
            else lv + (pos - nt) * (c / (1 - phi)) + (ld - c / (1 - phi)) * phi * (1 - phi ** (pos - nt)) / (1 - phi) end
            as predicted from sp join ft on ft.series_id = sp.series_id""",
    }


def _split_metrics_sql(source: str, columns: str) -> str:
    parts = []
    for s in ("train", "test"):
        keep = f"split = '{s}' and predicted is not null"
        parts += [
            r(f"avg(abs(value - predicted)) filter ({keep})", f"{s}_mae"),
            r(f"sqrt(avg((value - predicted) ** 2) filter ({keep}))", f"{s}_rmse"),
            r(f"1 - sum((value - predicted) ** 2) filter ({keep}) / (var_pop(value) filter ({keep}) * count(*) filter ({keep}))", f"{s}_r2"),
        ]
    return f"select series_id, {columns}, {', '.join(parts)} from {source} group by series_id"


@query("m18_difference_ar1", check(
    _split_metrics_sql("pr", f"{r('any_value(phi)', 'phi')}, {r('any_value(c)', 'const')}"), "sm", **_ar1_steps("sm")))
def difference_ar1(spark, d):
    return settle(A.ar1_report(P.supplier_monthly(spark, d)))


@query("m18_difference_ar1_predictions", check(
    f"select series_id, year, month, value, split, {r('phi', 'phi')}, {r('c', 'const')}, {r('predicted', 'predicted')} from pr",
    "qm", **_ar1_steps("qm")))
def difference_ar1_predictions(spark, d):
    return settle(A.ar1_predictions(P.quantity_monthly(spark, d)))


def _arma_steps() -> dict[str, str]:
    """Both least-squares stages of ARIMA(1,1,1), the first by taking one lag after the other out of the rest."""
    per, ds = "over (partition by series_id)", [f"d{k}" for k in range(1, arma.LONG + 1)]
    lags = ", ".join(f"lag(d0, {k}) over w as d{k}" for k in range(1, arma.LONG + 1))
    steps = {
        "hp": """select *, row_number() over w as pos, count(*) over (partition by series_id) as n,
            value - lag(value, 1) over w as d0, lag(value, 1) over w as prev from sm
            window w as (partition by series_id order by year, month)""",
        "hs": f"""select *, case when pos <= n - cast(ceil(0.2 * n) as bigint) then 'train' else 'test' end as split, {lags}
            from hp window w as (partition by series_id order by pos)""",
        "h0": f"""select series_id, pos, {', '.join(f'{c} - avg({c}) {per} as {c}' for c in ['d0', *ds])}
            from hs where split = 'train' and {ds[-1]} is not null""",
    }
    for k in range(1, arma.LONG + 1):
        rest = ", ".join(f"{c} - d{k} * sum({c} * d{k}) {per} / sum(d{k} * d{k}) {per} as {c}" for c in ["d0", *ds[k:]])
        steps[f"h{k}"] = f"select series_id, pos, {rest} from h{k - 1}"
    return steps | {
        "hl": f"""select h.series_id, h.pos, hs.d0 as y, hs.d1 as x1, lag(h.d0) over (partition by h.series_id order by h.pos) as x2
            from h{arma.LONG} h join hs on hs.series_id = h.series_id and hs.pos = h.pos""",
        "hm": """select series_id, count(*) as n, avg(y) as my, avg(x1) as m1, avg(x2) as m2, var_pop(x1) as s11, var_pop(x2) as s22,
            covar_pop(x1, x2) as s12, covar_pop(x1, y) as s1y, covar_pop(x2, y) as s2y from hl where x2 is not null group by 1""",
        "hk": f"""select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as phi, greatest(-{arma.THETA_MOST}, least({arma.THETA_MOST},
            (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12))) as theta from hm""",
        "hf": "select *, my - phi * m1 - theta * m2 as c from hk",
        "rec": """select series_id, 2 as pos, cast(0 as double) as e from hf union all
            select rec.series_id, rec.pos + 1, d0 - c - phi * d1 - theta * e from rec
            join hs on hs.series_id = rec.series_id and hs.pos = rec.pos + 1 join hf on hf.series_id = rec.series_id where split = 'train'""",
        "hx": """select hf.series_id, max(rec.pos) as nt, arg_max(e, rec.pos) as le, arg_max(value, rec.pos) as lv, arg_max(d0, rec.pos) as ld
            from hf join rec on rec.series_id = hf.series_id join hs on hs.series_id = hf.series_id and hs.pos = rec.pos group by 1""",
        "pr": """select hs.series_id, year, month, value, split, hf.n as mn, phi, theta, c, case when split = 'train' then case when hs.pos > 2 then value - e end
            else lv + (hs.pos - nt) * (c / (1 - phi)) + (c + phi * ld + theta * le - c / (1 - phi)) * (1 - phi ** (hs.pos - nt)) / (1 - phi) end
            as predicted from hs join hf on hf.series_id = hs.series_id join hx on hx.series_id = hs.series_id
            left join rec on rec.series_id = hs.series_id and rec.pos = hs.pos""",
    }


@query("m18_arima_fit", check(
    f"select series_id, n, {r('phi', 'phi')}, {r('theta', 'theta')}, {r('c', 'const')} from hf", "sm", **_arma_steps()
).replace("with ", "with recursive ", 1))
def arima_fit(spark, d):
    return settle(arma.arma_fit(arma.arma_rows(P.supplier_monthly(spark, d))))


@query("m18_arima_report", check(
    _split_metrics_sql("pr", f"any_value(mn) as n, {r('any_value(phi)', 'phi')}, {r('any_value(theta)', 'theta')}, {r('any_value(c)', 'const')}"),
    "sm", **_arma_steps()).replace("with ", "with recursive ", 1))
def arima_report(spark, d):
    return settle(arma.arma_report(P.supplier_monthly(spark, d)))


_SEASONAL = {
    "lg": """select *, row_number() over w as pos, count(*) over (partition by series_id) as n,
        value - lag(value, 1) over w as d1, value - lag(value, 12) over w as d12 from sm
        window w as (partition by series_id order by year, month)""",
    "zz": """select *, case when pos <= n - cast(ceil(0.2 * n) as bigint) then 'train' else 'test' end as split,
        d1 - lag(d1, 12) over (partition by series_id order by pos) as z from lg""",
    "zl": """select *, lag(z, 1) over w as z1, lag(z, 12) over w as z12 from zz
        window w as (partition by series_id order by pos)""",
    "mo": """select series_id, count(*) as n, avg(z) as my, avg(z1) as m1, avg(z12) as m2, var_pop(z) as syy,
        var_pop(z1) as s11, var_pop(z12) as s22, covar_pop(z1, z12) as s12, covar_pop(z1, z) as s1y,
        covar_pop(z12, z) as s2y from zl where split = 'train' and z12 is not null group by 1""",
    "co": """select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1,
        (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2 from mo""",
}


@query("m19_seasonal_difference", check(
    f"""select series_id, year, month, {r("z", "z")}, {r("z1", "z_1")}, {r("z12", "z_12")} from zl""", "sm", **_SEASONAL))
def seasonal_difference(spark, d):
    rows = A.seasonal_rows(P.supplier_monthly(spark, d))
    return settle(rows.select("series_id", "year", "month", "z", "z_1", "z_12"))


@query("m19_seasonal_fit", check(
    f"""select series_id, n, {r("b1", "b1")}, {r("b2", "b2")}, {r("my - b1 * m1 - b2 * m2", "const")},
    {r("n * (syy - b1 * s1y - b2 * s2y)", "sse", 2)}, {r("n * ln(syy - b1 * s1y - b2 * s2y) + 6", "aic")} from co""",
    "sm", **_SEASONAL))
def seasonal_fit(spark, d):
    return settle(A.seasonal_fit(A.seasonal_rows(P.supplier_monthly(spark, d))), sse=2)


# The forecasts of a model feed the next step: 26 values back from it, the newest last.
_SEASONAL_PATH = {
    **_SEASONAL,
    "mc": "select *, my - b1 * m1 - b2 * m2 as c from co",
    "tl": """select series_id, max(pos) as nt, any_value(n) as na, list(value order by pos)[-26:] as tail from zz
        where split = 'train' group by 1""",
    "rec": """select mc.series_id, 0 as step, tail, cast(null as double) as predicted, nt, na from mc
        join tl on tl.series_id = mc.series_id
        union all select series_id, step + 1, list_append(tail[2:], nx), nx, nt, na from (
        select rec.series_id, step, tail, nt, na, tail[26] + tail[15] - tail[14] + c
            + b1 * (tail[26] - tail[25] - tail[14] + tail[13]) + b2 * (tail[15] - tail[14] - tail[3] + tail[2]) as nx
        from rec join mc on mc.series_id = rec.series_id where step < greatest(24, na - nt))""",
}


@query("m19_seasonal_report", check(
    _split_metrics_sql("both_", ", ".join([
        "any_value(mn) as n", r("any_value(b1)", "b1"), r("any_value(b2)", "b2"), r("any_value(c)", "const"),
        r("any_value(sse)", "sse", 2), r("any_value(aic)", "aic")])), "sm", **_SEASONAL_PATH,
    both_="""select zl.series_id, zl.split, zl.value, mc.n as mn, b1, b2, c, mc.n * (syy - b1 * s1y - b2 * s2y) as sse,
        mc.n * ln(syy - b1 * s1y - b2 * s2y) + 6 as aic, case when split = 'train'
        then lag(value, 1) over w + lag(value, 12) over w - lag(value, 13) over w + c + b1 * z1 + b2 * z12
        else rec.predicted end as predicted from zl join mc on mc.series_id = zl.series_id
        join tl on tl.series_id = zl.series_id left join rec on rec.series_id = zl.series_id and rec.step = zl.pos - tl.nt
        and rec.step > 0 window w as (partition by zl.series_id order by zl.pos)""").replace("with ", "with recursive ", 1))
def seasonal_report(spark, d):
    return settle(A.seasonal_report(P.supplier_monthly(spark, d)), sse=2)


@query("m19_seasonal_forecast", check(
    f"""select series_id, nt as n_train, step, {r("predicted", "predicted")} from rec where step between 1 and 24""",
    "sm", **_SEASONAL_PATH).replace("with ", "with recursive ", 1))
def seasonal_forecast(spark, d):
    return settle(A.seasonal_forecast(P.supplier_monthly(spark, d), F.lit(24)))


# Any parameters will do to compare the recursion; these are phi, PHI, theta, THETA.
_GIVEN = [0.3, 0.2, -0.6, -0.5]
_Z = "value - lag(value, 1) over w - lag(value, 12) over w + lag(value, 13) over w"


@query("m19_sarima_innovations", check(
    f"""select series_id, pos as position, {r("h[1]", "innovation")} from rec where pos > {sarima.SKIP + 13}""", "sm",
    sz=f"""select *, row_number() over w as pos, count(*) over (partition by series_id) as n, {_Z} as z from sm
        window w as (partition by series_id order by year, month)""",
    sl="""select *, lag(z, 1) over w as z1, lag(z, 12) over w as z12, lag(z, 13) over w as z13 from sz
        window w as (partition by series_id order by pos)""",
    # The newest innovation first; thirteen are looked back at.
    rec=f"""select series_id, {sarima.SKIP + 13} as pos, list_transform(range(13), lambda i: 0::double) as h from (select distinct series_id from sl)
        union all select rec.series_id, rec.pos + 1, list_prepend(z - {_GIVEN[0]} * z1 - {_GIVEN[1]} * z12 + {_GIVEN[0] * _GIVEN[1]} * z13
            - {_GIVEN[2]} * h[1] - {_GIVEN[3]} * h[12] - {_GIVEN[2] * _GIVEN[3]} * h[13], h[1:12])
        from rec join sl on sl.series_id = rec.series_id and sl.pos = rec.pos + 1 where sl.pos <= n - cast(ceil(0.2 * n) as bigint)"""
).replace("with ", "with recursive ", 1))
def sarima_innovations(spark, d):
    """Innovations of SARIMA(1,1,1)(1,1,1,12) under given parameters: what the fit makes small."""
    return settle(sarima.sarima_innovations(P.supplier_monthly(spark, d), _GIVEN))


@query("m19_sarima_report")
def sarima_report(spark, d):
    report = sarima.sarima_report(P.supplier_monthly(spark, d))
    first = ["phi", "seasonal_phi", "theta", "seasonal_theta"]
    return settle(report.withColumns({c: F.get(c, F.lit(0)) for c in first}), sse=2)


@query("m20_sarima_orders")
def sarima_orders(spark, d):
    """The orders of each series' best seasonal model, by a stepwise search."""
    return settle(sarima.best_orders(sarima.order_search(P.supplier_monthly(spark, d))))


def _order_steps(d: int, x: str) -> dict[str, str]:
    """AIC of AR(0..5) by taking one lag after the other out of the rest: the residual of the
    value after p lags is that of AR(p)."""
    value = "value" if d == 0 else "value - lag(value, 1) over w"
    w = "window w as (partition by series_id order by year, month)"
    lags = ", ".join(f"lag(v, {k}) over w as l{k}" for k in range(1, 6))
    steps = {
        f"{x}v": f"select series_id, year, month, {value} as v from sm {w}",
        f"{x}l": f"select series_id, v as l0, {lags} from (select * from {x}v where v is not null) {w}",
        f"{x}g0": f"""select series_id, {', '.join(f'l{k} - avg(l{k}) over (partition by series_id) as l{k}' for k in range(6))}
            from {x}l where l5 is not null""",
    }
    for p in range(1, 6):
        rest = [0, *range(p + 1, 6)]
        cols = ", ".join(
            f"l{k} - l{p} * sum(l{k} * l{p}) over (partition by series_id) / sum(l{p} * l{p}) over (partition by series_id) as l{k}"
            for k in rest
        )
        steps[f"{x}g{p}"] = f"select series_id, {cols} from {x}g{p - 1}"
    steps[f"{x}aic"] = " union all ".join(
        f"""select series_id, cast({p} as int) as p, count(*) as n,
        count(*) * ln(sum(l0 * l0) / count(*)) + {2 * (p + 1)} as aic from {x}g{p} group by 1""" for p in range(6)
    )
    return steps


@query("m20_order_search", check(
    f"select series_id, p, n, {r('aic', 'aic')} from xaic", "sm", **_order_steps(0, "x")))
def order_search(spark, d):
    return settle(A.ar_order_search(P.supplier_monthly(spark, d)))


_DF = {
    "st": """select series_id, lag(value, 1) over w as x, value - lag(value, 1) over w as y from sm
        window w as (partition by series_id order by year, month)""",
    "rg": """select series_id, cast(count(*) as double) as n, regr_slope(y, x) as b, regr_sxx(y, x) as sxx,
        regr_sxy(y, x) as sxy, regr_syy(y, x) as syy from st where x is not null and y is not null group by 1""",
    "df": """select series_id, n, b / sqrt((syy - b * sxy) / (n - 2) / sxx) as statistic,
        -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n) as critical_5pct from rg""",
}


@query("m20_best_order", check(
    f"""select series_id, p, d, {r("aic", "aic")} from (
    select *, row_number() over (partition by series_id, d order by aic, p) as k from (
    select *, cast(0 as int) as d from xaic union all select *, 1 from yaic)) b
    join (select series_id as s, statistic <= critical_5pct as stationary from df) t on t.s = b.series_id
    where k = 1 and stationary = (d = 0)""", "sm", **_order_steps(0, "x"), **_order_steps(1, "y"), **_DF))
def best_order(spark, d):
    """Order by AIC, after one difference where the series is not stationary."""
    monthly = P.supplier_monthly(spark, d)
    tested = stationarity.dickey_fuller(monthly).select("series_id", "is_stationary")
    level = A.best_order(A.ar_order_search(monthly, d=0)).withColumn("d", F.lit(0))
    differenced = A.best_order(A.ar_order_search(monthly, d=1)).withColumn("d", F.lit(1))
    both = level.unionByName(differenced).join(tested, "series_id")
    return settle(both.filter(F.col("is_stationary") == (F.col("d") == 0)).select("series_id", "p", "d", "aic"))


@query("m21_dickey_fuller", check(
    f"""select series_id, cast(n as bigint) as n, {r("statistic", "statistic")}, {r("critical_5pct", "critical_5pct")},
    statistic <= critical_5pct as is_stationary from df""", "sm", **_DF))
def dickey_fuller(spark, d):
    return settle(stationarity.dickey_fuller(P.supplier_monthly(spark, d)))


def _out_of(columns: list[str], regressor: str, source: str) -> str:
    """Columns with one regressor taken out of each, per series."""
    per = "over (partition by series_id)"
    cols = ", ".join(f"{c} - {regressor} * sum({c} * {regressor}) {per} / sum({regressor} * {regressor}) {per} as {c}" for c in columns)
    return f"select series_id, {cols} from {source}"


def _augmented_steps(most: int) -> dict[str, str]:
    """The augmented test for panels where every series allows ``most`` lagged differences.

    The lags are chosen on the rows that have all of them; each possible choice is then
    fitted on all the rows it can use.
    """
    w = "window w as (partition by series_id order by year, month)"
    lags = ", ".join(f"lag(y, {k}) over w as d{k}" for k in range(1, most + 1))
    steps = {
        "dv": f"select series_id, year, month, value - lag(value) over w as y, lag(value) over w as x from sm {w}",
        "dl": f"select series_id, y, x, {lags} from (select * from dv where y is not null) {w}",
    }

    def centred(source: str, p: int) -> str:
        cols = ", ".join(f"{c} - avg({c}) over (partition by series_id) as {c}" for c in ["y", "x", *[f"d{k}" for k in range(1, p + 1)]])
        return f"select series_id, {cols} from {source} where d{p} is not null" if p else f"select series_id, {cols} from {source}"

    ds = [f"d{k}" for k in range(1, most + 1)]
    steps["c0"] = centred("dl", most)
    steps["c1"] = _out_of(["y", *ds], "x", "c0")
    for k in range(1, most + 1):
        steps[f"c{k + 1}"] = _out_of(["y", *ds[k:]], f"d{k}", f"c{k}")
    steps["ic"] = " union all ".join(
        f"select series_id, {k - 1} as lags, count(*) * ln(sum(y * y) / count(*)) + {2 * (k + 1)} as aic from c{k} group by 1"
        for k in range(1, most + 2)
    )
    steps["best"] = "select series_id, arg_min(lags, struct_pack(a := aic, l := lags)) as lags from ic group by 1"
    fits = []
    for p in range(most + 1):
        steps[f"b{p}_0"] = centred("dl", p)
        for k in range(1, p + 1):
            steps[f"b{p}_{k}"] = _out_of(["y", "x", *ds[k:p]], f"d{k}", f"b{p}_{k - 1}")
        fits.append(
            f"""select series_id, {p} as lags, count(*) as n, sum(x * y) / sum(x * x) as b, sum(x * x) as sxx,
            sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) as sse from b{p}_{p} group by 1"""
        )
    steps["fits"] = " union all ".join(fits)
    return steps


# Statistic with a p-value of exactly 5%, from the p-value polynomial.
_C0, _C1, _C2 = stationarity.P_VALUE_SMALL
_AT_5PCT = (-_C1 + math.sqrt(_C1 * _C1 - 4 * _C2 * (_C0 - NormalDist().inv_cdf(0.05)))) / (2 * _C2)


@query("m21_augmented_dickey_fuller", check(
    f"""select series_id, {r("t", "statistic")}, cast(lags as int) as used_lags, cast(n as int) as n,
    {r("-2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n)", "critical_5pct")}, t <= {_AT_5PCT} as is_stationary from (
    select f.series_id, f.lags, n, b / sqrt(sse / (n - f.lags - 2) / sxx) as t from fits f
    join best on best.series_id = f.series_id and best.lags = f.lags)""", "sm", **_augmented_steps(12)))
def augmented_dickey_fuller(spark, d):
    return settle(stationarity.augmented_dickey_fuller(P.supplier_monthly(spark, d)).drop("p_value"))


@query("m21_long_dickey_fuller")
def long_dickey_fuller(spark, d):
    """The augmented test of daily series."""
    return settle(stationarity.long_dickey_fuller(P.combined_daily(spark, d), windows.DAILY_ORDER))


@query("m22_validation_report", check(
    f"""select qu.series_id, {r("n_rows * 100.0 / months", "completeness")}, missing, outliers, {r("t", "statistic")},
    cast(ad.lags as int) as used_lags, t <= {_AT_5PCT} as is_stationary, {r("ratio", "ratio")}, coalesce(ratio > 1.5, false) as is_seasonal,
    case when t <= {_AT_5PCT} then 'ARIMA(p,0,q)' when t is not null then 'difference first (d=1 or d=2)' end
    || case when ratio > 1.5 then '; SARIMA with s=12' else '' end as recommendation,
    case when n_rows = missing then 'no values' when t is null then 'too short, constant or exactly predictable' end as reason
    from qu left join ad on ad.series_id = qu.series_id left join ra on ra.series_id = qu.series_id
    left join ou on ou.series_id = qu.series_id""", "sm", **_augmented_steps(12),
    ad="""select f.series_id, f.lags, b / sqrt(sse / (n - f.lags - 2) / sxx) as t from fits f
        join best on best.series_id = f.series_id and best.lags = f.lags""",
    qu="""select series_id, count(*) as n_rows, count(*) - count(value) as missing, (max(year) - min(year) + 1) * 12 as months,
        quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from sm group by 1""",
    ou="""select sm.series_id, count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as outliers
        from sm join qu on qu.series_id = sm.series_id group by 1""",
    ra="""select series_id, max(m) / min(m) as ratio from (select series_id, month, avg(value) as m from sm group by 1, 2)
        group by 1"""))
def validation_report(spark, d):
    out = stationarity.validation_report(P.supplier_monthly(spark, d)).drop("p_value")
    return settle(out.withColumn("completeness", F.col("completeness").cast("double")))


@query("m25_residuals", check(
    f"""select *, {r("actual - predicted", "residual")}, {r("abs(actual - predicted)", "absolute_error")} from (
    select series_id, year, month, actual, model_key, {r("predicted", "predicted")} from bt where predicted is not null)""",
    "qm", **backtest_steps("qm")))
def residuals(spark, d):
    predictions = settle(forecasts.backtest_baselines(P.quantity_monthly(spark, d)))
    return settle(metrics.residuals(predictions))


@query("m25_residual_histogram", check(
    f"""select b.series_id, b.bin, coalesce(c.n, 0) as n from (
    select *, cast(unnest(range(30)) as int) as bin from lim) b left join (
    select v.series_id, cast(least(29, floor((e - lo) / ((hi - lo) / 30))) as int) as bin, count(*) as n
    from rs v join lim on v.series_id = lim.series_id group by 1, 2) c on b.series_id = c.series_id and b.bin = c.bin""",
    "qm", **backtest_steps("qm"),
    rs="select series_id, actual - predicted as e from bt where predicted is not null and model_key = 'lag_12'",
    lim="select series_id, min(e) as lo, max(e) as hi from rs group by 1"))
def residual_histogram(spark, d):
    """Of the seasonal-naive model, whose residuals are exact."""
    predictions = forecasts.backtest_baselines(P.quantity_monthly(spark, d)).filter(F.col("model_key") == "lag_12")
    bars = distribution.histogram(metrics.residuals(predictions), 30, "residual")
    return bars.select("series_id", "bin", "n")


# --- Trained models ---------------------------------------------------------------------


def daily_frame(spark, d, variant="basic"):
    return X.daily_features(P.combined_daily(spark, d).drop("year", "month", "day"), X.DAILY_SPECS[variant])


def _report(spark, d, estimator, variant="basic"):
    frame = daily_frame(spark, d, variant)
    _, report = training.train_and_evaluate(
        frame, X.feature_columns(frame), estimator, C.BASE_YEAR, windows.DAILY_ORDER
    )
    return settle(report)


@query("m3_gradient_boosting")
def gradient_boosting(spark, d):
    return _report(spark, d, training.gradient_boosting(trees=10, rate=0.1, depth=4))


# The best split of the panel's months by squared error, and the mean on either side of it.
_SINGLE_SPLIT = check(
    f"""select distinct m.month, {r("case when m.month <= b.t then b.low else b.high end", "predicted")}
    from (select distinct month from sm) m, best b""",
    "sm",
    cuts="""select t, sum(value) filter (month <= t) as sl, count(*) filter (month <= t) as nl,
        sum(value) filter (month > t) as sr, count(*) filter (month > t) as nr
        from (select month, value from sm where value is not null), (select unnest(range(1, 12)) as t) group by t""",
    best="""select arg_max(t, sl * sl / nl + sr * sr / nr) as t, arg_max(sl / nl, sl * sl / nl + sr * sr / nr) as low,
        arg_max(sr / nr, sl * sl / nl + sr * sr / nr) as high from cuts""",
)


def _single_split(spark, d, estimator):
    """What a tree of depth one, fitted on the month alone, predicts for each month."""
    panel = P.supplier_monthly(spark, d).filter(F.col("value").isNotNull())
    rows = training.training_rows(panel)
    model = training.fit(rows, ["month"], estimator)
    rows.unpersist()
    return settle(training.predict(model, panel.select("month").distinct()))


@query("m3_single_split", _SINGLE_SPLIT)
def boosted_single_split(spark, d):
    """Boosting with one tree of one split."""
    return _single_split(spark, d, training.gradient_boosting(trees=1, depth=1, leaf=1, subsample=1.0))


@query("m4_single_split", _SINGLE_SPLIT)
def forest_single_split(spark, d):
    """A forest of one tree of one split, which sees every row."""
    return _single_split(spark, d, training.random_forest(trees=1, depth=1, leaf=1, features="all", bootstrap=False))


# Columns that determine a unique least-squares solution, which a check can reproduce.
LINEAR_FEATURES = ["value_lag_1", "value_lag_7", "temperature", "humidity", "doy_sin", "doy_cos"]


def least_squares_steps(features: list[str], fitted_on: str, x: str = "") -> dict[str, str]:
    """Residuals of every row of ``ls`` for a least-squares fit on the rows that satisfy a condition.

    One column after the other is taken out of the rest, with sums over the fitted rows;
    what is left of the value is its residual.
    """
    k = len(features)
    names = ["value", *features]
    centred = ", ".join(f"{c} - avg({c}) filter ({fitted_on}) over () as l{i}" for i, c in enumerate(names))
    steps = {f"{x}q0": f"select series_id, date, value, split, fold, {centred} from ls"}
    for p in range(1, k + 1):
        cols = ", ".join(
            f"l{i} - l{p} * sum(l{i} * l{p}) filter ({fitted_on}) over () / sum(l{p} * l{p}) filter ({fitted_on}) over () as l{i}"
            for i in [0, *range(p + 1, k + 1)]
        )
        steps[f"{x}q{p}"] = f"select series_id, date, value, split, fold, {cols} from {x}q{p - 1}"
    steps[f"{x}res"] = f"select series_id, date, value, split, fold, l0 as e, value - l0 as predicted from {x}q{k}"
    return steps


_LINEAR_FRAME = {
    "fr": daily_body(X.DAILY_SPECS["sequence"], lambda e, n: f"{e} as {n}"),
    "sq": """select *, row_number() over w as pos, count(*) over (partition by series_id) as total from fr
        window w as (partition by series_id order by date)""",
    "sp": "select *, case when pos <= total - cast(ceil(0.2 * total) as bigint) then 'train' else 'test' end as split from sq",
    "ls": """select *, case when split = 'train' then ntile(5) over (partition by series_id, split order by date) - 1 end as fold
        from sp""",
}
_BY_SPLIT = f"""select split, count(*) as n, {r("avg(abs(e))", "mae")}, {r("sqrt(avg(e * e))", "rmse")},
    {r("1 - sum(e * e) / (var_pop(value) * count(*))", "r2")} from res group by 1"""
_LINEAR = {**_LINEAR_FRAME, **least_squares_steps(LINEAR_FEATURES, "split = 'train'")}


@query("m3_linear_baseline", check(_BY_SPLIT, "dd", **_LINEAR))
def linear_baseline(spark, d):
    _, report = training.train_and_evaluate(
        daily_frame(spark, d, "sequence"), LINEAR_FEATURES, training.linear(), C.BASE_YEAR, windows.DAILY_ORDER
    )
    return settle(report)


@query("m4_random_forest")
def random_forest(spark, d):
    return _report(spark, d, training.random_forest(trees=20, depth=6))


@query("m5_subsampled_boosting")
def subsampled_boosting(spark, d):
    return _report(spark, d, training.subsampled_boosting(trees=10, depth=4), "simple")


@query("m5_second_order_boosting")
def second_order_boosting(spark, d):
    """Errors by split of second-order boosting with penalties, rows and columns drawn per tree."""
    rows, features = _split_frame(spark, d, "simple")
    fold = F.when(F.col("split") == "train", 0).otherwise(second_order.HELD_OUT)
    data = second_order.bin_rows(rows, features, fold, ["series_id", "date"])
    spec = second_order.Boosted(trees=10, rate=0.1, depth=5, subsample=0.8, columns=0.8, gamma=0.2, alpha=0.1, penalty=1.0)
    _, errors = second_order.fit_together(data, [spec])
    named = F.when(F.col("fold") == 0, "train").otherwise("test")
    return settle(errors.select(named.alias("split"), "n", "mae", "rmse", "r2"))


# Penalties of the tree that is checked: gamma, alpha, lambda.
_GAMMA, _ALPHA, _LAMBDA, _RATE = 0.2, 40.0, 500.0, 0.3


def _shrunk_sql(g: str) -> str:
    return f"sign({g}) * greatest(abs({g}) - {_ALPHA}, 0)"


@query("m5_second_order_split", check(
    f"""select distinct m.month, {r(f"mu - {_RATE} * case when m.month <= b.t then wl else wr end", "predicted")}
    from (select distinct month from sm) m, best b, base""",
    "sm",
    base="select avg(value) as mu from sm where value is not null",
    grad="select month, mu - value as g from sm, base where value is not null",
    cuts="""select t, sum(g) filter (month <= t) as gl, count(*) filter (month <= t) as nl,
        sum(g) filter (month > t) as gr, count(*) filter (month > t) as nr from grad, (select unnest(range(1, 12)) as t) group by t""",
    gains=f"""select *, (({_shrunk_sql("gl")}) ** 2 / (nl + {_LAMBDA}) + ({_shrunk_sql("gr")}) ** 2 / (nr + {_LAMBDA})
        - ({_shrunk_sql("gl + gr")}) ** 2 / (nl + nr + {_LAMBDA})) / 2 - {_GAMMA} as gain from cuts""",
    best=f"""select t, ({_shrunk_sql("gl")}) / (nl + {_LAMBDA}) as wl, ({_shrunk_sql("gr")}) / (nr + {_LAMBDA}) as wr
        from gains order by gain desc, t limit 1"""))
def second_order_split(spark, d):
    """What one penalised cut on the month alone predicts for each month."""
    panel = P.supplier_monthly(spark, d)
    data = second_order.bin_rows(panel, ["month"], F.lit(0), ["series_id", "year", "month"])
    spec = second_order.Boosted(trees=1, rate=_RATE, depth=1, subsample=1.0, columns=1.0, gamma=_GAMMA, alpha=_ALPHA, penalty=_LAMBDA)
    (model,), _ = second_order.fit_together(data, [spec])
    return settle(second_order.predict(model, panel.select("month").distinct()))


@query("m6_average_of_predictions", check(
    f"""select series_id, year, month, {r("actual", "actual")}, {r("(base + greatest(0.0, case when nr >= 5 and ny >= 2 "
      "then base + slope * (year - my) else base * (1 + 0.004 * (year - 2020)) end) + lag12) / 3", "predicted")} from te""",
    "qm", **backtest_steps("qm")))
def average_of_predictions(spark, d):
    """Unweighted mean of three simple models, side by side after a pivot."""
    names = ["climatology", "climatology_trend", "lag_12"]
    wide = (
        forecasts.backtest_baselines(P.quantity_monthly(spark, d))
        .groupBy("series_id", "year", "month", "actual")
        .pivot("model_key", names)
        .agg(F.max("predicted"))
    )
    return settle(training.average_predictions(wide, names).drop(*names))


def _small_estimators():
    return {
        "boosted": training.gradient_boosting(trees=5, rate=0.1, depth=3),
        "forest": training.random_forest(trees=8, depth=4),
        "subsampled": training.subsampled_boosting(trees=5, depth=3),
    }


def _split_frame(spark, d, variant):
    frame = daily_frame(spark, d, variant)
    return split.chronological_split(frame, windows.DAILY_ORDER), X.feature_columns(frame)


@query("m6_voting_ensemble")
def voting_ensemble(spark, d):
    rows, features = _split_frame(spark, d, "ensemble")
    rows = training.training_rows(rows)
    voting = training.fit_voting(rows.filter(F.col("split") == "train"), features, _small_estimators())
    return settle(metrics.regression_metrics(voting.predict(rows), ["split"], "value"))


@query("m7_stacking_ensemble")
def stacking_ensemble(spark, d):
    rows, features = _split_frame(spark, d, "sequence")
    rows = training.training_rows(rows)
    train = rows.filter(F.col("split") == "train")
    stacked = training.fit_stacking(train, features, _small_estimators(), windows.DAILY_ORDER, folds=5)
    return settle(metrics.regression_metrics(stacked.predict(rows), ["split"], "value"))


@query("m7_ridge_stage", check(
    f"""select 'climatology' as feature, {r("w1", "weight")} from w union all select 'lag_12', {r("w2", "w")} from w
    union all select 'intercept', {r("my - w1 * m1 - w2 * m2", "w")} from w""",
    "qm", **backtest_steps("qm"),
    su="""select avg(actual) as my, avg(base) as m1, avg(lag12) as m2, count(*) * var_pop(base) + 0.1 as a, count(*) * var_pop(lag12) + 0.1 as d,
        count(*) * covar_pop(base, lag12) as b, count(*) * covar_pop(base, actual) as p, count(*) * covar_pop(lag12, actual) as q
        from te where base is not null and lag12 is not null and actual is not null""",
    w="select *, (p * d - q * b) / (a * d - b * b) as w1, (q * a - p * b) / (a * d - b * b) as w2 from su"))
def ridge_stage(spark, d):
    """The stacking ensemble's last stage, a ridge regression of alpha 0.1, over predictions of rows that their models did not see."""
    names = ["climatology", "lag_12"]
    held_out = (
        forecasts.backtest_baselines(P.quantity_monthly(spark, d))
        .groupBy("series_id", "year", "month", "actual").pivot("model_key", names).agg(F.max("predicted")).dropna()
    )
    held_out = training.training_rows(held_out)
    model = training.fit(held_out, names, training.ridge(held_out, 0.1, "actual").setLabelCol("actual"), scaled=False).stages[-1]
    held_out.unpersist()
    weights = [*zip(names, map(float, model.coefficients)), ("intercept", float(model.intercept))]
    return settle(spark.createDataFrame(weights, "feature string, weight double"))


_F_FEATURES = ["value_lag_1", "value_lag_7", "value_lag_30", "value_ma_7", "temperature", "humidity"]


@query("m8_f_scores", check(
    " union all ".join(
        f"select '{c}' as feature, {r(f'corr({c}, value) ** 2 / (1 - corr({c}, value) ** 2) * (count(*) - 2)', 'f_score')} from fr"
        for c in _F_FEATURES), "dd",
    fr="""select * from (select value, temperature, humidity, lag(value, 1) over w as value_lag_1, lag(value, 7) over w as value_lag_7,
        lag(value, 30) over w as value_lag_30, avg(value) over (partition by series_id order by date
        rows between 7 preceding and 1 preceding) as value_ma_7 from dd window w as (partition by series_id order by date))
        where value_lag_30 is not null"""))
def f_scores(spark, d):
    spec = X.DailySpec(lags=[1, 7, 30], windows=[7])
    frame = X.daily_features(P.combined_daily(spark, d).drop("year", "month", "day"), spec)
    return settle(scaling.univariate_f_scores(frame, _F_FEATURES))


_WIDEST = X.DAILY_SPECS["advanced"]
_WIDEST_FEATURES = [
    *["temperature", "humidity", "wind_speed", "cloud_cover", "surface_pressure", "year", "month", "day", "day_of_year"],
    *["doy_sin", "doy_cos", "month_sin", "month_cos", "trend", "value_momentum"],
    *[f"value_lag_{k}" for k in _WIDEST.lags], *[f"value_change_{k}" for k in _WIDEST.changes],
    *[f"value_{s}_{n}" for s in _WIDEST.stats for n in _WIDEST.windows],
    *[f"{c}_lag_{k}" for c in P.COVARIATES for k in _WIDEST.covariate_lags],
    *[f"{c}_{s}_{n}" for c in P.COVARIATES for s in _WIDEST.covariate_stats for n in _WIDEST.covariate_windows],
    *[f"{i}{t}" for i in _WIDEST.interactions for t in ("", "_lag_1")], *_WIDEST.unlagged,
]


@query("m8_feature_selection", check(
    f"""select feature, {r("f_score", "f_score")} from (select feature, c * c / (1 - c * c) * (n - 2) as f_score from (
    select count(*) as n, unnest([{', '.join(f"{{'f': '{c}', 'c': corr({c}, value)}}" for c in _WIDEST_FEATURES)}], recursive := true)
    from tr) t(n, feature, c)) order by f_score desc limit 50""", "dd",
    fr=daily_body(_WIDEST, lambda e, n: f"{e} as {n}"),
    tr="""select * from (select *, row_number() over (partition by series_id order by date) as pos,
        count(*) over (partition by series_id) as total from fr) where pos <= total - cast(ceil(0.2 * total) as bigint)"""))
def feature_selection(spark, d):
    """The 50 best columns of the widest variant, with their scores on the train rows."""
    rows, features = _split_frame(spark, d, "advanced")
    train = training.training_rows(rows.filter(F.col("split") == "train"))
    chosen = training.select_features(train, features, 50)
    scores = scaling.univariate_f_scores(train, features)
    return settle(scores.filter(F.col("feature").isin(chosen)))


@query("m11_hold_out_grid")
def hold_out_grid(spark, d):
    """All combinations of the search's axes, at a hundredth of its trees: 320 fits grow together, four stages each."""
    rows, features = _split_frame(spark, d, "sequence")
    grid = tuning.HOLD_OUT_GRID | {"trees": [n // 100 for n in tuning.HOLD_OUT_GRID["trees"]]}
    found = tuning.staged_hold_out_search(rows, features, grid, ["series_id", "date"])
    return settle(found.withColumn("params", F.to_json("params")))


@query("m12_cross_validated_grid")
def cross_validated_grid(spark, d):
    """All combinations of the six axes over three folds, at a hundredth of the search's trees."""
    rows, features = _split_frame(spark, d, "tuned")
    train = rows.filter(F.col("split") == "train")
    grid = tuning.CROSS_VALIDATED_GRID | {"trees": [n // 100 for n in tuning.CROSS_VALIDATED_GRID["trees"]]}
    found = tuning.staged_cross_validated_search(train, features, grid, windows.DAILY_ORDER)
    return settle(found.withColumn("params", F.to_json("params")))


_FOLD_STEPS: dict[str, str] = {}
for _k in range(5):
    _FOLD_STEPS |= least_squares_steps(LINEAR_FEATURES, f"split = 'train' and fold <> {_k}", f"f{_k}")


@query("m13_cross_validated_score", check(
    f"""select fold, {r("r2", "r2")}, cast(null as double) as margin from folds
    union all select null, {r("avg(r2)", "r2")}, {r("2 * stddev_pop(r2)", "margin")} from folds""", "dd",
    **_LINEAR_FRAME, **_FOLD_STEPS,
    folds=" union all ".join(
        f"""select cast({k} as int) as fold, 1 - sum(e * e) / (var_pop(value) * count(*)) as r2 from f{k}res
        where split = 'train' and fold = {k}""" for k in range(5))))
def cross_validated_score(spark, d):
    rows = split.chronological_split(daily_frame(spark, d, "sequence"), windows.DAILY_ORDER)
    train = rows.filter(F.col("split") == "train")
    return settle(
        tuning.cross_validated_score(train, LINEAR_FEATURES, training.linear(), windows.DAILY_ORDER, folds=5)
    )


def _metrics_row_sql(key: str, source: str) -> str:
    r2 = "1 - sum(e * e) / (var_pop(value) * count(*))"
    return f"""select '{key}' as model_key, round(avg(abs(e)), 2) as mae, round(sqrt(avg(e * e)), 2) as rmse,
        round({r2}, 4) as r2_score, round(least(100, greatest(0, ({r2}) * 100)), 1) as accuracy_percent
        from {source} where split = 'test'"""


@query("m14_train_and_register", check(
    f"{_metrics_row_sql('daily_linear', 'res')} union all {_metrics_row_sql('daily_linear_short', 'zres')}", "dd",
    **_LINEAR, **least_squares_steps(LINEAR_FEATURES[:2], "split = 'train'", "z")))
def train_and_register(spark, d):
    """Two models trained, saved and entered into the metrics table one after the other."""
    frame = training.training_rows(daily_frame(spark, d, "sequence"))
    previous = None
    for key, features in (("daily_linear", LINEAR_FEATURES), ("daily_linear_short", LINEAR_FEATURES[:2])):
        trained, _ = training.train_and_evaluate(frame, features, training.linear(), C.BASE_YEAR, windows.DAILY_ORDER)
        target = shared_dir(spark, "metrics")
        registered = training.register(spark, trained, key, shared_dir(spark, "bundle"), target, previous)
        previous = target
    frame.unpersist()
    return registered


def _bundle(spark, d):
    frame = daily_frame(spark, d, "sequence")
    trained, _ = training.train_and_evaluate(
        frame, LINEAR_FEATURES, training.linear(), C.BASE_YEAR, windows.DAILY_ORDER
    )
    path = shared_dir(spark, "bundle")
    training.save_bundle(trained, path, spark)
    return frame, training.load_bundle(path, spark)


@query("s8_bundle_round_trip", check(f"select series_id, date, {r('predicted', 'predicted')} from res", "dd", **_LINEAR))
def bundle_round_trip(spark, d):
    """Predictions of a model that was saved and loaded."""
    frame, loaded = _bundle(spark, d)
    return settle(training.predict(loaded.model, frame).select("series_id", "date", "predicted"))


@query("m15_evaluate_stored", check(_BY_SPLIT, "dd", **_LINEAR))
def evaluate_stored(spark, d):
    frame, loaded = _bundle(spark, d)
    rows = split.chronological_split(frame, windows.DAILY_ORDER)
    return settle(training.evaluate(loaded.model, rows))


@query("t3_single_split", check(
    f"""select f as feature, cast(f = (select arg_max(f, gain) from gains) as int) * 1.0::double as importance
    from (select unnest(['month', 'year']) as f)""",
    "sm",
    cuts="select 'month' as f, month as x, value from sm where value is not null union all select 'year', year, value from sm where value is not null",
    gains="""select f, max(sl * sl / nl + (s - sl) * (s - sl) / (n - nl)) as gain from (
        select f, x, sum(sum(value)) over w as sl, sum(count(*)) over w as nl, sum(sum(value)) over (partition by f) as s,
        sum(count(*)) over (partition by f) as n from cuts group by f, x window w as (partition by f order by x))
        where nl < n group by f"""))
def single_split_importance(spark, d):
    """A tree of one split gives all importance to the feature that it cuts."""
    rows = training.training_rows(P.supplier_monthly(spark, d).filter(F.col("value").isNotNull()))
    model = training.fit(rows, ["month", "year"], training.random_forest(trees=1, depth=1, leaf=1, features="all", bootstrap=False))
    rows.unpersist()
    return training.feature_importance(model, ["month", "year"])


@query("t3_feature_importance")
def feature_importance(spark, d):
    rows, features = _split_frame(spark, d, "basic")
    rows = training.training_rows(rows)
    model = training.fit(rows.filter(F.col("split") == "train"), features, training.random_forest(trees=10, depth=5))
    return settle(training.feature_importance(model, features, 10))


def _score_monthly_requests(spark, d, estimator, features=None):
    monthly = stored(P.combined_monthly(spark, d).drop("date"), "monthly")
    base_year = monthly.agg(F.min("year")).first()[0]
    frame = X.monthly_features(monthly, base_year=base_year)
    trained, _ = training.train_and_evaluate(
        frame, features or X.feature_columns(frame), estimator, base_year, windows.MONTHLY_ORDER
    )
    requests = P.lookback_requests(spark, d).select("request_id", F.col("flag").alias("series_id"), "year", "month")
    return settle(scoring.score_monthly(requests, monthly, trained))


def _score_daily_requests(spark, d, estimator, features):
    daily = stored(P.combined_daily(spark, d), "daily")
    frame = X.daily_features(daily.drop("year", "month", "day"), X.SERVING_SPEC)
    trained, _ = training.train_and_evaluate(frame, features, estimator, C.BASE_YEAR, windows.DAILY_ORDER)
    requests = P.lookback_requests(spark, d).select("request_id", F.col("flag").alias("series_id"), "date")
    return settle(scoring.score_daily(requests, daily, trained))


_MONTHLY_SCORED = ["value_lag_1", "value_lag_12", "value_ma_3", "month_sin", "month_cos", "trend", "temperature"]
_DAILY_SCORED = ["value_lag_1", "value_lag_7", "value_ma_7", "temperature_lag_1", "doy_sin", "doy_cos", "day"]


def _scored_steps(train: str, asked: str, features: list[str]) -> dict[str, str]:
    """Requests join the fit as rows of value 0, whose residual is minus their prediction."""
    columns = ", ".join(features)
    return {
        "ls": f"""select series_id, date, value, split, 0 as fold, {columns} from {train}
            union all select series_id, date, 0, 'asked', 0, {columns} from {asked}""",
        **least_squares_steps(features, "split = 'train'"),
        "ans": "select distinct series_id, date, greatest(0.0, predicted - value) as predicted from res where split = 'asked'",
    }


_POSITIONED = """select *, case when row_number() over w <= count(*) over (partition by series_id)
    - cast(ceil(0.2 * count(*) over (partition by series_id)) as bigint) then 'train' else 'test' end as split
    from {} window w as (partition by series_id order by date)"""


@query("m23_batch_scoring_monthly", check(
    f"""select request_id, lk.series_id, year, month, {r("predicted", "predicted")} from lk
    join ans on ans.series_id = lk.series_id and ans.date = make_date(lk.year, lk.month, 1)""",
    "mm", "rq", **monthly_lookback_steps("mm", "flag"),
    mf=f"""select *, make_date(year, month, 1) as date from (select series_id, year, month, value, temperature,
        lag(value, 1) over w as value_lag_1, lag(value, 12) over w as value_lag_12, avg(value) over (partition by series_id
        order by year, month rows between 3 preceding and 1 preceding) as value_ma_3, sin(2 * pi() * month / 12) as month_sin,
        cos(2 * pi() * month / 12) as month_cos, (year - (select min(year) from mm)) * 12 + month - 1 as trend from mm
        window w as (partition by series_id order by year, month)) where value_lag_12 is not null""",
    tr=_POSITIONED.format("mf"),
    nm="select series_id, month, avg(temperature) as temperature from mm group by 1, 2",
    ask="""select distinct lk.series_id, make_date(lk.year, lk.month, 1) as date, value_lag_1, value_lag_12, value_ma_3,
        sin(2 * pi() * lk.month / 12) as month_sin, cos(2 * pi() * lk.month / 12) as month_cos,
        greatest(0, (lk.year - (select min(year) from mm)) * 12 + lk.month - 1) as trend, temperature from lk
        join nm on nm.series_id = lk.series_id and nm.month = lk.month""",
    **_scored_steps("tr", "ask", _MONTHLY_SCORED)))
def batch_scoring_monthly(spark, d):
    """Monthly requests scored with looked-up history, covariate normals and calendar features."""
    return _score_monthly_requests(spark, d, training.linear(), _MONTHLY_SCORED)


@query("m23_batch_scoring_monthly_forest")
def batch_scoring_monthly_forest(spark, d):
    """The same with all features and a forest."""
    return _score_monthly_requests(spark, d, training.random_forest(trees=20, depth=5))


@query("m24_batch_scoring_daily", check(
    f"""select request_id, lk.series_id, lk.date, {r("predicted", "predicted")} from lk
    join ans on ans.series_id = lk.series_id and ans.date = lk.date""", "dd", "rq", **DAILY_LOOKBACK_STEPS,
    df=f"""select * from (select series_id, date, value, cast(day(date) as double) as day, lag(value, 1) over w as value_lag_1,
        lag(value, 7) over w as value_lag_7, lag(value, 30) over w as value_lag_30, avg(value) over (partition by series_id
        order by date rows between 7 preceding and 1 preceding) as value_ma_7, lag(temperature, 1) over w as temperature_lag_1,
        sin(2 * pi() * dayofyear(date) / 365) as doy_sin, cos(2 * pi() * dayofyear(date) / 365) as doy_cos from dd
        window w as (partition by series_id order by date)) where value_lag_30 is not null""",
    tr=_POSITIONED.format("df"),
    ask="""select distinct series_id, date, value_lag_1, value_lag_7, value_ma_7, temperature_lag_1,
        sin(2 * pi() * dayofyear(date) / 365) as doy_sin, cos(2 * pi() * dayofyear(date) / 365) as doy_cos,
        cast(day(date) as double) as day from lk""",
    **_scored_steps("tr", "ask", _DAILY_SCORED)))
def batch_scoring_daily(spark, d):
    """Daily requests scored by a model that learned from features a request can have."""
    return _score_daily_requests(spark, d, training.linear(), _DAILY_SCORED)


@query("m24_batch_scoring_daily_forest")
def batch_scoring_daily_forest(spark, d):
    return _score_daily_requests(spark, d, training.random_forest(trees=20, depth=5), X.SERVING_FEATURES)
