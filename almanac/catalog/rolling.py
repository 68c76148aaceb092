"""Window operators (W) and feature frames (M1, M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog import panels as P
from almanac.catalog.panels import COVARIATES, check, query, r, settle
from almanac.operators import correlation, split, windows as W
from almanac.plans import features as X
from almanac.sources.tables import read_table

_D = "window w as (partition by series_id order by date)"
_M = "window w as (partition by series_id order by year, month)"


def _frame(n: int, current: bool = False, order: str = "date") -> str:
    ends = f"{n - 1} preceding and current row" if current else f"{n} preceding and 1 preceding"
    return f"over (partition by series_id order by {order} rows between {ends})"


@query("w1_row_lags_daily", check(
    "select series_id, date, value, " + ", ".join(f"lag(value, {k}) over w as value_lag_{k}" for k in (1, 2, 3, 7, 14, 21, 30))
    + f" from qd {_D}", "qd"))
def row_lags_daily(spark, d):
    w = W.series_window(W.DAILY_ORDER)
    return P.quantity_daily(spark, d).select("*", *W.row_lags("value", [1, 2, 3, 7, 14, 21, 30], w))


@query("w1_row_lags_monthly", check(
    "select *, " + ", ".join(f"lag(value, {k}) over w as value_lag_{k}" for k in (1, 3, 12)) + f" from pm {_M}", "pm"))
def row_lags_monthly(spark, d):
    w = W.series_window(W.MONTHLY_ORDER)
    return P.price_monthly(spark, d).select("*", *W.row_lags("value", [1, 3, 12], w))


@query("w1_calendar_lags", check(
    """select pm.*, a.value as value_cal_lag_1, b.value as value_cal_lag_12 from pm
    left join pm a on a.series_id = pm.series_id and a.year * 12 + a.month = pm.year * 12 + pm.month - 1
    left join pm b on b.series_id = pm.series_id and b.year * 12 + b.month = pm.year * 12 + pm.month - 12""", "pm"))
def calendar_lags(spark, d):
    return W.calendar_lags(P.price_monthly(spark, d), [1, 12])


@query("w2_covariate_lags", check(
    "select series_id, date, " + ", ".join(
        r(f"lag({c}, {k}) over w", f"{c}_lag_{k}") for c in COVARIATES for k in (1, 3, 7)) + f" from cd {_D}", "cd"))
def covariate_lags(spark, d):
    w = W.series_window(W.DAILY_ORDER)
    cols = [x for c in COVARIATES for x in W.row_lags(c, [1, 3, 7], w)]
    return settle(P.covariates_daily(spark, d).select("series_id", "date", *cols))


@query("w3_rolling_mean_current", check(
    "select series_id, year, month, " + ", ".join(
        r(f"avg(value) {_frame(n, True, 'year, month')}", f"value_ma_{n}") for n in (3, 12)) + " from sm", "sm"))
def rolling_mean_current(spark, d):
    w = W.series_window(W.MONTHLY_ORDER)
    return settle(P.supplier_monthly(spark, d).select("series_id", "year", "month", *W.rolling_current("value", [3, 12], w)))


def _past(stat: str, fn: str, sizes):
    sql = check(
        "select series_id, date, " + ", ".join(r(f"{fn}(value) {_frame(n)}", f"value_{stat}_{n}") for n in sizes)
        + " from qd", "qd")

    def run(spark, d):
        w = W.series_window(W.DAILY_ORDER)
        return settle(P.quantity_daily(spark, d).select("series_id", "date", *W.rolling_past("value", list(sizes), w, stat)))

    return sql, run


for _name, _stat, _fn in (
    ("w4_rolling_mean_past", "ma", "avg"), ("w5_rolling_std_past", "std", "stddev_samp"),
    ("w6_rolling_min_past", "min", "min"), ("w6_rolling_max_past", "max", "max"),
):
    _sql, _run = _past(_stat, _fn, (3, 7, 14, 30))
    query(_name, _sql)(_run)


@query("w7_row_trend", check(
    "select series_id, year, month, cast(row_number() over (partition by series_id order by year, month) - 1 as int) as trend from sm",
    "sm"))
def row_trend(spark, d):
    w = W.series_window(W.MONTHLY_ORDER)
    return P.supplier_monthly(spark, d).select("series_id", "year", "month", W.row_trend(w).alias("trend"))


@query("w8_change_and_momentum", check(
    f"""select series_id, date, value - lag(value, 1) over w as value_change_1, value - lag(value, 7) over w as value_change_7,
    {r(f"avg(value) {_frame(3)} - avg(value) {_frame(7)}", "value_momentum")} from qd {_D}""", "qd"))
def change_and_momentum(spark, d):
    w = W.series_window(W.DAILY_ORDER)
    out = P.quantity_daily(spark, d).select(
        "series_id", "date",
        *[W.change("value", k, w).alias(f"value_change_{k}") for k in (1, 7)],
        W.momentum("value", 3, 7, w).alias("value_momentum"),
    )
    return settle(out)


@query("w9_lag_of_derived", check(
    f"""select series_id, date, {r("temperature * humidity", "product")},
    {r("lag(temperature * humidity, 1) over w", "product_lag_1")} from cd {_D}""", "cd"))
def lag_of_derived(spark, d):
    w = W.series_window(W.DAILY_ORDER)
    product = F.col("temperature") * F.col("humidity")
    return settle(
        P.covariates_daily(spark, d).select(
            "series_id", "date", product.alias("product"), F.lag(product, 1).over(w).alias("product_lag_1")
        )
    )


@query("w10_sequences", check(
    """select series_id, year, month, string_agg(cast(b.value as bigint), ',' order by b.rn) as history, any_value(a.v) as target
    from (select series_id, year, month, value as v, rn from num) a join (select series_id as s, value, rn from num) b
    on a.series_id = b.s and b.rn between a.rn - 12 and a.rn - 1 group by series_id, year, month having count(*) = 12""",
    "sm", num="select *, row_number() over (partition by series_id order by year, month) as rn from sm"))
def sequences(spark, d):
    w = W.series_window(W.MONTHLY_ORDER)
    out = W.sequences(P.supplier_monthly(spark, d), "value", 12, w)
    joined = F.array_join(F.transform("history", lambda x: x.cast("bigint").cast("string")), ",")
    return out.select("series_id", "year", "month", joined.alias("history"), "target")


@query("w10_sequences_daily", check(
    f"""select series_id, date, len(h) as steps, {r("list_sum([x.value for x in h])", "value_total")},
    {r("h[1].temperature", "first_temperature")}, {r("h[30].humidity", "last_humidity")}, value as target from (
    select series_id, date, value, list({{'value': value, 'temperature': temperature, 'humidity': humidity}})
    over (partition by series_id order by date rows between 30 preceding and 1 preceding) as h from dd)
    where len(h) = 30""", "dd"))
def sequences_daily(spark, d):
    """Thirty days of several columns per row."""
    w = W.series_window(W.DAILY_ORDER)
    step = F.struct("value", "temperature", "humidity")
    out = W.sequences(P.combined_daily(spark, d), step, 30, w)
    total = F.aggregate("history", F.lit(0.0), lambda s, x: s + x["value"])
    return settle(
        out.select(
            "series_id", "date", F.size("history").cast("bigint").alias("steps"), total.alias("value_total"),
            F.col("history")[0]["temperature"].alias("first_temperature"),
            F.col("history")[29]["humidity"].alias("last_humidity"), "target",
        )
    )


@query("w11_chronological_split", check(
    """select series_id, date, case when row_number() over w
    <= count(*) over (partition by series_id) - cast(ceil(0.2 * count(*) over (partition by series_id)) as bigint)
    then 'train' else 'test' end as split from qd window w as (partition by series_id order by date)""", "qd"))
def chronological_split(spark, d):
    return split.chronological_split(P.quantity_daily(spark, d), W.DAILY_ORDER).select("series_id", "date", "split")


@query("w12_hashed_split", """
    select o_orderkey, case when cast('0x' || substr(md5(o_orderkey || '|42'), 1, 8) as bigint) % 100 < 20
    then 'test' else 'train' end as split from orders""")
def hashed_split(spark, d):
    return read_table(spark, d, "orders").select(
        "o_orderkey", split.hashed_split([F.col("o_orderkey")], 42).alias("split")
    )


@query("w13_contiguous_folds", check(
    """select series_id, date, cast(ntile(5) over w - 1 as int) as fold, cast(ntile(3) over w - 1 as int) as fold3
    from qd window w as (partition by series_id order by date)""", "qd"))
def contiguous_folds(spark, d):
    five = split.contiguous_folds(P.quantity_daily(spark, d), W.DAILY_ORDER, 5)
    three = split.contiguous_folds(five.withColumnRenamed("fold", "fold5"), W.DAILY_ORDER, 3)
    return three.select("series_id", "date", F.col("fold5").alias("fold"), F.col("fold").alias("fold3"))


@query("w14_cumulative_mass", check(
    f"""select series_id, date, {r("sum(value) over (partition by series_id order by value, date rows unbounded preceding)"
      " / sum(value) over (partition by series_id)", "mass", 6)},
    {r("cume_dist() over (partition by series_id order by value)", "cume_dist", 6)} from qd""", "qd"))
def cumulative_mass(spark, d):
    out = W.cumulative_mass(P.quantity_daily(spark, d))
    return settle(out.select("series_id", "date", "mass", "cume_dist"), 6)


@query("w15_key_alignment", check(
    """select pm.series_id, pm.year, pm.month, pm.value as value, b.value as earlier from pm
    join pm b on b.series_id = pm.series_id and b.year = pm.year - 1 and b.month = pm.month""", "pm"))
def key_alignment(spark, d):
    """Two frames of different length aligned on their period instead of their row number."""
    now = P.price_monthly(spark, d)
    earlier = now.select("series_id", (F.col("year") + 1).alias("year"), "month", F.col("value").alias("earlier"))
    return now.join(earlier, ["series_id", "year", "month"])


_CENTRED = """select series_id, value - avg(value) over (partition by series_id) as e,
    row_number() over (partition by series_id order by date) as rn from qd"""
_ACF = """select a.series_id, cast(k.lag as int) as lag, sum(a.e * b.e) / any_value(t.s) as acf from e a
    join (select unnest(range(41)) as lag) k on true join e b on b.series_id = a.series_id and b.rn = a.rn - k.lag
    join (select series_id, sum(e * e) as s from e group by 1) t on t.series_id = a.series_id group by 1, 2"""


@query("w16_acf", check(f"select series_id, lag, {r('acf', 'acf', 6)} from ac", "qd", e=_CENTRED, ac=_ACF))
def acf(spark, d):
    return settle(correlation.acf(P.quantity_daily(spark, d), W.DAILY_ORDER), 6)


@query("w17_pacf", check(
    f"select series_id, cast(k as int) as lag, {r('p', 'pacf', 6)} from rec", "qd", e=_CENTRED, ac=_ACF,
    ar="select series_id, list(acf order by lag) as r from ac group by 1",
    rec="""select series_id, 0 as k, cast([] as double[]) as phi, 1.0::double as p from ar
        union all select series_id, k + 1, list_append([phi[j] - refl * phi[k + 1 - j] for j in range(1, k + 1)], refl), refl
        from (select rec.series_id, k, phi, (r[k + 2] - coalesce(list_sum([phi[j] * r[k + 2 - j] for j in range(1, k + 1)]), 0))
            / (1 - coalesce(list_sum([phi[j] * r[j + 1] for j in range(1, k + 1)]), 0)) as refl
            from rec join ar on ar.series_id = rec.series_id where k < 40)""").replace("with ", "with recursive ", 1))
def pacf(spark, d):
    return settle(correlation.pacf(P.quantity_daily(spark, d), W.DAILY_ORDER), 6)


# --- Feature frames ---------------------------------------------------------------------


def _monthly_sql(panel: str, covariates: list[str], past: bool) -> str:
    cur = not past
    o = "year, month"
    cols = [
        r("sin(2 * pi() * month / 12)", "month_sin"), r("cos(2 * pi() * month / 12)", "month_cos"),
        "cast(row_number() over w - 1 as int) as trend", "cast((month - 1) // 3 + 1 as int) as quarter",
        *[r(f"lag(value, {k}) over w", f"value_lag_{k}") for k in (1, 12)],
        *[r(f"avg(value) {_frame(n, cur, o)}", f"value_ma_{n}") for n in (3, 12)],
    ]
    for c in covariates:
        lags = (1,) if c in ("cloud_cover", "surface_pressure") else (1, 12)
        cols += [r(f"lag({c}, {k}) over w", f"{c}_lag_{k}") for k in lags]
        cols.append(r(f"avg({c}) {_frame(3, cur, o)}", f"{c}_ma_3"))
    keep = ", ".join(r(c, c) for c in covariates)
    inner = f"select series_id, year, month, value{', ' + keep if keep else ''}, {', '.join(cols)} from {panel} {_M}"
    return check(f"select * from ({inner}) where value_lag_12 is not null", panel)


@query("m1_monthly_features", _monthly_sql("mm", COVARIATES, past=True))
def monthly_features(spark, d):
    return settle(X.monthly_features(P.combined_monthly(spark, d).drop("date")))


@query("m1_monthly_features_current_row", _monthly_sql("mm", COVARIATES, past=False))
def monthly_features_current(spark, d):
    return settle(X.monthly_features(P.combined_monthly(spark, d).drop("date"), past_only=False))


@query("m1_monthly_features_value_only", _monthly_sql("sm", [], past=True))
def monthly_features_value_only(spark, d):
    return settle(X.monthly_features(P.supplier_monthly(spark, d)))


_INTERACTION_SQL = {
    "temp_humidity_ratio": "temperature / (humidity + 1)",
    "temp_humidity": "temperature * humidity / 100",
    "cloud_humidity": "cloud_cover * humidity / 100",
    "wind_pressure_ratio": "wind_speed / (surface_pressure / 1000)",
}
_STAT_SQL = {"ma": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def daily_body(spec: X.DailySpec, show=r) -> str:
    """The feature frame as a statement over the combined panel; ``show`` names each column."""
    cols = ["cast(dayofyear(date) as int) as day_of_year", show("sin(2 * pi() * dayofyear(date) / 365)", "doy_sin"),
            show("cos(2 * pi() * dayofyear(date) / 365)", "doy_cos"),
            "cast((year - 1979) * 365 + dayofyear(date) as int) as trend"]
    if spec.month_cycle:
        cols += [show("sin(2 * pi() * month / 12)", "month_sin"), show("cos(2 * pi() * month / 12)", "month_cos")]
    cols += [f"lag(value, {k}) over w as value_lag_{k}" for k in spec.lags]
    for s in spec.stats:
        cols += [show(f"{_STAT_SQL[s]}(value) {_frame(n)}", f"value_{s}_{n}") for n in spec.windows]
    for c in COVARIATES:
        cols += [show(f"lag({c}, {k}) over w", f"{c}_lag_{k}") for k in spec.covariate_lags]
        for s in spec.covariate_stats:
            cols += [show(f"{_STAT_SQL[s]}({c}) {_frame(n)}", f"{c}_{s}_{n}") for n in spec.covariate_windows]
    for name in spec.interactions:
        e = _INTERACTION_SQL[name]
        cols += [show(e, name), show(f"lag({e}, 1) over w", f"{name}_lag_1")]
    cols += [show(_INTERACTION_SQL[name], name) for name in spec.unlagged]
    cols += [f"lag(value, 1) over w - lag(value, {k + 1}) over w as value_change_{k}" for k in spec.changes]
    if spec.momentum:
        short, long = spec.momentum
        cols.append(show(f"avg(value) {_frame(short)} - avg(value) {_frame(long)}", "value_momentum"))
    shown = ", ".join(show(c, c) for c in COVARIATES)
    body = f"select series_id, date, value, {shown}, year, month, day, {', '.join(cols)} from dd {_D}"
    return f"select * from ({body}) where value_lag_{max(spec.lags)} is not null"


def _daily_query(spec: X.DailySpec):
    return lambda spark, d: settle(X.daily_features(P.combined_daily(spark, d).drop("year", "month", "day"), spec))


for _variant, _spec in X.DAILY_SPECS.items():
    query(f"m2_daily_features_{_variant}", check(daily_body(_spec), "dd"))(_daily_query(_spec))
