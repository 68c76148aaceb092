"""Feature frames for the monthly and daily models, each described by a spec."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.calendar import BASE_YEAR, cyclic, date_parts, day_trend, month_trend, quarter_of
from almanac.operators import windows as W
from almanac.sources.tables import covariate_columns

# Interactions of covariates: the columns needed and the expression.
INTERACTIONS: dict[str, tuple[list[str], object]] = {
    "temp_humidity_ratio": (
        ["temperature", "humidity"],
        lambda: F.try_divide(F.col("temperature"), F.col("humidity") + 1),
    ),
    "temp_humidity": (
        ["temperature", "humidity"],
        lambda: F.col("temperature") * F.col("humidity") / 100,
    ),
    "cloud_humidity": (
        ["cloud_cover", "humidity"],
        lambda: F.col("cloud_cover") * F.col("humidity") / 100,
    ),
    "wind_pressure_ratio": (
        ["wind_speed", "surface_pressure"],
        lambda: F.try_divide(F.col("wind_speed"), F.col("surface_pressure") / 1000),
    ),
}


@dataclass(frozen=True)
class DailySpec:
    """What one daily model looks at."""

    lags: list[int]
    windows: list[int] = field(default_factory=list)
    stats: list[str] = field(default_factory=lambda: ["ma"])
    covariate_lags: list[int] = field(default_factory=lambda: [1])
    covariate_windows: list[int] = field(default_factory=list)
    covariate_stats: list[str] = field(default_factory=lambda: ["ma"])
    interactions: list[str] = field(default_factory=list)
    # Interactions that appear by themselves but without their lag.
    unlagged: list[str] = field(default_factory=list)
    month_cycle: bool = True
    changes: list[int] = field(default_factory=list)
    momentum: tuple[int, int] | None = None


# The variants the daily models are trained with.
DAILY_SPECS: dict[str, DailySpec] = {
    "basic": DailySpec(
        lags=[1, 2, 3, 7, 14, 30], windows=[3, 7, 14],
        covariate_windows=[7], interactions=["temp_humidity_ratio"],
    ),
    "simple": DailySpec(
        lags=[3, 14], windows=[3, 14], interactions=["temp_humidity", "cloud_humidity"],
    ),
    "ensemble": DailySpec(
        lags=[1, 3, 7, 14], windows=[3, 7, 14],
        covariate_windows=[7], interactions=["temp_humidity_ratio"],
    ),
    "tuned": DailySpec(
        lags=[1, 2, 3, 7, 14, 21, 30], windows=[3, 7, 14], stats=["ma", "std"],
        covariate_windows=[7], interactions=["temp_humidity_ratio"],
    ),
    "advanced": DailySpec(
        lags=[1, 2, 3, 7, 14, 21, 30], windows=[3, 7, 14, 30], stats=["ma", "std", "min", "max"],
        covariate_lags=[1, 3, 7], covariate_windows=[3, 7], covariate_stats=["ma", "std"],
        interactions=["temp_humidity_ratio", "cloud_humidity", "wind_pressure_ratio"],
        unlagged=["temp_humidity"], changes=[1, 7], momentum=(3, 7),
    ),
    "sequence": DailySpec(lags=[1, 3, 7], month_cycle=False),
}


def daily_features(
    daily: DataFrame,
    spec: DailySpec,
    base_year: int = BASE_YEAR,
    leak_current: bool = False,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Daily feature frame: one exchange by series, one sort, one window pass.

    The change features use only past values by default (the change up to yesterday).
    ``leak_current`` computes them from today's value instead, which is the target.
    """
    w = W.series_window(W.DAILY_ORDER)
    covariates = covariate_columns(daily)
    parts = date_parts("date")
    base: list[Column] = ["series_id", "date", "value", *covariates]
    base += [parts[p].alias(p) for p in ("year", "month", "day", "day_of_year")]

    cols: list[Column] = []
    for name, pair in (("doy", cyclic(parts["day_of_year"], 365)), ("month", cyclic(parts["month"], 12))):
        if name == "doy" or spec.month_cycle:
            cols += [pair[0].alias(f"{name}_sin"), pair[1].alias(f"{name}_cos")]
    cols.append(day_trend(parts["year"], parts["day_of_year"], base_year).alias("trend"))

    cols += W.row_lags("value", spec.lags, w)
    for stat in spec.stats:
        cols += W.rolling_past("value", spec.windows, w, stat)
    for c in covariates:
        cols += W.row_lags(c, spec.covariate_lags, w)
        for stat in spec.covariate_stats:
            cols += W.rolling_past(c, spec.covariate_windows, w, stat)
    for name in [*spec.interactions, *spec.unlagged]:
        needed, make = INTERACTIONS[name]
        if all(c in covariates for c in needed):
            cols.append(make().alias(name))
            if name in spec.interactions:
                cols.append(F.lag(make(), 1).over(w).alias(f"{name}_lag_1"))
    for k in spec.changes:
        now = F.col("value") if leak_current else F.lag("value", 1).over(w)
        then = F.lag("value", k if leak_current else k + 1).over(w)
        cols.append((now - then).alias(f"value_change_{k}"))
    if spec.momentum:
        cols.append(W.momentum("value", *spec.momentum, w).alias("value_momentum"))

    out = daily.select(*base, *cols)
    return out.dropna() if drop_incomplete else out


def monthly_features(
    monthly: DataFrame,
    lags: list[int] | None = None,
    windows: list[int] | None = None,
    past_only: bool = True,
    drop_incomplete: bool = True,
    base_year: int | None = None,
) -> DataFrame:
    """Monthly feature frame, with covariate lags and averages for whichever covariates exist.

    The required covariates get lags 1 and 12 and a 3-month average, the optional ones lag
    1 and the average. ``past_only=False`` lets the rolling averages include the month
    itself, target included. The trend counts rows, or with ``base_year`` the calendar
    months since then, which is what scoring a later request can reproduce.
    """
    lags = [1, 12] if lags is None else lags
    windows = [3, 12] if windows is None else windows
    w = W.series_window(W.MONTHLY_ORDER)
    rolling = W.rolling_past if past_only else W.rolling_current
    sin, cos = cyclic("month", 12)
    cols: list[Column] = [
        sin.alias("month_sin"),
        cos.alias("month_cos"),
        (W.row_trend(w) if base_year is None else month_trend("year", "month", base_year)).alias("trend"),
        quarter_of("month").alias("quarter"),
        *W.row_lags("value", lags, w),
        *rolling("value", windows, w),
    ]
    covariates = covariate_columns(monthly)
    for c in covariates:
        optional = c in ("cloud_cover", "surface_pressure")
        cols += W.row_lags(c, [1] if optional else [1, 12], w)
        cols += rolling(c, [3], w)
    out = monthly.select("series_id", "year", "month", "value", *covariates, *cols)
    return out.dropna() if drop_incomplete else out


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ("series_id", "date", "value", "split", "fold")) -> list[str]:
    """All columns but the identifiers and the target."""
    return [c for c in df.columns if c not in exclude]


def align_features(df: DataFrame, wanted: list[str]) -> list[Column]:
    """The wanted feature columns, as doubles; a column the frame lacks becomes 0."""
    return [(F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in wanted]


# --- Features of a request, which has no observation of its own yet -----------------------

SERVING_SPEC = DailySpec(lags=[1, 7, 30], windows=[7], covariate_windows=[7], month_cycle=False)
# What the daily lookback and the calendar can tell about a day to come.
SERVING_FEATURES = [
    "year", "month", "day", "day_of_year", "doy_sin", "doy_cos", "trend",
    "value_lag_1", "value_lag_7", "value_lag_30", "value_ma_7",
    "temperature_lag_1", "temperature_ma_7", "humidity_lag_1", "wind_speed_lag_1",
]


def with_day_fields(df: DataFrame, base_year: int = BASE_YEAR) -> DataFrame:
    parts = date_parts("date")
    sin, cos = cyclic(parts["day_of_year"], 365)
    return df.select(
        "*", *[c.alias(n) for n, c in parts.items()], sin.alias("doy_sin"), cos.alias("doy_cos"),
        day_trend(parts["year"], parts["day_of_year"], base_year).alias("trend"),
    )


def request_features(known: DataFrame, panel_columns: list[str], base_year: int) -> DataFrame:
    """Monthly features of requests that carry their lookback and covariate normals.

    The normal of a covariate also stands in for its lags and its average.
    """
    sin, cos = cyclic("month", 12)
    cols = [
        sin.alias("month_sin"), cos.alias("month_cos"),
        month_trend("year", "month", base_year).alias("trend"), quarter_of("month").alias("quarter"),
    ]
    for c in covariate_columns(known):
        if c in panel_columns:
            optional = c in ("cloud_cover", "surface_pressure")
            cols += [F.col(c).alias(f"{c}_lag_{k}") for k in ([1] if optional else [1, 12])]
            cols.append(F.col(c).alias(f"{c}_ma_3"))
    return known.select("*", *cols)
