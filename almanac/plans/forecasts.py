"""Forecasts in closed form: climatology with trend, intervals, and the simple baselines."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.scoring import non_negative
from almanac.operators.metrics import residuals
from almanac.operators.split import chronological_split
from almanac.operators.windows import MONTHLY_ORDER, calendar_lags

# Base forecast of a month that has no history.
DEFAULT_BASE = 100.0
# Yearly growth assumed, around the given year, where the history is too short for a trend.
FALLBACK_GROWTH = 0.004
FALLBACK_YEAR = 2020
# Fewest rows of the same month for a trend of its own.
MIN_TREND_ROWS = 5
# Keeps the slope finite.
SLOPE_EPSILON = 1e-8


def month_trends(monthly: DataFrame) -> DataFrame:
    """Per series and month of year: mean, rows, distinct years, mean year and slope over the years.

    The slope is fitted to one average per year.
    """
    by_year = monthly.groupBy("series_id", "month", "year").agg(
        F.avg("value").alias("value"), F.sum("value").alias("total"), F.count("value").alias("n")
    )
    return by_year.groupBy("series_id", "month").agg(
        (F.sum("total") / F.sum("n")).alias("mean"),
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_years"),
        F.avg("year").alias("mean_year"),
        (F.regr_sxy("value", "year") / (F.regr_sxx("value", "year") + SLOPE_EPSILON)).alias("slope"),
    )


def year_adjusted(base: Column) -> Column:
    """Shift a base forecast along the month's trend, or by the assumed growth without one."""
    has_trend = (F.col("n_rows") >= MIN_TREND_ROWS) & (F.col("n_years") >= 2)
    return F.when(has_trend, base + F.col("slope") * (F.col("year") - F.col("mean_year"))).otherwise(
        base * (1 + FALLBACK_GROWTH * (F.col("year") - FALLBACK_YEAR))
    )


def climatology_trend_forecast(requests: DataFrame, monthly: DataFrame) -> DataFrame:
    """Add ``predicted``: the month's mean moved along its year trend, never below 0."""
    joined = requests.join(month_trends(monthly), ["series_id", "month"], "left")
    base = F.coalesce(F.col("mean"), F.lit(DEFAULT_BASE))
    return joined.select(*requests.columns, non_negative(year_adjusted(base)).alias("predicted"))


def backtest_baselines(monthly: DataFrame) -> DataFrame:
    """Predictions of the last fifth of each series by models fitted on the rows before.

    ``climatology``: month mean. ``climatology_trend``: the same along its year trend.
    ``lag_12``: the value a calendar year before. ``last_value``: the month before.
    """
    lagged = calendar_lags(chronological_split(monthly, MONTHLY_ORDER), [1, 12])
    fitted = month_trends(lagged.filter(F.col("split") == "train"))
    test = lagged.filter(F.col("split") == "test").join(fitted, ["series_id", "month"], "left")
    base = F.coalesce(F.col("mean"), F.lit(DEFAULT_BASE))
    models = F.array(
        F.struct(F.lit("climatology").alias("model_key"), base.alias("predicted")),
        F.struct(F.lit("climatology_trend").alias("model_key"), non_negative(year_adjusted(base)).alias("predicted")),
        F.struct(F.lit("lag_12").alias("model_key"), F.col("value_cal_lag_12").alias("predicted")),
        F.struct(F.lit("last_value").alias("model_key"), F.col("value_cal_lag_1").alias("predicted")),
    )
    return test.select("series_id", "year", "month", F.col("value").alias("actual"), F.inline(models))


def residual_spread(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Population deviation of the hold-out residuals."""
    return residuals(predictions).groupBy(*keys).agg(
        F.stddev_pop("residual").alias("std_error"), F.count(F.lit(1)).alias("n")
    )


def with_interval(forecasts: DataFrame, spread: DataFrame, level: float = 0.95) -> DataFrame:
    """Point forecast with its normal interval; the lower bound stops at 0."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    margin = F.col("std_error") * F.lit(z)
    kept = [c for c in forecasts.columns if c != "predicted"]
    return forecasts.join(spread.select("series_id", "std_error"), "series_id", "left").select(
        *kept,
        F.round(non_negative(F.col("predicted")), 2).alias("point_estimate"),
        F.round(non_negative(F.col("predicted") - margin), 2).alias("lower_bound"),
        F.round(F.col("predicted") + margin, 2).alias("upper_bound"),
        F.round(margin, 2).alias("margin_of_error"),
        F.round("std_error", 2).alias("std_error"),
        F.lit(f"{int(level * 100)}%").alias("confidence_level"),
    )


def month_range(requests: DataFrame) -> DataFrame:
    """Requests (series_id, year, start_month, end_month) to one row per month."""
    kept = [c for c in requests.columns if c not in ("start_month", "end_month")]
    return requests.filter(F.col("start_month") <= F.col("end_month")).select(
        *kept, F.explode(F.sequence("start_month", "end_month")).alias("month")
    )


