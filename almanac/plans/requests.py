"""Validation of forecast requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_YEAR = 1979
LAST_YEAR = 2100

MONTHLY_MODELS = ["gradient_boosting_weather", "random_forest_weather", "sarimax"]
DAILY_MODELS = [
    "daily_gradient_boosting",
    "daily_random_forest",
    "daily_xgboost",
    "daily_xgboost_simple",
    "daily_xgb_tuned",
    "daily_ensemble",
    "daily_stacking",
]


def validate(requests: DataFrame) -> DataFrame:
    """Add ``reason``: why a request is refused, NULL when it is fine.

    A request with a day is a daily one and names a daily model. A day that the month does
    not have passes the range check but is no date, so it is refused too.
    """
    year, month, day, model = (F.col(c) for c in ("year", "month", "day", "model_key"))
    daily = day.isNotNull()
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    reason = (
        F.when(year.isNull() | ~year.between(FIRST_YEAR, LAST_YEAR), "year out of range")
        .when(month.isNull() | ~month.between(1, 12), "month out of range")
        .when(daily & ~day.between(1, 31), "day out of range")
        .when(daily & F.try_to_date(text, "yyyy-MM-dd").isNull(), "no such date")
        .when(daily & ~model.isin(DAILY_MODELS), "unknown model")
        .when(~daily & ~model.isin(MONTHLY_MODELS), "unknown model")
    )
    return requests.withColumn("reason", reason)


def accepted(requests: DataFrame) -> DataFrame:
    return validate(requests).filter(F.col("reason").isNull()).drop("reason")
