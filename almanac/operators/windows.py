"""Lags, rolling statistics and sequences over a panel.

Every window partitions by series and orders by its time column, over frames holding at
most one row per (series, day) or (series, month): the calendar bounds each partition
whatever the raw row count. The builders return columns, so a caller puts everything that
shares a window into one ``select`` and Spark plans one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAILY_ORDER = ["date"]
MONTHLY_ORDER = ["year", "month"]

ROLLING = {"ma": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def series_window(order: list[str], keys: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*(keys or ["series_id"])).orderBy(*order)


def row_lags(column: str, lags: list[int], w: WindowSpec) -> list[Column]:
    """Value ``k`` rows earlier. With missing periods this is not ``k`` periods earlier."""
    return [F.lag(column, k).over(w).alias(f"{column}_lag_{k}") for k in lags]


def rolling_current(column: str, sizes: list[int], w: WindowSpec, stat: str = "ma") -> list[Column]:
    """Statistic over the last n rows, the current one included."""
    return [ROLLING[stat](column).over(w.rowsBetween(-(n - 1), 0)).alias(f"{column}_{stat}_{n}") for n in sizes]


def rolling_past(column: str, sizes: list[int], w: WindowSpec, stat: str = "ma") -> list[Column]:
    """Statistic over the n rows before the current one. The first row of a series has none."""
    return [ROLLING[stat](column).over(w.rowsBetween(-n, -1)).alias(f"{column}_{stat}_{n}") for n in sizes]


def row_trend(w: WindowSpec) -> Column:
    return (F.row_number().over(w) - 1).cast("int")


def change(column: str, k: int, w: WindowSpec) -> Column:
    return F.col(column) - F.lag(column, k).over(w)


def momentum(column: str, short: int, long: int, w: WindowSpec) -> Column:
    """Past-only short average minus past-only long average."""
    return F.avg(column).over(w.rowsBetween(-short, -1)) - F.avg(column).over(w.rowsBetween(-long, -1))


def calendar_lags(monthly: DataFrame, lags: list[int], column: str = "value") -> DataFrame:
    """Value ``k`` calendar months earlier, NULL when that month is missing.

    A range frame over the month counter covers exactly the month ``k`` back, so all lags
    share one sort and no self join is needed.
    """
    counter = F.col("year") * 12 + F.col("month")
    w = Window.partitionBy("series_id").orderBy(counter)
    return monthly.select(
        "*", *[F.max(column).over(w.rangeBetween(-k, -k)).alias(f"{column}_cal_lag_{k}") for k in lags]
    )


def sequences(df: DataFrame, column: str | Column, lookback: int, w: WindowSpec, target: str = "value") -> DataFrame:
    """Each row's ``lookback`` previous values and its own value as the target.

    Rows without a full history fall away; a NULL inside the history does the same,
    because collecting skips NULLs and leaves the array short.
    """
    history = F.collect_list(column).over(w.rowsBetween(-lookback, -1))
    return df.select("*", history.alias("history"), F.col(target).alias("target")).filter(
        F.size("history") == lookback
    )


def cumulative_mass(df: DataFrame, value: str = "value", tiebreak: str = "date") -> DataFrame:
    """Running share of the total over ascending values, and the cumulative distribution."""
    by_value = Window.partitionBy("series_id").orderBy(value, tiebreak)
    whole = Window.partitionBy("series_id")
    running = F.sum(value).over(by_value.rowsBetween(Window.unboundedPreceding, 0))
    return df.filter(F.col(value).isNotNull()).select(
        "*",
        F.try_divide(running, F.sum(value).over(whole)).alias("mass"),
        F.cume_dist().over(Window.partitionBy("series_id").orderBy(value)).alias("cume_dist"),
    )
