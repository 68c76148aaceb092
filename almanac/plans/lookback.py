"""History features for forecast requests, looked up by calendar.

Requests are first reduced to the distinct periods they ask about, however often each is
asked. The history features of those periods are computed once and joined back.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.calendar import month_index

MONTHLY_OFFSETS = [1, 2, 3, 12]
DAILY_OFFSETS = [1, 7, 30]
TAIL_ROWS = 7


def rejoined(requests: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with the features of their cell; each stays once, also if a part of its key is NULL."""
    cells = features.withColumnsRenamed({k: f"cell_{k}" for k in keys})
    same = reduce(and_, [requests[k].eqNullSafe(cells[f"cell_{k}"]) for k in keys])
    return requests.join(cells, same, "left").drop(*[f"cell_{k}" for k in keys])


def _shifted_month(month: Column, back: int) -> Column:
    """Month of year ``back`` months earlier, 1..12."""
    return F.pmod(month - 1 - back, F.lit(12)) + 1


def month_normals(monthly: DataFrame) -> DataFrame:
    """One row per series: its month means as a map of up to 12 entries, and their mean."""
    means = monthly.groupBy("series_id", "month").agg(F.avg("value").alias("mean"))
    return means.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("month", "mean"))).alias("normals"),
        F.avg("mean").alias("overall"),
    )


def monthly_lookback(requests: DataFrame, monthly: DataFrame) -> DataFrame:
    """Add value_lag_1, value_lag_12, value_ma_3 and value_ma_12 to requests (series_id, year, month).

    * lag 12: the same month a year before, else the month's normal.
    * lag 1: the month before, else that month's normal, else this month's.
    * average of 3: of the three months before when at least two are known, else of their
      normals, else this month's normal.
    * average of 12: this month's normal.
    A month that never occurred has the mean of the month means as its normal. A series
    without any history has 0 everywhere.
    """
    # Each observation is sent forward to the periods that look back at it: one grouped
    # aggregate instead of a join per lag.
    ahead = (
        monthly.select(
            "series_id",
            month_index("year", "month").alias("idx"),
            "value",
            F.explode(F.array(*[F.lit(k) for k in MONTHLY_OFFSETS])).alias("k"),
        )
        .groupBy("series_id", (F.col("idx") + F.col("k")).alias("idx"))
        .agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"prev{k}") for k in MONTHLY_OFFSETS])
    )
    cells = requests.select("series_id", "year", "month").distinct()
    known = (
        cells.withColumn("idx", month_index("year", "month"))
        .join(ahead, ["series_id", "idx"], "left")
        .join(month_normals(monthly), "series_id", "left")
    )

    month = F.col("month")

    def normal(back: int) -> Column:
        return F.try_element_at("normals", _shifted_month(month, back).cast("int"))

    default = F.coalesce(normal(0), F.col("overall"), F.lit(0.0))
    normal_lag_1 = F.coalesce(normal(1), default)
    recent = F.filter(F.array("prev1", "prev2", "prev3"), lambda x: x.isNotNull())
    recent_mean = F.aggregate(recent, F.lit(0.0), lambda s, x: s + x) / F.size(recent)
    ma_3 = F.when(F.size(recent) >= 2, recent_mean).otherwise(
        F.coalesce((normal_lag_1 + normal(2) + normal(3)) / 3, default)
    )
    features = known.select(
        "series_id", "year", "month",
        F.coalesce("prev1", normal_lag_1).alias("value_lag_1"),
        F.coalesce("prev12", default).alias("value_lag_12"),
        ma_3.alias("value_ma_3"),
        default.alias("value_ma_12"),
    )
    return rejoined(requests, features, ["series_id", "year", "month"])


def day_normals(daily: DataFrame, columns: list[str]) -> DataFrame:
    """One row per series: per column, a map of day-of-year means and the mean of all rows."""
    by_day = daily.groupBy("series_id", F.dayofyear("date").alias("doy")).agg(
        *[F.sum(c).alias(f"{c}_sum") for c in columns], *[F.count(c).alias(f"{c}_n") for c in columns]
    )

    def mean_map(c: str) -> Column:
        mean = F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_n"))
        return F.map_from_entries(F.collect_list(F.struct("doy", mean))).alias(f"{c}_normals")

    # At most 366 entries per map.
    return by_day.groupBy("series_id").agg(
        *[mean_map(c) for c in columns],
        *[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(f"{c}_mean") for c in columns],
    )


def day_normal(column: str) -> Column:
    """The normal of a row's day of year, else the mean of all rows, else 0 (after a join of ``day_normals``)."""
    return F.coalesce(F.try_element_at(f"{column}_normals", F.dayofyear("date")), F.col(f"{column}_mean"), F.lit(0.0))


def tail_mean(cells: DataFrame, daily: DataFrame, rows: int = TAIL_ROWS) -> DataFrame:
    """Mean and count of the last ``rows`` observations strictly before each cell (series_id, date).

    An as-of join: each observation carries its trailing mean; cells and observations are
    merged in date order, and a cell takes over the newest observation before it.
    """
    w = Window.partitionBy("series_id").orderBy("date")
    trailing = w.rowsBetween(-(rows - 1), 0)
    facts = daily.select(
        "series_id",
        "date",
        F.struct(F.avg("value").over(trailing).alias("mean"), F.count("value").over(trailing).alias("n")).alias("tail"),
        F.lit(1).alias("is_fact"),
    )
    asked = cells.select("series_id", "date", F.lit(None).cast(facts.schema["tail"].dataType).alias("tail"), F.lit(0).alias("is_fact"))
    # A cell sorts before the observation of its own day, which it must not see.
    merged = Window.partitionBy("series_id").orderBy("date", "is_fact")
    before = merged.rowsBetween(Window.unboundedPreceding, -1)
    return (
        facts.unionByName(asked)
        .withColumn("tail", F.last("tail", ignorenulls=True).over(before))
        .filter(F.col("is_fact") == 0)
        .select("series_id", "date", F.col("tail.mean").alias("tail_mean"), F.coalesce("tail.n", F.lit(0)).alias("tail_n"))
    )


def daily_lookback(requests: DataFrame, daily: DataFrame) -> DataFrame:
    """Add the daily history features to requests (series_id, date).

    Lags 1, 7 and 30 are the values of exactly that many days before, else the normal of
    the requested day of year. The average is over the last seven observations when there
    are two or more. Yesterday's temperature is used when known; the other covariate slots
    hold normals. A day of year that never occurred uses the mean of all rows, and a series
    without history 0.
    """
    covariates = [c for c in ("temperature", "humidity", "wind_speed") if c in daily.columns]
    columns = ["value", *covariates]
    with_temperature = "temperature" in covariates

    ahead = (
        daily.select(
            "series_id", "date", "value", *(["temperature"] if with_temperature else []),
            F.explode(F.array(*[F.lit(k) for k in DAILY_OFFSETS])).alias("k"),
        )
        .groupBy("series_id", F.date_add("date", F.col("k")).alias("date"))
        .agg(
            *[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"prev{k}") for k in DAILY_OFFSETS],
            *([F.max(F.when(F.col("k") == 1, F.col("temperature"))).alias("temperature_prev")] if with_temperature else []),
        )
    )
    cells = requests.select("series_id", "date").distinct()
    known = (
        cells.join(ahead, ["series_id", "date"], "left")
        .join(tail_mean(cells, daily), ["series_id", "date"], "left")
        .join(day_normals(daily, columns), "series_id", "left")
    )
    normal = day_normal
    out = [F.coalesce(f"prev{k}", normal("value")).alias(f"value_lag_{k}") for k in DAILY_OFFSETS]
    out.append(F.when(F.col("tail_n") >= 2, F.col("tail_mean")).otherwise(normal("value")).alias("value_ma_7"))
    if with_temperature:
        out.append(F.coalesce("temperature_prev", normal("temperature")).alias("temperature_lag_1"))
        out.append(normal("temperature").alias("temperature_ma_7"))
    out += [normal(c).alias(f"{c}_lag_1") for c in covariates if c != "temperature"]
    return rejoined(requests, known.select("series_id", "date", *out), ["series_id", "date"])
