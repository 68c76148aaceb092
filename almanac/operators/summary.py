"""Descriptive summaries, extremes, seasonality and data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.sources.tables import covariate_columns


def daily_summary(daily: DataFrame) -> DataFrame:
    """Count, span, moments and exact quartiles per series.

    The exact percentile keeps a counter per distinct value; on a panel that is at most
    one per calendar day.
    """
    q = F.percentile("value", [0.25, 0.5, 0.75])
    return (
        daily.groupBy("series_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            q.alias("q"),
        )
        .select(
            "series_id", "n", "first_date", "last_date",
            F.date_diff("last_date", "first_date").alias("duration_days"),
            "mean", F.col("q")[1].alias("median"), "std", "min", "max",
            F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"),
        )
    )


def wet_dry(daily: DataFrame) -> DataFrame:
    """Days with a positive value and the rest. Missing values count as dry."""
    n = F.count(F.lit(1))
    wet = F.count_if(F.col("value") > 0)
    return daily.groupBy("series_id").agg(
        wet.alias("wet_days"),
        (n - wet).alias("dry_days"),
        (wet * 100.0 / n).alias("wet_percent"),
        ((n - wet) * 100.0 / n).alias("dry_percent"),
    )


def month_statistics(df: DataFrame) -> DataFrame:
    """Sum, mean, deviation and range by month of year."""
    return df.groupBy("series_id", "month").agg(
        F.sum("value").alias("sum"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.max("value").alias("max"),
        F.min("value").alias("min"),
    )


def monthly_summary(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.avg("value").alias("mean"),
        F.percentile("value", 0.5).alias("median"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def extremes(monthly: DataFrame) -> DataFrame:
    """Wettest and driest period per series; the earliest one on ties."""
    known = monthly.filter(F.col("value").isNotNull())
    top = F.min(F.struct((-F.col("value")).alias("v"), "year", "month"))
    low = F.min(F.struct(F.col("value").alias("v"), "year", "month"))
    return (
        known.groupBy("series_id")
        .agg(top.alias("top"), low.alias("low"))
        .select(
            "series_id",
            F.col("top.year").alias("wettest_year"),
            F.col("top.month").alias("wettest_month"),
            (-F.col("top.v")).alias("wettest_value"),
            F.col("low.year").alias("driest_year"),
            F.col("low.month").alias("driest_month"),
            F.col("low.v").alias("driest_value"),
        )
    )


def seasonal_profile(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("series_id", "month").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )


def seasonality_by_month(monthly: DataFrame) -> DataFrame:
    stats = monthly.groupBy("series_id", "month").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return stats.withColumn("cv", F.try_divide("std", "mean"))


def seasonality_strength(monthly: DataFrame) -> DataFrame:
    """Mean coefficient of variation over the months of the year; above one half is strong."""
    return (
        seasonality_by_month(monthly)
        .groupBy("series_id")
        .agg(F.avg("cv").alias("mean_cv"))
        .withColumn("strength", F.when(F.col("mean_cv") > 0.5, "strong").otherwise("weak"))
    )


def seasonal_ratio(monthly: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Largest month mean over smallest; beyond the threshold the series counts as seasonal."""
    means = monthly.groupBy("series_id", "month").agg(F.avg("value").alias("mean"))
    return (
        means.groupBy("series_id")
        .agg(F.try_divide(F.max("mean"), F.min("mean")).alias("ratio"))
        .withColumn("is_seasonal", F.coalesce(F.col("ratio") > threshold, F.lit(False)))
    )


def top_and_bottom_months(monthly: DataFrame, n: int = 3) -> DataFrame:
    """The n months of the year with the highest and the lowest mean, earlier month first on ties."""
    means = monthly.groupBy("series_id", "month").agg(F.avg("value").alias("mean"))
    high = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("mean"), "month"))
    low = F.row_number().over(Window.partitionBy("series_id").orderBy("mean", "month"))
    ranked = means.select("*", high.alias("high"), low.alias("low"))
    sides = F.array(
        F.struct(F.lit("highest").alias("side"), F.col("high").alias("rank")),
        F.struct(F.lit("lowest").alias("side"), F.col("low").alias("rank")),
    )
    return ranked.select("series_id", "month", "mean", F.inline(sides)).filter(F.col("rank") <= n)


def dashboard_kpis(monthly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, average and range of the value, and the average of each covariate."""
    return monthly.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.round(F.avg("value"), 2).alias("avg_value"),
        F.round(F.max("value"), 2).alias("max_value"),
        F.round(F.min("value"), 2).alias("min_value"),
        *[F.round(F.avg(c), 1).alias(f"avg_{c}") for c in covariate_columns(monthly)],
    )


def same_month_history(monthly: DataFrame) -> DataFrame:
    """Per series and month of year, the (year, value) points in year order.

    The list holds one point per year of a monthly frame.
    """
    return monthly.groupBy("series_id", "month").agg(
        F.sort_array(F.collect_list(F.struct("year", "value"))).alias("points")
    )


def latest_same_month(monthly: DataFrame) -> DataFrame:
    """Last year's value of each month of year, and the true mean beside it."""
    return monthly.groupBy("series_id", "month").agg(
        F.max("year").alias("latest_year"),
        F.max_by("value", "year").alias("latest_value"),
        F.avg("value").alias("mean_value"),
    )
