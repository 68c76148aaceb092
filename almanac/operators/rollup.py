"""Calendar roll-ups and climatologies.

All are plain grouped aggregates: partial on the map side, final after one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.sources.tables import covariate_columns


def _date(date: str | Column) -> Column:
    return F.col(date) if isinstance(date, str) else date


def monthly_sum(df: DataFrame, value: str = "value", date: str = "date", digits: int | None = None) -> DataFrame:
    """Observations to (series_id, year, month) totals. Rows without a series or a date belong to none."""
    total = F.sum(value)
    known = df.filter(F.col("series_id").isNotNull() & F.col(date).isNotNull())
    return known.groupBy(
        "series_id",
        F.year(date).cast("int").alias("year"),
        F.month(date).cast("int").alias("month"),
    ).agg((total if digits is None else F.round(total, digits)).alias("value"))


def monthly_means(df: DataFrame, columns: list[str] | None = None, date: str = "date") -> DataFrame:
    """Covariates to monthly means; optional ones only where the frame has them."""
    columns = columns or covariate_columns(df)
    return df.groupBy(
        "series_id",
        F.year(date).cast("int").alias("year"),
        F.month(date).cast("int").alias("month"),
    ).agg(*[F.avg(c).alias(c) for c in columns])


def yearly_totals(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("series_id", "year").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def month_climatology(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean by month of year, for the months that occur."""
    columns = columns or ["value"]
    return df.groupBy("series_id", "month").agg(*[F.avg(c).alias(c) for c in columns])


def dense_month_climatology(df: DataFrame, digits: int = 2) -> DataFrame:
    """All twelve months per series; a month without data shows 0.

    The twelve slots come from one conditional aggregate per month, so filling the gaps
    needs no second pass over the data and no join.
    """
    means = df.groupBy("series_id").agg(
        *[F.avg(F.when(F.col("month") == m, F.col("value"))).alias(f"m{m}") for m in range(1, 13)]
    )
    slots = F.array(
        *[F.struct(F.lit(m).alias("month"), F.col(f"m{m}").alias("mean")) for m in range(1, 13)]
    )
    return means.select("series_id", F.inline(slots)).select(
        "series_id", "month", F.round(F.coalesce("mean", F.lit(0.0)), digits).alias("value")
    )


def day_climatology(df: DataFrame, columns: list[str] | None = None, date: str = "date") -> DataFrame:
    """Mean by day of year."""
    columns = columns or ["value"]
    return df.groupBy("series_id", F.dayofyear(date).cast("int").alias("day_of_year")).agg(
        *[F.avg(c).alias(c) for c in columns]
    )


def year_month_matrix(monthly: DataFrame) -> DataFrame:
    """One row per year, one column per month. Naming the months saves the pivot a distinct job."""
    wide = monthly.groupBy("series_id", "year").pivot("month", list(range(1, 13))).agg(F.avg("value"))
    return wide.select("series_id", "year", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])
