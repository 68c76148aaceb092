"""Typed table scans and the adapters that shape a table into a series panel.

A panel has one row per (series_id, date). ``daily_series`` establishes that by
aggregating on the full key, so the shuffle spreads a busy series over its dates and
map-side partial sums shrink it first. From there on a series holds at most one row
per calendar day, which is what bounds every per-series window in this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED_COVARIATES = ["temperature", "humidity", "wind_speed"]
OPTIONAL_COVARIATES = ["cloud_cover", "surface_pressure"]

COVARIATE_SCHEMA = (
    "series_id STRING, date DATE, temperature DOUBLE, humidity DOUBLE, wind_speed DOUBLE, "
    "cloud_cover DOUBLE, surface_pressure DOUBLE"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Typed CSV scan. The schema is given, so no pass over the file infers it."""
    return spark.read.schema(schema).option("header", header).option("dateFormat", "yyyy-MM-dd").csv(path)


def covariate_columns(df: DataFrame) -> list[str]:
    """The covariates a frame carries: the required ones, then whichever optional ones exist."""
    return [c for c in REQUIRED_COVARIATES + OPTIONAL_COVARIATES if c in df.columns]


def daily_series(df: DataFrame, series: str | Column, date: str | Column, value: Column) -> DataFrame:
    """One row per (series_id, date). ``value`` is an aggregate expression."""
    s = F.col(series) if isinstance(series, str) else series
    d = F.col(date) if isinstance(date, str) else date
    return (
        df.groupBy(s.cast("string").alias("series_id"), d.cast("date").alias("date"))
        .agg(value.alias("value"))
        .filter(F.col("series_id").isNotNull() & F.col("date").isNotNull())
    )
