"""Per-series scaling with statistics fitted on chosen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_min_max(df: DataFrame, column: str = "value", rows: Column | None = None) -> DataFrame:
    x = F.col(column) if rows is None else F.when(rows, F.col(column))
    return df.groupBy("series_id").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))


def min_max(column: Column) -> Column:
    """Scaled to 0..1 by the fitted ``lo`` and ``hi``; a constant column becomes 0."""
    return F.coalesce((column - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), column - F.col("lo"))


def inverse_min_max(scaled: Column) -> Column:
    spread = F.col("hi") - F.col("lo")
    return scaled * F.when(spread == 0, F.lit(1.0)).otherwise(spread) + F.col("lo")


def fit_standard(df: DataFrame, column: str = "value", rows: Column | None = None) -> DataFrame:
    x = F.col(column) if rows is None else F.when(rows, F.col(column))
    return df.groupBy("series_id").agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"))


def standard(column: Column) -> Column:
    """Centred and divided by the population deviation; a constant column becomes 0."""
    centred = column - F.col("mu")
    return centred / F.when(F.col("sigma") == 0, F.lit(1.0)).otherwise(F.col("sigma"))


def univariate_f_scores(df: DataFrame, features: list[str], target: str = "value") -> DataFrame:
    """F statistic of each feature's linear relation to the target: one pass, one row per feature."""
    one = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.corr(c, target).alias(f"r{i}") for i, c in enumerate(features)]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(features)])
    r2 = F.col("r") * F.col("r")
    return one.select("n", F.inline(rows)).select(
        "feature", F.try_divide(r2, 1 - r2).alias("ratio"), "n"
    ).select("feature", (F.col("ratio") * (F.col("n") - 2)).alias("f_score"))
