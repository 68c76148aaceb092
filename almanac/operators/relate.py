"""Joins between observations, covariates and lookups.

Sides are never hinted: which side is small depends on the number of series, so AQE decides
from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.calendar import date_parts
from almanac.functions.scoring import accuracy_percent, accuracy_with_fallback
from almanac.sources.tables import covariate_columns


def join_series(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the series, rows without one meeting each other."""
    own = right.withColumnRenamed("series_id", "right_series")
    return left.join(own, left["series_id"].eqNullSafe(own["right_series"]), how).drop("right_series")


def daily_with_covariates(daily: DataFrame, covariates: DataFrame | None = None) -> DataFrame:
    """Observations with their covariates of the same day, plus year, month and day.

    Without covariates the observations pass through alone.
    """
    joined = daily if covariates is None else daily.join(covariates, ["series_id", "date"], "inner")
    parts = date_parts("date")
    return joined.select("*", *[parts[p].alias(p) for p in ("year", "month", "day")])


def monthly_with_covariates(monthly: DataFrame, monthly_covariates: DataFrame) -> DataFrame:
    """Monthly totals with monthly covariate means. Both sides are aggregated before they meet."""
    joined = monthly.join(monthly_covariates, ["series_id", "year", "month"], "inner")
    return joined.withColumn("date", F.make_date("year", "month", F.lit(1)))


def covariate_lookup(requests: DataFrame, monthly: DataFrame) -> DataFrame:
    """Month-of-year covariate means for each request; they also fill the lag and average slots."""
    columns = covariate_columns(monthly)
    normals = monthly.groupBy("series_id", "month").agg(*[F.avg(c).alias(c) for c in columns])
    # Few distinct (series, month) cells are asked for, often many times over: AQE broadcasts
    # the normals when they fit and splits hot cells when they do not.
    return requests.join(normals, ["series_id", "month"], "left")


def fallback_merge(registry: DataFrame, primary: DataFrame, secondary: DataFrame, average: DataFrame | None = None) -> DataFrame:
    """Metrics by field: the primary store's value, else the secondary's.

    ``registry`` lists (model_key, name). Models that only the secondary store knows are
    added when their key starts with ``daily_``, under a name made from the key.
    """
    fields = ["mae", "rmse", "r2_score", "accuracy_percent"]
    p = primary.select("model_key", *[F.col(c).alias(f"p_{c}") for c in fields])
    s = secondary.select("model_key", *[F.col(c).alias(f"s_{c}") for c in fields])
    known = registry.join(p, "model_key", "left").join(s, "model_key", "left")
    if average is not None:
        known = known.join(average, "model_key", "left")
    else:
        known = known.withColumn("average", F.lit(None).cast("double"))
    from_primary = accuracy_with_fallback(F.col("p_r2_score"), F.col("p_mae"), F.col("average"))
    r2 = F.coalesce("p_r2_score", "s_r2_score")
    merged = known.select(
        "model_key",
        "name",
        F.round(F.coalesce("p_mae", "s_mae"), 2).alias("mae"),
        F.round(F.coalesce("p_rmse", "s_rmse"), 2).alias("rmse"),
        F.round(r2, 4).alias("r2_score"),
        F.coalesce(
            from_primary,
            F.round("s_accuracy_percent", 1),
            F.when(r2.isNotNull(), accuracy_percent(F.round(r2, 4))),
        ).alias("accuracy_percent"),
    )
    daily = (
        secondary.filter(F.col("model_key").startswith("daily_"))
        .join(registry.select("model_key"), "model_key", "left_anti")
        .select(
            "model_key",
            F.initcap(F.regexp_replace(F.regexp_replace("model_key", "daily_", ""), "_", " ")).alias("name"),
            *fields,
        )
    )
    return merged.unionByName(daily)


def side_by_side(metrics: DataFrame, asked: DataFrame) -> DataFrame:
    """Metrics of the two models each row of ``asked`` (series_id, model_a, model_b) names.

    Both names are looked up in one join and brought back to one row.
    """
    fields = ["mae", "rmse", "r2"]
    pair = ["series_id", "model_a", "model_b"]
    sides = F.array(
        *[F.struct(F.lit(t).alias("side"), F.col(f"model_{t}").alias("model_key")) for t in ("a", "b")]
    )
    found = (
        asked.select(*pair, F.inline(sides))
        .join(metrics.select("series_id", "model_key", *fields), ["series_id", "model_key"], "left")
        .groupBy(*pair)
        .agg(*[F.max(F.when(F.col("side") == t, F.col(m))).alias(f"{m}_{t}") for m in fields for t in ("a", "b")])
    )
    return found.select("*", *[(F.col(f"{m}_a") - F.col(f"{m}_b")).alias(f"{m}_delta") for m in fields])
