"""The whole run: tables from observations, then the monthly and the daily models.

Each step reads the tables of the one before, so it can be repeated by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.calendar import BASE_YEAR
from almanac.operators.metrics import regression_metrics
from almanac.operators.relate import daily_with_covariates, monthly_with_covariates
from almanac.operators.rollup import monthly_means, monthly_sum
from almanac.operators.split import chronological_split
from almanac.operators.windows import DAILY_ORDER, MONTHLY_ORDER
from almanac.plans import features as X
from almanac.plans import training
from almanac.plans.autoregression import seasonal_predictions
from almanac.sources.sinks import merge_metrics, overwrite_metrics, read_metrics, write_table

Make = Callable[[], Estimator]

MONTHLY_MODELS: dict[str, Make] = {
    "gradient_boosting_weather": training.gradient_boosting,
    "random_forest_weather": training.random_forest,
}
# Feature variant and estimator of each daily model.
DAILY_MODELS: dict[str, tuple[str, Make]] = {
    "daily_gradient_boosting": ("basic", lambda: training.gradient_boosting(200, 0.1, 5, 4, 0.8)),
    "daily_random_forest": ("basic", lambda: training.random_forest(50, 8, 4, "all")),
    "daily_xgboost": ("basic", lambda: training.subsampled_boosting(100, 0.1, 5, 5)),
    "daily_xgboost_simple": ("simple", lambda: training.subsampled_boosting(200, 0.1, 5, 5)),
}
# Members of the two ensembles.
VOTING: dict[str, Make] = {
    "boosted": lambda: training.gradient_boosting(150, 0.1, 5, 1, 1.0),
    "forest": lambda: training.random_forest(100, 8, 1, "all"),
    "subsampled": lambda: training.subsampled_boosting(150, 0.1, 5, 1),
}
STACKING: dict[str, Make] = {
    "boosted": lambda: training.gradient_boosting(200, 0.1, 6, 1, 1.0),
    "forest": lambda: training.random_forest(100, 10, 1, "all"),
    "subsampled": lambda: training.subsampled_boosting(200, 0.1, 6, 1),
}


def prepare_tables(observations: DataFrame, covariates: DataFrame | None, folder: str) -> None:
    """Write ``monthly``, ``daily_combined`` and, when there are covariates, ``monthly_combined``.

    ``observations`` is a daily panel (series_id, date, value).
    """
    spark = observations.sparkSession
    write_table(daily_with_covariates(observations, covariates), f"{folder}/daily_combined", partition_by=["year"])
    write_table(monthly_sum(observations), f"{folder}/monthly")
    if covariates is not None:
        monthly = spark.read.parquet(f"{folder}/monthly")
        write_table(monthly_with_covariates(monthly, monthly_means(covariates)), f"{folder}/monthly_combined")


def _split_metrics(predictions: DataFrame, actual: str = "value") -> dict[str, float | None]:
    row = regression_metrics(predictions.filter(F.col("split") == "test"), ["split"], actual).first()
    return {"mae": row["mae"], "rmse": row["rmse"], "r2_score": row["r2"]} if row else {}


def train_monthly(spark: SparkSession, folder: str, models: dict[str, Make] | None = None) -> DataFrame:
    """Train the monthly models and the seasonal one, save their bundles and start a new metrics table."""
    panel = spark.read.parquet(f"{folder}/monthly_combined").drop("date")
    base_year = panel.agg(F.min("year")).first()[0]
    frame = training.training_rows(X.monthly_features(panel, base_year=base_year))
    rows = None
    for key, make in (models or MONTHLY_MODELS).items():
        trained, _ = training.train_and_evaluate(frame, X.feature_columns(frame), make(), base_year, MONTHLY_ORDER)
        training.save_bundle(trained, f"{folder}/models/{key}", spark)
        row = training.metrics_row(spark, key, trained.metrics)
        rows = row if rows is None else rows.unionByName(row)
    frame.unpersist()
    seasonal = training.metrics_row(spark, "sarimax", _split_metrics(seasonal_predictions(panel)))
    overwrite_metrics(rows.unionByName(seasonal), f"{folder}/metrics")
    return read_metrics(spark, f"{folder}/metrics")


def _add_metrics(spark: SparkSession, folder: str, fresh: DataFrame) -> DataFrame:
    """Merge rows into the metrics table, which stays as it was until the merge is complete."""
    merge_metrics(fresh, f"{folder}/metrics")
    return read_metrics(spark, f"{folder}/metrics")


def _daily_frame(spark: SparkSession, folder: str, variant: str) -> DataFrame:
    daily = spark.read.parquet(f"{folder}/daily_combined").drop("year", "month", "day")
    return X.daily_features(daily, X.DAILY_SPECS[variant])


def train_daily(spark: SparkSession, folder: str, models: dict[str, tuple[str, Make]] | None = None) -> DataFrame:
    """Train the daily models, save their bundles and merge their metrics into the table."""
    fresh = None
    for key, (variant, make) in (models or DAILY_MODELS).items():
        frame = _daily_frame(spark, folder, variant)
        trained, _ = training.train_and_evaluate(frame, X.feature_columns(frame), make(), BASE_YEAR, DAILY_ORDER)
        trained.variant = variant
        training.save_bundle(trained, f"{folder}/models/{key}", spark)
        row = training.metrics_row(spark, key, trained.metrics)
        fresh = row if fresh is None else fresh.unionByName(row)
    return _add_metrics(spark, folder, fresh)


def train_ensembles(
    spark: SparkSession, folder: str, voting: dict[str, Make] | None = None, stacking: dict[str, Make] | None = None,
    selected: int = 50,
) -> DataFrame:
    """Train the voting and the stacking ensemble; the latter on the features picked on its train rows."""
    fresh = None
    for key, variant, members in (
        ("daily_ensemble", "ensemble", voting or VOTING), ("daily_stacking", "advanced", stacking or STACKING)
    ):
        frame = _daily_frame(spark, folder, variant)
        rows = training.training_rows(chronological_split(frame, DAILY_ORDER))
        train = rows.filter(F.col("split") == "train")
        features = X.feature_columns(frame)
        estimators = {name: make() for name, make in members.items()}
        if key == "daily_ensemble":
            model = training.fit_voting(train, features, estimators)
        else:
            features = training.select_features(train, features, selected)
            model = training.fit_stacking(train, features, estimators, DAILY_ORDER)
        model.save(f"{folder}/models/{key}")
        row = training.metrics_row(spark, key, _split_metrics(model.predict(rows)))
        rows.unpersist()
        fresh = row if fresh is None else fresh.unionByName(row)
    return _add_metrics(spark, folder, fresh)
