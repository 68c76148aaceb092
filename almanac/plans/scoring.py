"""Scoring of forecast requests with stored models.

A request takes the same way whatever became of it: it comes out once, with a prediction or with
the reason why it has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators import relate
from almanac.plans import features as X
from almanac.plans import lookback, training
from almanac.plans.requests import validate
from almanac.sources.sinks import append_history, history_rows, stored
from almanac.sources.tables import covariate_columns


def score_monthly(requests: DataFrame, monthly: DataFrame, trained: training.Trained) -> DataFrame:
    """Each distinct cell (series_id, year, month) is scored once, then joined back to its requests."""
    keys = ["series_id", "year", "month"]
    cells = requests.select(*keys).distinct().dropna()
    known = relate.covariate_lookup(lookback.monthly_lookback(cells, monthly), monthly)
    rows = X.request_features(known, monthly.columns, trained.base_year).na.fill(0.0)
    return lookback.rejoined(requests, training.score(trained, rows, keys, strict=True), keys)


def daily_request_features(cells: DataFrame, daily: DataFrame, spec: X.DailySpec, base_year: int) -> DataFrame:
    """Features of days to come by the function that made the training features.

    Days without observations enter the panel with the normals of their day of year, so that
    requests further ahead look back on normals, not on nothing. What a short history cannot
    fill is 0.
    """
    columns = ["value", *covariate_columns(daily)]
    panel = daily.select("series_id", "date", *columns)
    ahead = (
        cells.join(panel.select("series_id", "date"), ["series_id", "date"], "left_anti")
        .join(lookback.day_normals(daily, columns), "series_id", "left")
        .select("series_id", "date", *[lookback.day_normal(c).alias(c) for c in columns])
    )
    frame = X.daily_features(panel.unionByName(ahead), spec, base_year, drop_incomplete=False)
    return frame.join(cells, ["series_id", "date"], "left_semi").na.fill(0.0)


def score_daily(requests: DataFrame, daily: DataFrame, trained: training.Trained) -> DataFrame:
    """Like ``score_monthly`` for (series_id, date). A model that names its feature variant gets the
    features it was trained with, others those of the daily lookback."""
    keys = ["series_id", "date"]
    cells = requests.select(*keys).distinct().dropna()
    if trained.variant:
        rows = daily_request_features(cells, daily, X.DAILY_SPECS[trained.variant], trained.base_year)
    else:
        rows = X.with_day_fields(lookback.daily_lookback(cells, daily), trained.base_year)
    return lookback.rejoined(requests, training.score(trained, rows, keys, strict=True), keys)


def _bundle(spark: SparkSession, folder: str, key: str) -> training.Trained | None:
    try:
        return training.load_bundle(f"{folder}/models/{key}", spark)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def score_requests(spark: SparkSession, requests: DataFrame, folder: str, user: Column | None = None, batch: str | None = None) -> DataFrame:
    """Check requests (series_id, year, month, day, model_key), score each with the stored model it
    names, and append the scored ones to the history. Returns every request with ``predicted``
    and ``reason``; one of them is NULL.

    A job that may run again names its ``batch``, whose rows reach the history once.
    ``folder`` is that of the training jobs. The models asked for are few: only names that
    pass the check are looked up.
    """
    checked = validate(requests)
    asked = [r[0] for r in checked.where("reason is null").select("model_key").distinct().orderBy("model_key").collect()]
    parts = [checked.where("reason is not null").withColumn("predicted", F.lit(None).cast("double"))]
    for key in asked:
        mine = checked.where(F.col("reason").isNull() & (F.col("model_key") == key))
        trained = _bundle(spark, folder, key)
        if trained is None:
            part = mine.withColumn("predicted", F.lit(None).cast("double")).withColumn("reason", F.lit("model is not stored"))
        elif key.startswith("daily_"):
            daily = spark.read.parquet(f"{folder}/daily_combined").drop("year", "month", "day")
            dated = mine.withColumn("date", F.make_date("year", "month", "day"))
            part = score_daily(dated, daily, trained).drop("date")
        else:
            monthly = spark.read.parquet(f"{folder}/monthly_combined").drop("date")
            part = score_monthly(mine, monthly, trained)
        unknown = F.col("predicted").isNull() & F.col("reason").isNull()
        parts.append(part.withColumn("reason", F.when(unknown, "no series named").otherwise(F.col("reason"))))
    scored = stored(reduce(DataFrame.unionByName, parts), "scored")
    kept = scored.where("predicted is not null")
    append_history(history_rows(kept, user if user is not None else F.lit(None).cast("long"), F.lit(None)), f"{folder}/history", batch)
    return scored
