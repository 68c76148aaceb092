import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators.split import hashed_split
from almanac.operators.windows import MONTHLY_ORDER
from almanac.plans import jobs, scoring, training
from almanac.plans import features as X
from almanac.sources import sinks


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four years of two seasonal daily series with covariates, prepared as tables."""
    rng = np.random.default_rng(29)
    rows = []
    for s, level in (("a", 10.0), ("b", 30.0)):
        for i in range(4 * 365):
            season = np.sin(2 * np.pi * i / 365.25)
            temperature, humidity, wind = 20 + 5 * season + rng.normal(), 60 + rng.normal(), 5 + rng.normal()
            value = max(0.0, level + 4 * season + rng.normal())
            rows.append((s, dt.date(2001, 1, 1) + dt.timedelta(days=i), float(value), float(temperature), float(humidity), float(wind)))
    all_rows = spark.createDataFrame(
        rows, "series_id string, date date, value double, temperature double, humidity double, wind_speed double"
    )
    path = str(tmp_path_factory.mktemp("run"))
    jobs.prepare_tables(all_rows.select("series_id", "date", "value"), all_rows.drop("value"), path)
    return path


def small_forest():
    return training.random_forest(trees=3, depth=3, leaf=1, features="all")


def test_tables(spark, folder):
    assert spark.read.parquet(f"{folder}/monthly").count() == 96
    combined = spark.read.parquet(f"{folder}/monthly_combined")
    assert combined.count() == 96 and "temperature" in combined.columns and "cloud_cover" not in combined.columns
    assert spark.read.parquet(f"{folder}/daily_combined").filter("year = 2002").count() == 730


def test_without_covariates(spark, daily, tmp_path):
    jobs.prepare_tables(daily({"a": range(40)}), None, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/daily_combined").count() == 40
    assert not (tmp_path / "monthly_combined").exists()


def test_training_steps_fill_one_metrics_table(spark, folder):
    first = jobs.train_monthly(spark, folder, {"random_forest_weather": small_forest, "linear": training.linear})
    assert {r.model_key for r in first.collect()} == {"random_forest_weather", "linear", "sarimax"}
    both = jobs.train_daily(spark, folder, {"daily_random_forest": ("sequence", small_forest)})
    assert {r.model_key for r in both.collect()} == {"random_forest_weather", "linear", "sarimax", "daily_random_forest"}
    members = {"f": small_forest, "l": small_forest}
    final = {r.model_key: r for r in jobs.train_ensembles(spark, folder, members, members, selected=8).collect()}
    assert {"daily_ensemble", "daily_stacking", "sarimax"} <= set(final)
    assert final["daily_ensemble"].r2_score > 0.5
    loaded = training.Stacking.load(f"{folder}/models/daily_stacking", ["f", "l"])
    assert set(loaded.models) == {"f", "l"}
    bundle = training.load_bundle(f"{folder}/models/daily_random_forest", spark)
    assert bundle.metrics["mae"] > 0


def test_random_hold_out(spark, folder):
    frame = spark.read.parquet(f"{folder}/monthly")
    split = hashed_split([F.col("series_id"), F.col("year"), F.col("month")], 42)
    _, report = training.train_and_evaluate(frame, ["year", "month"], small_forest(), 2001, MONTHLY_ORDER, split)
    sizes = {r.split: r.n for r in report.collect()}
    assert sum(sizes.values()) == 96 and 5 < sizes["test"] < 40


def test_requests_are_checked_routed_scored_and_kept(spark, folder, tmp_path):
    jobs.train_monthly(spark, folder, {"gradient_boosting_weather": training.linear, "random_forest_weather": small_forest})
    jobs.train_daily(spark, folder, {"daily_random_forest": ("basic", training.linear), "daily_xgboost": ("simple", training.linear)})
    rows = [
        (1, "a", 2005, 3, None, "gradient_boosting_weather"), (2, "a", 2005, 3, None, "random_forest_weather"),
        (3, "b", 2005, 1, 9, "daily_random_forest"), (4, "b", 2005, 1, 9, "daily_xgboost"), (5, "b", 2005, 1, 10, "daily_random_forest"),
        (6, "a", 1900, 1, None, "sarimax"), (7, "a", 2005, 2, 30, "daily_xgboost"), (8, "a", 2005, 2, None, "unknown"),
        (9, "new", 2005, 2, None, "gradient_boosting_weather"), (10, None, 2005, 2, None, "gradient_boosting_weather"),
        (11, "a", 2005, 2, None, "sarimax"), (11, "a", 2005, 2, None, "sarimax"), (12, "a", None, None, None, None),
    ]
    asked = spark.createDataFrame(rows, "request_id long, series_id string, year int, month int, day int, model_key string")
    out = {}
    for r in scoring.score_requests(spark, asked, folder, F.lit(7).cast("long")).collect():
        out.setdefault(r.request_id, []).append(r)
    assert {k: len(v) for k, v in out.items()} == {**dict.fromkeys(range(1, 13), 1), 11: 2}
    scored = {k for k, v in out.items() if v[0].predicted is not None}
    assert scored == {1, 2, 3, 4, 5, 9}
    assert all((r.predicted is None) != (r.reason is None) for v in out.values() for r in v)
    assert out[11][0].reason == "model is not stored" and out[10][0].reason == "no series named"
    assert out[1][0].predicted != out[2][0].predicted and out[3][0].predicted != out[4][0].predicted
    # Both series have a level of their own, which the daily models know from the lags.
    assert abs(out[3][0].predicted - 30) < 6
    history = sinks.read_history(spark, f"{folder}/history")
    assert history.count() == 6 and history.where("user_id = 7").count() == 6


def test_every_daily_variant_has_its_features_at_serving_time(spark, folder):
    daily = spark.read.parquet(f"{folder}/daily_combined").drop("year", "month", "day")
    last = daily.groupBy("series_id").agg(F.max("date").alias("date"))
    cells = last.select("series_id", F.explode(F.sequence(F.date_add("date", 1), F.date_add("date", 9))).alias("date"))
    for variant, spec in X.DAILY_SPECS.items():
        trained = X.feature_columns(X.daily_features(daily, spec))
        asked = scoring.daily_request_features(cells, daily, spec, 2001)
        assert set(trained) <= set(asked.columns), variant
        assert asked.count() == 18
    # A day that has been observed gets the features that it had in training.
    known = daily.where("date = '2004-06-01'").select("series_id", "date")
    a = scoring.daily_request_features(known, daily, X.DAILY_SPECS["advanced"], 2001)
    b = X.daily_features(daily, X.DAILY_SPECS["advanced"], 2001).join(known, ["series_id", "date"]).select(*a.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_a_missing_feature_is_an_error(spark, folder):
    trained = training.Trained(None, ["value_lag_1", "unheard_of"], 2001, {})
    with pytest.raises(ValueError, match="unheard_of"):
        training.score(trained, spark.range(1).withColumn("value_lag_1", F.lit(1.0)), ["id"], strict=True)
