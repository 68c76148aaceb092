import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from almanac import session
from almanac.operators.relate import daily_with_covariates
from almanac.operators.rollup import monthly_means
from almanac.plans import requests as R
from almanac.session import shared_dir
from almanac.sources import commits, raw, sinks
from almanac.sources.tables import COVARIATE_SCHEMA, covariate_columns, daily_series, read_csv


def test_tolerant_scan_drops_junk(spark, tmp_path):
    lines = [
        "some free text", "more text", "Time,Pr", "1979-01-01 00:00:00,0.0", "1979-01-02 00:00:00,12.5",
        "1979-01-03 07:00:00,3.0", "1979-13-01 00:00:00,4.0", "1979-01-05 00:00:00,n/a", "1979-01-06,4.0",
        "1979-01-07 00:00:00,1.5d", "1979-01-08 00:00:00,NaN", "1979-01-09 00:00:00,",
    ]
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    rows = raw.clean_raw_daily(raw.read_raw_daily(spark, str(tmp_path))).orderBy("date").collect()
    assert [(r.date, r.value) for r in rows] == [
        (dt.date(1979, 1, 1), 0.0), (dt.date(1979, 1, 2), 12.5), (dt.date(1979, 1, 3), 3.0),
    ]


def test_payload_keeps_nulls_and_renames(spark, tmp_path):
    payload = {
        "daily": {
            "time": ["2020-01-01", "2020-01-02"], "temperature_2m_mean": [22.1, None],
            "relative_humidity_2m_mean": [81.0, 79.5], "wind_speed_10m_mean": [9.3, 11.0],
            "cloud_cover_mean": [64.0, 71.0], "surface_pressure_mean": [1013.2, 1012.8],
        }
    }
    (tmp_path / "p.json").write_text(json.dumps(payload, indent=1))
    rows = raw.payload_rows(raw.read_payloads(spark, str(tmp_path))).orderBy("date").collect()
    assert [r.date for r in rows] == [dt.date(2020, 1, 1), dt.date(2020, 1, 2)]
    assert [r.temperature for r in rows] == [22.1, None]
    assert rows[1].surface_pressure == 1012.8


def test_optional_covariates_are_detected(spark):
    three = spark.createDataFrame([], COVARIATE_SCHEMA).drop("cloud_cover", "surface_pressure")
    assert covariate_columns(three) == ["temperature", "humidity", "wind_speed"]
    assert "cloud_cover" not in monthly_means(three).columns


def test_daily_series_is_unique_per_day(spark):
    rows = [("a", dt.datetime(2020, 1, 1, 3), 1.0), ("a", dt.datetime(2020, 1, 1, 9), 2.0), (None, dt.datetime(2020, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "s string, t timestamp, v double")
    assert [tuple(r) for r in daily_series(df, "s", "t", F.sum("v")).collect()] == [("a", dt.date(2020, 1, 1), 3.0)]


def test_without_covariates_rows_pass_through(daily):
    rows = daily_with_covariates(daily({"a": [1, 2]}), None).orderBy("date").collect()
    assert [(r.year, r.month, r.day, r.value) for r in rows] == [(2020, 1, 1, 1.0), (2020, 1, 2, 2.0)]


def test_inner_join_keeps_only_shared_days(spark, daily):
    cov = spark.createDataFrame([("a", dt.date(2020, 1, 2), 20.0, 50.0, 3.0)], "series_id string, date date, temperature double, humidity double, wind_speed double")
    rows = daily_with_covariates(daily({"a": [1, 2, 3], "b": [4]}), cov).collect()
    assert [(r.series_id, r.value, r.temperature) for r in rows] == [("a", 2.0, 20.0)]


def test_partitioned_table_round_trip(spark, monthly, tmp_path):
    df = monthly({"a": range(24), "b": range(24)})
    sinks.write_table(df, str(tmp_path / "t"), partition_by=["year"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter("year = 2001").count() == 24
    assert back.agg(F.sum("value")).first()[0] == df.agg(F.sum("value")).first()[0]


def test_csv_round_trip(spark, monthly, tmp_path):
    df = monthly({"a": range(5)})
    sinks.write_table(df, str(tmp_path / "c"), "csv")
    back = read_csv(spark, str(tmp_path / "c"), "series_id STRING, year INT, month INT, value DOUBLE")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_upsert_replaces_and_keeps(spark):
    old = spark.createDataFrame([("x", 1.0, 1.0, 0.1, 10.0), ("y", 2.0, 2.0, 0.2, 20.0)], sinks.METRICS_SCHEMA)
    new = spark.createDataFrame([("y", 9.0, 9.0, 0.9, 90.0), ("z", 3.0, 3.0, 0.3, 30.0)], sinks.METRICS_SCHEMA)
    assert {r.model_key: r.mae for r in sinks.upsert_metrics(old, new).collect()} == {"x": 1.0, "y": 9.0, "z": 3.0}


def test_overwrite_erases_other_keys(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.overwrite_metrics(spark.createDataFrame([("daily_x", 1.0, 1.0, 0.1, 10.0)], sinks.METRICS_SCHEMA), path)
    sinks.overwrite_metrics(spark.createDataFrame([("y", 2.0, 2.0, None, None)], sinks.METRICS_SCHEMA), path)
    assert [(r.model_key, r.r2_score) for r in sinks.read_metrics(spark, path).collect()] == [("y", None)]


def test_history_appends(spark, tmp_path):
    scored = spark.createDataFrame([(7, 2024, 5, 1.5)], "user bigint, year int, month int, predicted double")
    path = str(tmp_path / "h")
    for _ in range(2):
        sinks.append_history(sinks.history_rows(scored, F.col("user"), F.lit(2.0)), path)
    rows = sinks.read_history(spark, path).collect()
    assert len(rows) == 2 and rows[0].day is None and rows[0].created_at is not None


def test_a_batch_is_appended_once(spark, tmp_path, monkeypatch):
    scored = spark.createDataFrame([(7, 2024, 5, 1.5)], "user bigint, year int, month int, predicted double")
    rows, path = sinks.history_rows(scored, F.col("user"), F.lit(2.0)), str(tmp_path / "h")
    assert sinks.read_history(spark, path).count() == 0
    assert sinks.append_history(rows, path, "may/1") and not sinks.append_history(rows, path, "may/1")
    assert sinks.append_history(rows, path, "may/2")
    assert sinks.read_history(spark, path).count() == 2
    # A job lost between its rows and its marker leaves nothing that counts, and may run again.
    with monkeypatch.context() as m:
        m.setattr(commits, "create_once", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            sinks.append_history(rows, path, "june")
    assert sinks.read_history(spark, path).count() == 2
    assert sinks.append_history(rows, path, "june") and sinks.read_history(spark, path).count() == 3
    # A marker that was never finished names no batch.
    torn = tmp_path / "h" / "batches" / hashlib.sha256(b"july").hexdigest()
    torn.write_text("half")
    assert sinks.read_history(spark, path).count() == 3
    assert sinks.append_history(rows, path, "july") and sinks.read_history(spark, path).count() == 4


def _metrics(spark, key, mae):
    return spark.createDataFrame([(key, mae, mae, 0.5, 50.0)], sinks.METRICS_SCHEMA)


def _held(spark, path):
    return {r.model_key: r.mae for r in sinks.read_metrics(spark, path).collect()}


def test_metrics_survive_a_lost_job(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        sinks.read_metrics(spark, path)
    sinks.merge_metrics(_metrics(spark, "a", 1.0), path)
    with monkeypatch.context() as m:
        m.setattr(commits, "create_once", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        for write in (sinks.merge_metrics, sinks.overwrite_metrics):
            with pytest.raises(OSError, match="lost"):
                write(_metrics(spark, "b", 2.0), path)
    assert _held(spark, path) == {"a": 1.0}
    (tmp_path / "m" / "current" / "00000002").write_text("torn")
    assert _held(spark, path) == {"a": 1.0}
    sinks.merge_metrics(_metrics(spark, "b", 2.0), path)
    assert _held(spark, path) == {"a": 1.0, "b": 2.0}


def test_two_writers_lose_nothing(spark, tmp_path):
    path, calls = str(tmp_path / "m"), []
    sinks.merge_metrics(_metrics(spark, "a", 1.0), path)

    def slow(now):
        calls.append(now)
        merged = sinks.upsert_metrics(spark.read.schema(sinks.METRICS_SCHEMA).json(now), _metrics(spark, "slow", 3.0))
        if len(calls) == 1:
            # Another job merges its rows after this one has read the table.
            sinks.merge_metrics(_metrics(spark, "quick", 2.0), path)
        return merged

    commits.commit(spark, path, slow)
    assert len(calls) == 2 and _held(spark, path) == {"a": 1.0, "quick": 2.0, "slow": 3.0}


def test_request_validation_vectors(spark):
    rows = [
        (1, 2024, 7, None, "sarimax"), (2, 1978, 5, None, "sarimax"), (3, 2101, 5, None, "sarimax"),
        (4, 2024, 0, None, "sarimax"), (5, 2024, 13, None, "sarimax"), (6, 2024, 5, 32, "daily_xgboost"),
        (7, 2023, 2, 30, "daily_xgboost"), (8, 2024, 2, 29, "daily_xgboost"), (9, 2024, 5, None, "unknown"),
        (10, 2024, 5, 3, "sarimax"), (11, None, 5, None, "sarimax"),
    ]
    df = spark.createDataFrame(rows, "id int, year int, month int, day int, model_key string")
    reasons = {r.id: r.reason for r in R.validate(df).collect()}
    assert [i for i, x in reasons.items() if x is None] == [1, 8]
    assert reasons[7] == "no such date" and reasons[10] == "unknown model" and reasons[6] == "day out of range"
    assert R.accepted(df).count() == 2


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session(), "x")
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
