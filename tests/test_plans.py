import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from almanac.operators import split
from almanac.operators.windows import DAILY_ORDER
from almanac.plans import autoregression as A
from almanac.plans import features as X
from almanac.plans import forecasts, lookback, stationarity, training, tuning
from almanac.session import shared_dir


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


# --- Feature frames ---------------------------------------------------------------------


def test_variants_use_the_covariates_they_find(spark, daily):
    df = daily({"a": range(60)})
    plain = X.daily_features(df, X.DAILY_SPECS["advanced"])
    assert not [c for c in plain.columns if "temp" in c or "humidity" in c]
    with_two = df.withColumn("temperature", F.col("value")).withColumn("humidity", F.lit(3.0)).withColumn("wind_speed", F.lit(1.0))
    named = X.daily_features(with_two, X.DAILY_SPECS["advanced"])
    assert "temp_humidity_ratio_lag_1" in named.columns and "cloud_humidity" not in named.columns
    assert plain.count() == 30


@pytest.mark.parametrize("variant", list(X.DAILY_SPECS))
def test_daily_features_do_not_leak_the_target(daily, variant):
    values = list(np.random.default_rng(2).integers(0, 50, 45))
    last = dt.date(2020, 1, 1) + dt.timedelta(days=44)

    def at_end(v):
        df = X.daily_features(daily({"a": v}), X.DAILY_SPECS[variant])
        row = df.filter(F.col("date") == F.lit(last)).first().asDict()
        row.pop("value")
        return row

    assert at_end(values) == at_end(values[:-1] + [10_000])


def test_leaking_changes_are_available(daily):
    df = X.daily_features(daily({"a": range(0, 80, 2)}), X.DAILY_SPECS["advanced"], leak_current=True)
    assert {r.value_change_7 for r in df.collect()} == {14.0}


def test_monthly_rolling_means(monthly):
    df = monthly({"a": range(15)})
    past = X.monthly_features(df).orderBy("year", "month").first()
    current = X.monthly_features(df, past_only=False).orderBy("year", "month").first()
    assert (past.value, past.value_lag_12, past.value_ma_3, past.trend) == (12.0, 0.0, 10.0, 12)
    assert current.value_ma_3 == 11.0


def test_align_fills_absent_features_with_zero(monthly):
    row = monthly({"a": [3]}).select(*X.align_features(monthly({"a": [3]}), ["value", "nothing"])).first()
    assert tuple(row) == (3.0, 0.0)


# --- Lookback rules ---------------------------------------------------------------------


def ask(spark, *cells):
    return spark.createDataFrame([("a", y, m) for y, m in cells], "series_id string, year int, month int")


def test_monthly_lookback_with_full_history(spark, monthly):
    out = by(lookback.monthly_lookback(ask(spark, (2002, 1), (2001, 6)), monthly({"a": range(24)})), "year", "month")
    jan = out[(2002, 1)]
    assert (jan.value_lag_1, jan.value_lag_12, jan.value_ma_3) == (23.0, 12.0, 22.0)
    assert jan.value_ma_12 == 6.0
    june = out[(2001, 6)]
    assert (june.value_lag_1, june.value_lag_12, june.value_ma_12) == (16.0, 5.0, 11.0)


def test_monthly_lookback_far_ahead_uses_normals(spark, monthly):
    row = lookback.monthly_lookback(ask(spark, (2030, 2)), monthly({"a": range(24)})).first()
    assert (row.value_lag_1, row.value_lag_12, row.value_ma_12) == (6.0, 7.0, 7.0)
    assert row.value_ma_3 == pytest.approx((6 + 17 + 16) / 3)


def test_monthly_lookback_of_a_month_never_seen(spark, monthly):
    history = monthly({"a": {(2000, 1): 2, (2001, 1): 4, (2000, 2): 9}})
    row = lookback.monthly_lookback(ask(spark, (2000, 7)), history).first()
    overall = (3 + 9) / 2
    assert (row.value_ma_12, row.value_lag_1, row.value_ma_3) == (overall, overall, overall)


def test_monthly_lookback_needs_two_of_three(spark, monthly):
    one = lookback.monthly_lookback(ask(spark, (2000, 5)), monthly({"a": {(2000, 4): 8, (1999, 3): 2, (1999, 2): 5}})).first()
    assert one.value_lag_1 == 8.0 and one.value_ma_3 == pytest.approx((8 + 2 + 5) / 3)
    two = lookback.monthly_lookback(ask(spark, (2000, 5)), monthly({"a": {(2000, 4): 8, (2000, 2): 5}})).first()
    assert two.value_ma_3 == 6.5


def test_unknown_series_gets_zeros(spark, monthly):
    row = lookback.monthly_lookback(ask(spark, (2000, 5)), monthly({"b": range(12)})).first()
    assert (row.value_lag_1, row.value_ma_3) == (0.0, 0.0)


def test_requests_are_not_dropped_or_doubled(spark, monthly):
    many = ask(spark, *[(2001, 3)] * 50, *[(2001, 4)] * 2)
    assert lookback.monthly_lookback(many, monthly({"a": range(24)})).count() == 52


def test_requests_with_missing_keys_stay(spark, monthly, daily):
    rows = [(1, "a", 2001, 3), (2, None, 2001, 3), (3, "a", None, 3), (4, "unknown", 2001, 3), (5, None, None, None), (5, None, None, None)]
    asked = spark.createDataFrame(rows, "request_id long, series_id string, year int, month int")
    out = lookback.monthly_lookback(asked, monthly({"a": range(24)}))
    assert sorted(r.request_id for r in out.collect()) == [1, 2, 3, 4, 5, 5]
    assert out.columns[:4] == asked.columns
    days = [(1, "a", dt.date(2020, 1, 9)), (2, None, dt.date(2020, 1, 9)), (3, "a", None), (4, None, None)]
    asked = spark.createDataFrame(days, "request_id long, series_id string, date date")
    assert sorted(r.request_id for r in lookback.daily_lookback(asked, daily({"a": list(range(20))})).collect()) == [1, 2, 3, 4]


def test_daily_lookback(spark, daily):
    history = daily({"a": list(range(40))}).withColumn("temperature", F.col("value") + 100).withColumn("humidity", F.lit(50.0)).withColumn("wind_speed", F.lit(2.0))
    days = [dt.date(2020, 2, 10), dt.date(2020, 1, 2), dt.date(2020, 1, 5), dt.date(2021, 1, 5), dt.date(2021, 7, 1)]
    asked = spark.createDataFrame([("a", d) for d in days], "series_id string, date date")
    out = by(lookback.daily_lookback(asked, history), "date")
    feb = out[(days[0],)]
    assert (feb.value_lag_1, feb.value_lag_7, feb.value_lag_30, feb.value_ma_7) == (39.0, 33.0, 10.0, 36.0)
    assert feb.temperature_lag_1 == 139.0 and feb.temperature_ma_7 == pytest.approx(100 + 19.5)
    second = out[(days[1],)]
    assert second.value_lag_1 == 0.0 and second.value_ma_7 == 1.0
    fifth = out[(days[2],)]
    assert fifth.value_ma_7 == pytest.approx(1.5) and fifth.value_lag_7 == 4.0
    year_later = out[(days[3],)]
    assert year_later.value_lag_1 == 4.0 and year_later.value_ma_7 == 36.0
    unseen_day = out[(days[4],)]
    assert unseen_day.value_lag_1 == pytest.approx(19.5) and unseen_day.humidity_lag_1 == 50.0


# --- Forecasts --------------------------------------------------------------------------


def test_trend_needs_five_rows(spark, monthly):
    five = monthly({"a": {(2000 + i, 7): 10 + 2 * i for i in range(5)}})
    four = monthly({"a": {(2000 + i, 7): 10 + 2 * i for i in range(4)}})
    asked = ask(spark, (2024, 7))
    assert forecasts.climatology_trend_forecast(asked, five).first().predicted == pytest.approx(10 + 2 * 24, rel=1e-6)
    assert forecasts.climatology_trend_forecast(asked, four).first().predicted == pytest.approx(13 * (1 + 0.004 * 4))
    assert forecasts.climatology_trend_forecast(ask(spark, (2024, 8)), five).first().predicted == pytest.approx(101.6)


def test_forecast_is_never_negative(spark, monthly):
    falling = monthly({"a": {(2000 + i, 7): 100 - 20 * i for i in range(6)}})
    assert forecasts.climatology_trend_forecast(ask(spark, (2030, 7)), falling).first().predicted == 0.0


@pytest.mark.parametrize("level,z", [(0.9, 1.6448536), (0.95, 1.9599640), (0.99, 2.5758293)])
def test_intervals(spark, level, z):
    points = spark.createDataFrame([("a", 5.0), ("b", 1.0)], "series_id string, predicted double")
    spread = spark.createDataFrame([("a", 1.0), ("b", 9.0)], "series_id string, std_error double")
    out = by(forecasts.with_interval(points, spread, level), "series_id")
    assert out[("a",)].margin_of_error == pytest.approx(z, abs=0.005)
    assert out[("b",)].lower_bound == 0.0
    assert all(r.lower_bound <= r.point_estimate <= r.upper_bound for r in out.values())


def test_month_range(spark):
    df = spark.createDataFrame([("a", 2024, 1, 12), ("b", 2024, 5, 5), ("c", 2024, 6, 5)], "series_id string, year int, start_month int, end_month int")
    out = forecasts.month_range(df).collect()
    assert len(out) == 13 and {r.series_id for r in out} == {"a", "b"}


def test_backtest_uses_train_rows_only(monthly):
    values = [float(i % 12) for i in range(60)]
    a = forecasts.backtest_baselines(monthly({"a": values})).filter("model_key = 'climatology'").orderBy("year", "month").collect()
    b = forecasts.backtest_baselines(monthly({"a": values[:48] + [999.0] * 12})).filter("model_key = 'climatology'").orderBy("year", "month").collect()
    assert [r.predicted for r in a] == [r.predicted for r in b] and len(a) == 12


# --- Autoregression ---------------------------------------------------------------------


def test_ar1_against_brute_force(monthly):
    y = np.random.default_rng(7).normal(0, 3, 50).cumsum() + 50
    row = A.ar1_report(monthly({"a": y})).first()
    train, test = y[:40], y[40:]
    diff = np.diff(train)
    phi, const = np.polyfit(diff[:-1], diff[1:], 1)
    assert row.phi == pytest.approx(phi) and row.const == pytest.approx(const)
    fitted = train[1:-1] + const + phi * diff[:-1]
    assert row.train_mae == pytest.approx(np.mean(np.abs(train[2:] - fitted)))
    value, step, ahead = train[-1], diff[-1], []
    for _ in test:
        step = const + phi * step
        value += step
        ahead.append(value)
    assert row.test_mae == pytest.approx(np.mean(np.abs(test - ahead)))
    assert row.test_rmse == pytest.approx(math.sqrt(np.mean((test - ahead) ** 2)))


def brute_seasonal(train):
    z = np.diff(train)[12:] - np.diff(train)[:-12]
    target, design = z[12:], np.column_stack([np.ones(len(z) - 12), z[11:-1], z[:-12]])
    coef = np.linalg.lstsq(design, target, rcond=None)[0]
    return coef, float(np.sum((target - design @ coef) ** 2)), len(target)


def test_seasonal_fit_and_forecast_against_brute_force(monthly):
    rng = np.random.default_rng(11)
    y = 50 + 10 * np.sin(np.arange(100) * 2 * np.pi / 12) + rng.normal(0, 2, 100).cumsum()
    df = monthly({"a": y, "short": y[:20]})
    train = y[:80]
    (const, b1, b2), sse, n = brute_seasonal(train)
    fit = by(A.seasonal_fit(A.seasonal_rows(df)), "series_id")[("a",)]
    assert (fit.n, fit.b1, fit.b2, fit.const) == (n, pytest.approx(b1), pytest.approx(b2), pytest.approx(const))
    assert fit.aic == pytest.approx(n * math.log(sse / n) + 6)
    path = list(train)
    for _ in range(20):
        z = [path[-k] - path[-k - 1] - path[-k - 12] + path[-k - 13] for k in (1, 12)]
        path.append(path[-1] + path[-12] - path[-13] + const + b1 * z[0] + b2 * z[1])
    out = A.seasonal_forecast(df, F.lit(20)).orderBy("step").collect()
    assert {r.series_id for r in out} == {"a"}
    assert [r.predicted for r in out] == pytest.approx(path[80:])
    report = by(A.seasonal_report(df), "series_id")[("a",)]
    assert report.test_mae == pytest.approx(np.mean(np.abs(y[80:] - np.array(path[80:]))))


@pytest.mark.parametrize("d", [0, 1])
def test_order_search_against_brute_force(monthly, d):
    rng = np.random.default_rng(13)
    e = rng.normal(size=202)
    y = np.zeros(202)
    for t in range(2, 202):
        y[t] = 0.6 * y[t - 1] - 0.4 * y[t - 2] + e[t]
    y = y[2:] if d == 0 else y[2:].cumsum()
    x = np.diff(y, n=d)
    out = by(A.ar_order_search(monthly({"a": y, "flat": [1] * 30}), d=d), "series_id", "p")
    for p in range(6):
        target = x[5:]
        design = np.column_stack([np.ones(len(target)), *[x[5 - k : len(x) - k] for k in range(1, p + 1)]])
        sse = np.sum((target - design @ np.linalg.lstsq(design, target, rcond=None)[0]) ** 2)
        assert out[("a", p)].aic == pytest.approx(len(target) * math.log(sse / len(target)) + 2 * (p + 1))
    assert out[("flat", 0)].aic is None
    best = by(A.best_order(A.ar_order_search(monthly({"a": y}), d=d)), "series_id")[("a",)]
    assert best.p == min(range(6), key=lambda p: out[("a", p)].aic)


# --- Stationarity -----------------------------------------------------------------------


def test_dickey_fuller_tells_noise_from_a_walk(monthly):
    rng = np.random.default_rng(17)
    df = monthly({"noise": rng.normal(size=150), "walk": rng.normal(size=150).cumsum(), "flat": [3] * 30})
    plain = by(stationarity.dickey_fuller(df), "series_id")
    assert plain[("noise",)].is_stationary and not plain[("walk",)].is_stationary
    assert plain[("flat",)].is_stationary is False
    full = by(stationarity.augmented_dickey_fuller(df), "series_id")
    assert full[("noise",)].is_stationary and not full[("walk",)].is_stationary
    assert full[("flat",)].statistic is None


def test_long_test_equals_the_one_over_arrays(monthly, daily):
    """From lag products and a few values at the ends, for series of different lengths and large levels."""
    rng = np.random.default_rng(31)
    series = {f"s{n}": (1e6 * (n % 2) + np.cumsum(rng.normal(size=n)) * (0.2 if n % 3 else 1.0) + rng.normal(size=n)).tolist() for n in (9, 25, 60, 143, 300)}
    series |= {"short": [1.0, 2.0, 4.0], "flat": [3.0] * 40, "gap": [None, *rng.normal(size=50).tolist(), None]}
    df = monthly(series)
    short, long = by(stationarity.augmented_dickey_fuller(df), "series_id"), by(stationarity.long_dickey_fuller(df, ["year", "month"]), "series_id")
    assert set(long) == set(short) | {(k,) for k in ("short", "flat")}
    for k, wanted in short.items():
        got = long[k]
        assert (got.used_lags, got.n, got.is_stationary) == (wanted.used_lags, wanted.n, wanted.is_stationary), k
        assert got.statistic == pytest.approx(wanted.statistic, rel=1e-6) if wanted.statistic is not None else got.statistic is None
    days = rng.normal(size=1800).cumsum() * 0.1 + rng.normal(size=1800)
    row = stationarity.long_dickey_fuller(daily({"d": days.tolist()}), ["date"]).first()
    statistic, lags, n = stationarity._augmented(days)
    assert (row.used_lags, row.n) == (lags, n) and row.statistic == pytest.approx(statistic, rel=1e-8)


def test_augmented_with_no_lag_equals_the_plain_test(monthly):
    y = np.random.default_rng(19).normal(size=80)
    plain = stationarity.dickey_fuller(monthly({"a": y})).first()
    full = stationarity.augmented_dickey_fuller(monthly({"a": y})).first()
    if full.used_lags == 0:
        assert full.statistic == pytest.approx(plain.statistic)
    target, design = stationarity._lagged(y, 0)
    coef, (sse,), *_ = np.linalg.lstsq(design, target, rcond=None)
    se = math.sqrt(sse / (len(target) - 2) * np.linalg.inv(design.T @ design)[1, 1])
    assert plain.statistic == pytest.approx(coef[1] / se)


def test_p_value_agrees_with_the_critical_values():
    # For a long series the 5% critical value has a p-value of about 0.05.
    for level, p in (("1%", 0.01), ("5%", 0.05), ("10%", 0.10)):
        assert stationarity.p_value(stationarity.CRITICAL_VALUES[level][0]) == pytest.approx(p, abs=0.002)
    assert stationarity.p_value(5.0) == 1.0 and stationarity.p_value(-30.0) == 0.0


def test_validation_report(monthly):
    noise = np.random.default_rng(5).normal(size=72)
    seasonal = [12 + 9 * math.sin(i * 2 * math.pi / 12) + noise[i] for i in range(72)]
    row = stationarity.validation_report(monthly({"a": seasonal})).first()
    assert row.is_seasonal and row.completeness == 100 and row.recommendation.endswith("SARIMA with s=12")


def test_validation_report_keeps_every_series(spark, monthly):
    noise = np.random.default_rng(3).normal(size=60) + 10
    df = monthly({"a": noise, "one": [3], "flat": [2] * 30, "nulls": [None] * 14, "two": [1, 2]})
    df = df.unionByName(spark.createDataFrame([(None, 2000, 1, 1.0)], df.schema))
    out = {r.series_id: r for r in stationarity.validation_report(df).collect()}
    assert set(out) == {"a", "one", "flat", "nulls", "two", None}
    assert out["a"].reason is None and out["a"].p_value < 0.05 and out["a"].is_stationary
    assert out["nulls"].reason == "no values" and out["nulls"].recommendation is None
    assert {out[k].reason for k in ("one", "flat", "two", None)} == {"too short, constant or exactly predictable"}


def test_validation_report_refuses_several_rows_for_a_month(monthly):
    df = monthly({"a": list(range(30))})
    with pytest.raises(Exception, match="several rows for one month"):
        stationarity.validation_report(df.unionByName(df.limit(1))).collect()


# --- Trained models ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(23)
    rows = []
    for s in ("a", "b"):
        for i in range(150):
            x1, x2 = rng.normal(size=2)
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(3 * x1 + 10 + rng.normal(0, 0.1)), float(x1), float(x2)))
    return spark.createDataFrame(rows, "series_id string, date date, value double, x1 double, x2 double").coalesce(2)


def test_ridge_is_the_textbook_solution(spark, frame):
    x = np.array([[r.x1, r.x2] for r in frame.collect()])
    y = np.array([r.value for r in frame.collect()])
    alpha = 25.0
    xc = x - x.mean(axis=0)
    expected = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ (y - y.mean()))
    model = training.fit(frame, ["x1", "x2"], training.ridge(frame, alpha), scaled=False).stages[-1]
    assert list(model.coefficients) == pytest.approx(list(expected), rel=1e-6)
    assert isinstance(training.linear(), LinearRegression)


def test_train_save_load_register(spark, frame):
    trained, report = training.train_and_evaluate(frame, ["x1", "x2"], training.linear(), 2020, DAILY_ORDER)
    assert [r.n for r in report.orderBy("split").collect()] == [60, 240]
    assert trained.metrics["r2_score"] > 0.99
    first, second = shared_dir(spark, "m"), shared_dir(spark, "m")
    bundle = shared_dir(spark, "b")
    training.register(spark, trained, "one", bundle, first)
    table = training.register(spark, trained, "two", bundle, second, first)
    assert sorted(r.model_key for r in table.collect()) == ["one", "two"]
    with pytest.raises(ValueError):
        training.register(spark, trained, "three", bundle, first, first)
    loaded = training.load_bundle(bundle, spark)
    assert (loaded.features, loaded.base_year) == (["x1", "x2"], 2020)
    a = by(training.predict(trained.model, frame), "series_id", "date")
    b = by(training.predict(loaded.model, frame), "series_id", "date")
    assert a == b


def test_scores_are_clamped_and_keep_their_keys(spark, frame):
    model = training.fit(frame.withColumn("missing", F.rand(1)), ["x1", "missing"], training.linear())
    trained = training.Trained(model, ["x1", "missing"], 2020, {})
    requests = spark.createDataFrame([(1, -50.0), (2, 1.0)], "request_id int, x1 double")
    out = by(training.score(trained, requests, ["request_id", "x1"]), "request_id")
    assert out[(1,)].predicted == 0.0 and out[(1,)].x1 == -50.0
    assert out[(2,)].predicted == pytest.approx(13, abs=0.5)


def test_voting_is_the_mean(spark, frame):
    estimators = {"l": training.linear(), "f": training.random_forest(trees=3, depth=2)}
    voting = training.fit_voting(frame, ["x1", "x2"], estimators)
    out = by(voting.predict(frame), "series_id", "date")
    singles = [by(training.predict(m, frame), "series_id", "date") for m in voting.models.values()]
    for key, row in list(out.items())[:20]:
        assert row.predicted == pytest.approx(sum(s[key].predicted for s in singles) / 2)


def test_stacking_predicts_every_row_once(spark, frame):
    stacked = training.fit_stacking(frame, ["x1", "x2"], {"l": training.linear(), "f": training.random_forest(trees=3, depth=2)}, DAILY_ORDER, folds=3)
    out = stacked.predict(frame)
    assert out.count() == frame.count() and out.columns == [*frame.columns, "predicted"]
    error = out.select(F.avg(F.abs(F.col("value") - F.col("predicted")))).first()[0]
    assert error < 0.3


def test_boosting_is_repeatable(spark, frame):
    runs = [
        by(training.predict(training.fit(frame, ["x1", "x2"], training.gradient_boosting(trees=3, depth=2)), frame), "series_id", "date")
        for _ in range(2)
    ]
    assert runs[0] == runs[1]


def test_trees_do_not_depend_on_the_shuffle_setting(spark, frame):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    runs = []
    try:
        for n in ("4", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = training.training_rows(frame.repartition("x1"), rows_per_part=100)
            fitted = training.fit(rows, ["x1", "x2"], training.random_forest(trees=4, depth=4, features="all"))
            runs.append(by(training.predict(fitted, frame), "series_id", "date"))
            rows.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == runs[1]


def test_selection_and_importance_find_the_signal(spark, frame):
    assert training.select_features(frame, ["x2", "x1"], 1) == ["x1"]
    model = training.fit(frame, ["x2", "x1"], training.random_forest(trees=5, depth=3, features="all"))
    assert training.feature_importance(model, ["x2", "x1"], 1).first().feature == "x1"


def test_grids(spark):
    assert len(tuning.combinations(tuning.HOLD_OUT_GRID)) == 1280
    # Every axis is an argument of the estimator and reaches it.
    made = tuning.boosting({k: v[-1] for k, v in tuning.HOLD_OUT_GRID.items()})
    held = [made.getMaxIter(), made.getStepSize(), made.getMaxDepth(), made.getMinInstancesPerNode(), made.getSubsamplingRate()]
    assert held == [v[-1] for v in tuning.HOLD_OUT_GRID.values()]
    with pytest.raises(TypeError):
        tuning.boosting({"unknown": 1})
    out = tuning.expand_grid(spark.range(2), {"a": [1, 2], "b": [0.5]}).collect()
    assert len(out) == 4 and out[0].params == {"a": 1.0, "b": 0.5}


def test_hold_out_search_ranks_by_test_score(spark, frame):
    rows = split.chronological_split(frame, DAILY_ORDER)
    found = tuning.hold_out_search(
        rows, ["x1", "x2"], lambda p: training.random_forest(trees=2, depth=int(p["depth"]), features="all"), {"depth": [1, 4]}, 2
    ).collect()
    assert [r.params["depth"] for r in found] == [4.0, 1.0] and found[0].test_r2 > found[1].test_r2
    assert tuning.top_results(spark.createDataFrame(found, tuning.RESULT_SCHEMA), 1).count() == 1


def test_cross_validation(spark, frame):
    found, best = tuning.cross_validated_search(
        frame, ["x1", "x2"], training.random_forest(trees=2, features="all"), {"maxDepth": [1, 4]}, DAILY_ORDER, folds=3, parallelism=2
    )
    assert [r.params["maxDepth"] for r in found.collect()] == [4.0, 1.0]
    assert training.predict(best, frame).count() == 300
    scores = tuning.cross_validated_score(frame, ["x1", "x2"], training.linear(), DAILY_ORDER, folds=4).collect()
    folds = [r.r2 for r in scores if r.fold is not None]
    summary = next(r for r in scores if r.fold is None)
    assert len(folds) == 4 and summary.r2 == pytest.approx(np.mean(folds))
    assert summary.margin == pytest.approx(2 * np.std(folds))
