import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import correlation, distribution, metrics, quality, relate, rollup, scaling, split, summary, topk
from almanac.operators import windows as W
from almanac.sources import sinks


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


# --- Roll-ups ---------------------------------------------------------------------------


def test_monthly_sums_add_up_to_the_daily_sum(daily):
    df = daily({"a": range(100), "b": range(50)})
    out = rollup.monthly_sum(df)
    assert out.agg(F.sum("value")).first()[0] == df.agg(F.sum("value")).first()[0]
    assert by(out, "series_id", "year", "month")[("a", 2020, 1)].value == sum(range(31))


def test_rows_without_key_belong_to_no_month(spark):
    rows = [("a", dt.date(2020, 1, 1), 1.0), (None, dt.date(2020, 1, 1), 2.0), ("a", None, 4.0)]
    out = rollup.monthly_sum(spark.createDataFrame(rows, "series_id string, date date, value double")).collect()
    assert [(r.series_id, r.value) for r in out] == [("a", 1.0)]


def test_dense_climatology_has_twelve_months(monthly):
    out = by(rollup.dense_month_climatology(monthly({"a": {(2000, 1): 4, (2001, 1): 8, (2000, 3): 5}})), "month")
    assert len(out) == 12
    assert (out[(1,)].value, out[(2,)].value, out[(3,)].value) == (6.0, 0.0, 5.0)


def test_year_month_matrix(monthly):
    row = rollup.year_month_matrix(monthly({"a": {(2000, 1): 4, (2000, 12): 8}})).first()
    assert (row.m01, row.m02, row.m12) == (4.0, None, 8.0)


# --- Windows ----------------------------------------------------------------------------


def test_windows_do_not_cross_series(daily):
    w = W.series_window(["date"])
    df = daily({"a": [1, 2, 3], "b": [10, 20, 30]}).select("*", *W.row_lags("value", [1], w), *W.rolling_past("value", [2], w))
    out = by(df, "series_id", "date")
    assert out[("b", dt.date(2020, 1, 1))].value_lag_1 is None
    assert out[("b", dt.date(2020, 1, 3))].value_ma_2 == 15.0


def test_row_lag_and_calendar_lag_differ_over_a_gap(monthly):
    df = W.calendar_lags(monthly({"a": {(2000, 1): 1, (2000, 2): 2, (2000, 4): 4}}), [1])
    df = df.select("*", *W.row_lags("value", [1], W.series_window(W.MONTHLY_ORDER)))
    april = by(df, "month")[(4,)]
    assert (april.value_lag_1, april.value_cal_lag_1) == (2.0, None)


def test_past_only_windows_ignore_the_current_row(daily):
    values = list(np.random.default_rng(1).integers(0, 9, 30))
    changed = values[:-1] + [1000]
    w = W.series_window(["date"])
    last = dt.date(2020, 1, 30)

    def at_end(v):
        cols = [c for s in W.ROLLING for c in W.rolling_past("value", [3, 7], w, s)]
        cols += [F.avg("value").over(w.rowsBetween(-2, 0)).alias("current")]
        return daily({"a": v}).select("date", *cols).filter(F.col("date") == F.lit(last)).first().asDict()

    before, after = at_end(values), at_end(changed)
    assert before.pop("current") != after.pop("current")
    assert before == after


def test_deviation_of_one_row_is_null(daily):
    w = W.series_window(["date"])
    out = daily({"a": [1, 2, 4]}).select("date", *W.rolling_past("value", [3], w, "std")).orderBy("date").collect()
    assert [r.value_std_3 for r in out][:2] == [None, None]
    assert out[2].value_std_3 == pytest.approx(np.std([1, 2], ddof=1))


def test_sequences_need_a_full_history(daily):
    out = W.sequences(daily({"a": [1, 2, None, 4, 5, 6, 7]}), "value", 3, W.series_window(["date"])).collect()
    assert [(r.history, r.target) for r in out] == [([4.0, 5.0, 6.0], 7.0)]


def test_cumulative_mass_ends_at_one(daily):
    out = W.cumulative_mass(daily({"a": [3, 1, 2, None]})).orderBy("value").collect()
    assert [r.mass for r in out] == pytest.approx([1 / 6, 3 / 6, 1.0])
    assert [r.cume_dist for r in out] == pytest.approx([1 / 3, 2 / 3, 1.0])


# --- Splits -----------------------------------------------------------------------------


@pytest.mark.parametrize("n,test", [(1, 1), (4, 1), (10, 2), (11, 3)])
def test_chronological_split_sizes(daily, n, test):
    out = split.chronological_split(daily({"a": range(n)}), ["date"]).orderBy("date").collect()
    assert [r.split for r in out] == ["train"] * (n - test) + ["test"] * test


def test_fold_sizes_differ_by_at_most_one(daily):
    out = split.contiguous_folds(daily({"a": range(23)}), ["date"], 5).orderBy("date").collect()
    folds = [r.fold for r in out]
    assert folds == sorted(folds)
    sizes = [folds.count(k) for k in range(5)]
    assert sizes == [5, 5, 5, 4, 4]


def test_hashed_split_does_not_depend_on_partitioning(spark):
    df = spark.range(5000)
    a = by(df.repartition(7).select("id", split.hashed_split([F.col("id")], 1).alias("s")), "id")
    b = by(df.coalesce(1).select("id", split.hashed_split([F.col("id")], 1).alias("s")), "id")
    assert a == b
    share = sum(r.s == "test" for r in a.values()) / 5000
    assert 0.17 < share < 0.23


# --- Scaling ----------------------------------------------------------------------------


def test_scaling_of_a_constant_gives_zero(daily):
    df = daily({"a": [5, 5, 5]})
    z = df.join(scaling.fit_standard(df), "series_id").select(scaling.standard(F.col("value")).alias("z"))
    assert [r.z for r in z.collect()] == [0.0] * 3
    m = df.join(scaling.fit_min_max(df), "series_id").withColumn("s", scaling.min_max(F.col("value")))
    back = m.select("s", scaling.inverse_min_max(F.col("s")).alias("v")).collect()
    assert [(r.s, r.v) for r in back] == [(0.0, 5.0)] * 3


def test_f_scores_match_the_formula(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = 2 * x + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, value double")
    r = np.corrcoef(x, y)[0, 1]
    assert scaling.univariate_f_scores(df, ["x"]).first().f_score == pytest.approx(r * r / (1 - r * r) * 198)


# --- Summaries --------------------------------------------------------------------------


def test_missing_values_count_as_dry(daily):
    row = summary.wet_dry(daily({"a": [1, 0, None, 2]})).first()
    assert (row.wet_days, row.dry_days, row.wet_percent) == (2, 2, 50)


def test_summary_of_one_row(daily):
    row = summary.daily_summary(daily({"a": [4]})).first()
    assert (row.n, row.std, row.median, row.duration_days) == (1, None, 4.0, 0)


def test_extremes_take_the_earliest_on_ties(monthly):
    row = summary.extremes(monthly({"a": [1, 9, 9, 1, None]})).first()
    assert (row.wettest_month, row.driest_month) == (2, 1)


def test_seasonality_of_a_constant(monthly):
    df = monthly({"a": [5] * 24, "z": [0] * 24})
    strength = by(summary.seasonality_strength(df), "series_id")
    assert strength[("a",)].strength == "weak" and strength[("z",)].mean_cv is None
    ratio = by(summary.seasonal_ratio(df), "series_id")
    assert ratio[("a",)].ratio == 1.0 and ratio[("z",)].is_seasonal is False


def test_quality_report(spark):
    values = [10, 11, 12, 13, 14, 15, 16, 17, 18, 500, None, None]
    rows = [("a", 2000, i + 1, None if v is None else float(v)) for i, v in enumerate(values)]
    rows += [rows[0], rows[-1], rows[-1]]
    row = quality.quality_report(spark.createDataFrame(rows, "series_id string, year int, month int, value double")).first()
    known = [v for *_, v in rows if v is not None]
    assert (row.total_records, row.missing, row.duplicates, row.outliers) == (15, 4, 3, 1)
    assert row.median == np.percentile(known, 50)
    assert row.iqr == pytest.approx(np.percentile(known, 75) - np.percentile(known, 25))
    assert (row.first_period, row.last_period, row.expected_months) == ("2000-01", "2000-12", 12)
    assert row.status == "excellent"


def test_quality_report_keeps_every_series(spark):
    rows = [(None, 2000, 1, 5.0), ("nulls", 2000, 1, None), ("one", 2000, 1, 2.0), ("odd", 2000, 1, float("inf")), ("odd", 2000, 2, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, year int, month int, value double")
    for panel in (False, True):
        out = {r.series_id: r for r in quality.quality_report(df, panel).collect()}
        assert set(out) == {None, "nulls", "one", "odd"}
        assert (out[None].median, out["nulls"].median, out["odd"].median) == (5.0, None, 1.0)
        assert (out["odd"].missing, out["nulls"].missing, out["one"].std) == (1, 1, None)


def test_spread_of_nothing_and_of_large_values(spark):
    rows = [("none", 2000, m, None) for m in (1, 2, 2)] + [("large", 2000, m, 1e9 + m / 8) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "series_id string, year int, month int, value double")
    for panel in (False, True):
        out = {r.series_id: r for r in quality.quality_report(df, panel).collect()}
        assert (out["none"].std, out["none"].mean, out["none"].outliers) == (None, None, 0)
        assert out["large"].std == pytest.approx(np.std([m / 8 for m in range(1, 13)], ddof=1), rel=1e-12)


def test_completeness_of_a_gappy_series(monthly):
    values = {(2000 + i // 12, i % 12 + 1): 1 for i in range(24) if i not in (5, 6)}
    row = quality.quality_report(monthly({"a": values})).first()
    assert float(row.completeness) == pytest.approx(22 / 24 * 100) and row.status == "good"


def test_top_and_bottom_months(monthly):
    out = summary.top_and_bottom_months(monthly({"a": [5, 1, 9, 9, 2, 7, 3, 3, 3, 3, 3, 3]}))
    high = [r.month for r in sorted(out.filter("side = 'highest'").collect(), key=lambda r: r.rank)]
    low = [r.month for r in sorted(out.filter("side = 'lowest'").collect(), key=lambda r: r.rank)]
    assert high == [3, 4, 6] and low == [2, 5, 7]


def test_latest_same_month(monthly):
    row = by(summary.latest_same_month(monthly({"a": {(2000, 1): 1, (2002, 1): 7, (2001, 1): 4}})), "month")[(1,)]
    assert (row.latest_value, row.mean_value) == (7.0, 4.0)


# --- Distributions ----------------------------------------------------------------------


def hot_rows(spark, seed=0):
    """One series with most of the rows, many of them equal, beside two small ones."""
    rng = np.random.default_rng(seed)
    data = {
        "hot": np.round(np.concatenate([rng.exponential(30, 4000), np.full(2000, 7.0)]), 2),
        "small": np.round(rng.normal(0, 5, 37), 2),
        "one": np.array([3.0]),
    }
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("small", None)]
    return data, spark.createDataFrame(rows, "series_id string, value double").repartition(8)


@pytest.mark.parametrize("slots", [4096, 100, 3])
def test_exact_quantiles_of_a_hot_series(spark, slots):
    data, df = hot_rows(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    out = by(distribution.exact_quantiles(df, probs, slots=slots), "series_id")
    for k, values in data.items():
        assert out[(k,)].n == len(values)
        assert out[(k,)].quantiles == pytest.approx(list(np.quantile(values, probs)))


def test_exact_quantiles_over_all_magnitudes(spark, monkeypatch):
    """Outliers of 1e300 and values next to nothing leave no range with more values than a window may hold."""
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.uniform(0, 1, 30_000), [1e300, -1e300, 1e-300, -1e-300, 0.0], -(10.0 ** rng.uniform(-300, 300, 3000)), 1 + np.arange(9000) * 2.0**-52])
    df = spark.createDataFrame([("a", float(v)) for v in values], "series_id string, value double").repartition(6)
    probs = [0.0, 0.01, 0.05, 0.3, 0.5, 0.75, 0.9, 0.9999, 1.0]
    held = []

    def storing(frame, purpose):
        if purpose == "sought":
            held.append(frame.agg(F.max("held")).first()[0])
        return sinks.stored(frame, purpose)

    monkeypatch.setattr(distribution, "stored", storing)
    row = distribution.exact_quantiles(df, probs, slots=200).first()
    with np.errstate(over="ignore"):
        wanted = np.quantile(values, probs)
    assert row.quantiles == pytest.approx(list(wanted), rel=1e-12)
    assert held[-1] <= 200 and len(held) <= 8


def test_exact_quantiles_of_a_million_rows_in_one_series(spark):
    df = spark.range(1_000_000).selectExpr(
        "if(id % 10 = 0, concat('s', id % 70), 'hot') as series_id",
        "if(id % 3 = 0, 1e12 * cast(pmod(hash(id), 1000) = 0 as int), round(pmod(hash(id, 1), 900000) / 7, 3)) as value",
    )
    wanted = by(df.groupBy("series_id").agg(F.percentile("value", [0.25, 0.5, 0.9995]).alias("q")), "series_id")
    out = by(distribution.exact_quantiles(df, [0.25, 0.5, 0.9995]), "series_id")
    assert set(out) == set(wanted)
    assert all(out[k].quantiles == pytest.approx(wanted[k].q) for k in wanted)


def test_weighted_quantiles_and_values_that_are_not_finite(spark):
    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", float("nan"), 5), ("a", float("inf"), 2), ("a", None, 4), ("b", float("nan"), 1)]
    df = spark.createDataFrame(rows, "series_id string, value double, times int")
    out = distribution.exact_quantiles(df, [0.5, 1.0], weight="times").collect()
    assert [(r.series_id, r.n, r.quantiles) for r in out] == [("a", 4, [1.0, 2.0])]
    bins = distribution.histogram(df, 2).orderBy("bin").collect()
    assert [(r.series_id, r.n, r.left_edge) for r in bins] == [("a", 1, 1.0), ("a", 1, 1.5)]
    assert distribution.iqr_outliers(df).count() == 0 and distribution.box_plot(df).count() == 1


def test_outliers_and_box_plot(spark):
    data, df = hot_rows(spark, 1)
    box = by(distribution.box_plot(df), "series_id")
    outliers = distribution.iqr_outliers(df).groupBy("series_id").count()
    counts = {r.series_id: r["count"] for r in outliers.collect()}
    for k, v in data.items():
        q1, q3 = np.quantile(v, [0.25, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (box[(k,)].whisker_low, box[(k,)].whisker_high) == (inside.min(), inside.max())
        assert counts.get(k, 0) == box[(k,)].n_fliers == len(v) - len(inside)


def test_histogram_counts_every_row(spark):
    data, df = hot_rows(spark, 2)
    out = distribution.histogram(df, 10).orderBy("series_id", "bin").collect()
    for k, v in data.items():
        expected, edges = np.histogram(v, bins=10)
        got = [r for r in out if r.series_id == k]
        assert len(got) == 10 and sum(r.n for r in got) == len(v)
        if k == "one":
            assert [r.n for r in got] == list(expected)
            assert got[0].left_edge == edges[0]


# --- Correlation ------------------------------------------------------------------------


def brute_acf(x, lags):
    e = np.asarray(x, float) - np.mean(x)
    return [float(np.sum(e[k:] * e[: len(e) - k]) / np.sum(e * e)) for k in range(lags + 1)]


def brute_pacf(r):
    out = [1.0]
    for k in range(1, len(r)):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(float(np.linalg.solve(toeplitz, np.array(r[1 : k + 1]))[-1]))
    return out


def test_acf_and_pacf_against_brute_force(daily):
    rng = np.random.default_rng(5)
    x = rng.normal(size=120).cumsum()
    y = rng.normal(size=60)
    df = daily({"x": x, "y": y, "short": [1, 2, 4, 3], "flat": [2, 2, 2]})
    acf = correlation.acf(df, ["date"], 12).orderBy("lag").collect()
    pacf = correlation.pacf(df, ["date"], 12).orderBy("lag").collect()
    for name, values in (("x", x), ("y", y)):
        expected = brute_acf(values, 12)
        assert [r.acf for r in acf if r.series_id == name] == pytest.approx(expected)
        assert [r.pacf for r in pacf if r.series_id == name] == pytest.approx(brute_pacf(expected))
    assert [r.acf for r in acf if r.series_id == "short"] == pytest.approx(brute_acf([1, 2, 4, 3], 3))
    assert not [r for r in acf if r.series_id == "flat"]


# --- Metrics, ranking, lookups ----------------------------------------------------------


def test_metrics_and_missing_predictions(spark):
    rows = [("m", 1.0, 2.0), ("m", 2.0, 2.0), ("m", 4.0, 3.0), ("m", 9.0, None), ("c", 5.0, 4.0), ("c", 5.0, 6.0)]
    out = by(metrics.regression_metrics(spark.createDataFrame(rows, "k string, actual double, predicted double"), ["k"]), "k")
    y, p = np.array([1, 2, 4.0]), np.array([2, 2, 3.0])
    m = out[("m",)]
    assert m.n == 3 and m.mae == pytest.approx(2 / 3) and m.rmse == pytest.approx(np.sqrt(2 / 3))
    assert m.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    assert out[("c",)].r2 is None


def test_best_model_takes_the_first_name_on_ties(spark):
    rows = [("s", "b", 0.5), ("s", "a", 0.5), ("s", "c", 0.1), ("s", "d", None)]
    row = metrics.best_model(spark.createDataFrame(rows, "series_id string, model_key string, r2 double"), ["series_id"]).first()
    assert (row.model_key, row.r2) == ("a", 0.5)


def test_first_per_key_with_a_hot_user(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("user"), F.col("id"), (F.col("id") % 97).alias("t")
    )
    out = topk.first_per_key(df, ["user"], [F.desc("t"), F.asc("id")], 5, ["id"], slots=4)
    hot = [r.id for r in out.filter("user = 0").orderBy("rank").collect()]
    expected = sorted((i for i in range(20000) if i % 3 or i == 0), key=lambda i: (-(i % 97), i))[:5]
    assert hot == expected


def test_fallback_merge(spark):
    schema = "model_key string, mae double, rmse double, r2_score double, accuracy_percent double"
    registry = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("e", "E")], "model_key string, name string")
    primary = spark.createDataFrame([("a", 1.234, 2.0, 0.5, None), ("e", 45.0, None, None, None)], schema)
    secondary = spark.createDataFrame(
        [("a", 9.0, 9.0, 0.9, 90.0), ("b", 3.0, None, 0.25, None), ("daily_xgb_tuned", 1.0, 1.0, 0.1, 10.0), ("other", 1.0, 1.0, 0.1, 10.0)], schema
    )
    average = spark.createDataFrame([("e", 180.0)], "model_key string, average double")
    out = by(relate.fallback_merge(registry, primary, secondary, average), "model_key")
    assert (out[("a",)].mae, out[("a",)].accuracy_percent) == (1.23, 50.0)
    assert (out[("b",)].mae, out[("b",)].rmse, out[("b",)].accuracy_percent) == (3.0, None, 25.0)
    assert out[("c",)].mae is None
    assert out[("e",)].accuracy_percent == 75.0
    assert out[("daily_xgb_tuned",)].name == "Xgb Tuned"
    assert ("other",) not in out


def test_side_by_side(spark):
    metrics_table = spark.createDataFrame([("s", "a", 1.0, 2.0, 0.5), ("s", "b", 3.0, 5.0, 0.1)], "series_id string, model_key string, mae double, rmse double, r2 double")
    asked = spark.createDataFrame([("s", "b", "a"), ("s", "a", "gone")], "series_id string, model_a string, model_b string")
    out = by(relate.side_by_side(metrics_table, asked), "model_a", "model_b")
    assert out[("b", "a")].mae_delta == 2.0 and out[("b", "a")].r2_delta == pytest.approx(-0.4)
    assert out[("a", "gone")].mae_b is None
