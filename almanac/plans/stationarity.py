"""Unit-root tests and the validation report."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.quality import quality_report
from almanac.operators.relate import join_series
from almanac.operators.summary import seasonal_ratio
from almanac.operators.windows import MONTHLY_ORDER, series_window

# Published critical-value surface (MacKinnon 2010), one variable, constant only:
# coefficients of 1, 1/n, 1/n^2, 1/n^3.
CRITICAL_VALUES = {
    "1%": [-3.43035, -6.5393, -16.786, -79.433],
    "5%": [-2.86154, -2.8903, -4.234, -40.040],
    "10%": [-2.56677, -1.5384, -2.809, 0.0],
}
# Published p-value approximation (MacKinnon 1994), same case: statistic bounds and
# polynomial coefficients from the constant term up.
P_VALUE_MAX, P_VALUE_MIN, P_VALUE_STAR = 2.74, -18.83, -1.61
P_VALUE_SMALL = [2.1659, 1.4412, 0.038269]
P_VALUE_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]

TEST_SCHEMA = (
    "series_id string, statistic double, p_value double, used_lags int, n int, critical_5pct double, is_stationary boolean"
)


def critical_value(n: Column, level: str = "5%") -> Column:
    b = CRITICAL_VALUES[level]
    return F.lit(b[0]) + b[1] / n + b[2] / (n * n) + b[3] / (n * n * n)


def dickey_fuller(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Dickey-Fuller test without lagged differences, as one regression per series in SQL."""
    w = series_window(order or MONTHLY_ORDER)
    prev = F.lag("value", 1).over(w)
    steps = df.select("series_id", prev.alias("x"), (F.col("value") - prev).alias("y")).dropna()
    sums = steps.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.regr_sxy("y", "x").alias("sxy"),
        F.regr_syy("y", "x").alias("syy"),
    )
    n = F.col("n").cast("double")
    slope = F.try_divide("sxy", "sxx")
    error = F.sqrt(F.try_divide((F.col("syy") - slope * F.col("sxy")) / F.nullif(n - 2, F.lit(0.0)), F.col("sxx")))
    statistic = F.try_divide(slope, error)
    return sums.select(
        "series_id", "n", statistic.alias("statistic"), critical_value(n).alias("critical_5pct")
    ).withColumn("is_stationary", F.coalesce(F.col("statistic") <= F.col("critical_5pct"), F.lit(False)))


def p_value(statistic: float) -> float:
    if statistic > P_VALUE_MAX:
        return 1.0
    if statistic < P_VALUE_MIN:
        return 0.0
    poly = P_VALUE_SMALL if statistic <= P_VALUE_STAR else P_VALUE_LARGE
    return NormalDist().cdf(sum(c * statistic**i for i, c in enumerate(poly)))


def _lagged(y: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences and the design [1, previous value, previous differences]."""
    dy = np.diff(y)
    rows = len(dy) - lags
    cols = [np.ones(rows), y[lags : lags + rows]]
    cols += [dy[lags - k : lags - k + rows] for k in range(1, lags + 1)]
    return dy[lags:], np.column_stack(cols)


def _augmented(y: np.ndarray) -> tuple[float, int, int] | None:
    """Statistic, lags used and rows used; lags chosen by AIC over one common sample."""
    n = len(y)
    most = most_lags(n)
    if most < 0 or np.ptp(y) == 0:
        return None
    # The constant takes any level; about the mean, a large one does not swamp the design.
    y = y - y.mean()
    # More lags only append columns, so one orthogonal basis gives the fit of every choice.
    target, design = _lagged(y, most)
    explained = np.cumsum((np.linalg.qr(design)[0].T @ target) ** 2)[1:]
    sse = target @ target - explained
    if np.any(sse <= 0):
        return None
    scores = len(target) * np.log(sse / len(target)) + 2 * np.arange(2, most + 3)
    lags = int(np.argmin(scores))
    target, x = _lagged(y, lags)
    free = len(target) - x.shape[1]
    if free <= 0:
        return None
    inverse = np.linalg.pinv(x.T @ x)
    coef = inverse @ x.T @ target
    variance = float(np.sum((target - x @ coef) ** 2)) / free
    return float(coef[1] / math.sqrt(variance * inverse[1, 1])), lags, len(target)


def augmented_dickey_fuller(monthly: DataFrame) -> DataFrame:
    """Augmented test per series of a monthly frame.

    A series' months travel as one array, whose length the calendar bounds; batches of
    series run in parallel. Longer series, such as daily ones: ``long_dickey_fuller``.
    """
    ordered = F.sort_array(F.collect_list(F.struct("year", "month", "value")))
    series = (
        monthly.filter(F.col("value").isNotNull())
        .groupBy("series_id")
        .agg(ordered.alias("points"))
        .select("series_id", F.col("points.value").alias("y"))
    )

    def test(batches):
        b = CRITICAL_VALUES["5%"]
        for pdf in batches:
            rows = []
            for name, y in zip(pdf["series_id"], pdf["y"]):
                found = _augmented(np.asarray(y, dtype=float))
                if found is None:
                    rows.append((name, None, None, None, None, None, False))
                    continue
                statistic, lags, n = found
                p = p_value(statistic)
                critical = b[0] + b[1] / n + b[2] / n**2 + b[3] / n**3
                rows.append((name, statistic, p, lags, n, critical, p <= 0.05))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    names = ["series_id", "statistic", "p_value", "used_lags", "n", "critical_5pct", "is_stationary"]
    return series.mapInPandas(test, TEST_SCHEMA)


# --- Long series --------------------------------------------------------------------------
# A series as rows, never as one array: the test needs the lag products of its differences and levels, and a few
# values at its two ends. With d_t the difference at row t = 1..T and x_t the value before it, the products over the rows from
# m + 1 on that have all m lags are those over all rows less the ones at the ends.


def most_lags(n: int) -> int:
    """The lags that a series of n values allows."""
    return min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)


def _products(r: np.ndarray, xd: np.ndarray, head: np.ndarray, tail: np.ndarray, sums: tuple[float, float], n: int, lags: int) -> np.ndarray:
    """Cross-products of [1, x, d lagged 1..lags, d] over the rows that have all lags.

    ``r`` and ``xd`` hold sums of d_t d_(t-k) and x_t d_(t-k) over all rows; ``head`` and ``tail`` the first and
    last values of the series, more of them than lags; ``sums`` those of the values and of their squares.
    """
    first, last = np.diff(head), np.diff(tail)
    out = np.empty((lags + 3, lags + 3))
    of = [*range(1, lags + 1), 0]
    for a, i in enumerate(of):
        for b, j in enumerate(of[a:], a):
            low, high = min(i, j), max(i, j)
            k = high - low
            # Rows s of the nearer difference that are left out: up to lags - low, and the last low ones.
            before = sum(first[s - 1] * first[s - k - 1] for s in range(k + 1, lags - low + 1))
            after = sum(last[len(last) - 1 - s] * last[len(last) - 1 - s - k] for s in range(low))
            out[a + 2, b + 2] = out[b + 2, a + 2] = r[k] - before - after
        out[a + 2, 1] = out[1, a + 2] = xd[i] - sum(head[s - 1] * first[s - i - 1] for s in range(i + 1, lags + 1))
        # The differences add up to the values at the ends.
        out[a + 2, 0] = out[0, a + 2] = tail[len(tail) - 1 - i] - head[lags - i]
    total, squares = sums
    out[0, 0] = n - 1 - lags
    out[0, 1] = out[1, 0] = total - tail[-1] - head[:lags].sum()
    out[1, 1] = squares - tail[-1] ** 2 - (head[:lags] ** 2).sum()
    return out


def _tested(row) -> tuple[float, int, int] | None:
    """Statistic, lags used and rows used of one series; as ``_augmented``."""
    n, head, tail = int(row.n), np.asarray(row.head, float), np.asarray(row.tail, float)
    most = most_lags(n)
    r, xd = np.asarray(row.r, float), np.asarray(row.xd, float)
    if most < 0 or r[0] <= 0:
        return None
    sums = (float(row.total), float(row.squares))
    whole = _products(r, xd, head, tail, sums, n, most)
    used = n - 1 - most
    try:
        # Each further column of the factor takes one regressor out of the target, the last row.
        factor = np.linalg.cholesky(whole)
    except np.linalg.LinAlgError:
        return None
    sse = whole[-1, -1] - np.cumsum(factor[-1, :-1] ** 2)[1:]
    if np.any(sse <= 1e-12 * whole[-1, -1]):
        return None
    lags = int(np.argmin(used * np.log(sse / used) + 2 * np.arange(2, most + 3)))
    own = _products(r, xd, head, tail, sums, n, lags)
    used, free = n - 1 - lags, n - 1 - lags - (lags + 2)
    if free <= 0:
        return None
    inverse = np.linalg.pinv(own[:-1, :-1], hermitian=True)
    coef = inverse @ own[:-1, -1]
    variance = (own[-1, -1] - coef @ own[:-1, -1]) / free
    return (float(coef[1] / math.sqrt(variance * inverse[1, 1])), lags, used) if variance > 0 else None


def long_dickey_fuller(df: DataFrame, order: list[str]) -> DataFrame:
    """The augmented test of series of any length: one row per series, NULLs where nothing could be tested.

    Spark sums the lag products of every row; a task gets a few numbers per series, as many as
    the lags that the longest series allows, and solves all lag orders from one factor.
    """
    w, whole = series_window(order), Window.partitionBy("series_id")
    known = df.filter(F.col("value").isNotNull()).select(
        "series_id", *order, F.row_number().over(w).alias("position"), F.count(F.lit(1)).over(whole).alias("n"),
        # About the mean, so that products of large levels don't cancel.
        (F.col("value") - F.avg("value").over(whole)).alias("y"),
    )
    longest = df.filter(F.col("value").isNotNull()).groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    width = max(most_lags(longest), 0)
    step = (F.col("y") - F.lag("y", 1).over(w)).alias("d")
    steps = known.select("*", F.lag("y", 1).over(w).alias("x"), step)
    lagged = steps.select("*", *[F.lag("d", k).over(w).alias(f"d{k}") if k else F.col("d").alias("d0") for k in range(width + 1)])
    ends = lambda wanted: F.transform(F.sort_array(F.collect_list(F.when(wanted, F.struct("position", "y")))), lambda s: s["y"])
    sums = lagged.groupBy("series_id").agg(
        F.max("n").alias("n"), F.sum("y").alias("total"), F.sum(F.col("y") * F.col("y")).alias("squares"),
        F.array(*[F.coalesce(F.sum(F.col("d0") * F.col(f"d{k}")), F.lit(0.0)) for k in range(width + 1)]).alias("r"),
        F.array(*[F.coalesce(F.sum(F.col("x") * F.col(f"d{k}")), F.lit(0.0)) for k in range(width + 1)]).alias("xd"),
        ends(F.col("position") <= width + 1).alias("head"),
        ends(F.col("position") > F.col("n") - width - 1).alias("tail"),
    )

    def test(batches):
        b = CRITICAL_VALUES["5%"]
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                found = _tested(row)
                if found is None:
                    rows.append((row.series_id, None, None, None, None, None, False))
                    continue
                statistic, lags, n = found
                p = p_value(statistic)
                rows.append((row.series_id, statistic, p, lags, n, b[0] + b[1] / n + b[2] / n**2 + b[3] / n**3, p <= 0.05))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in TEST_SCHEMA.split(", ")], dtype=object)

    return sums.mapInPandas(test, TEST_SCHEMA)


def validation_report(monthly: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Quality, stationarity and seasonality of each series, and the model these suggest.

    Stationarity is the augmented test's. Every series has a row; where nothing could be tested,
    ``reason`` says why and the figures are NULL. ``monthly`` has one row per series and month, as
    the roll-ups make it; a second one is an error. ``rows`` are the monthly rows as delivered,
    when they differ from ``monthly``.
    """
    single = monthly.groupBy("series_id", "year", "month").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    twice = F.raise_error(F.lit("a series has several rows for one month")).cast("double")
    panel = single.select("series_id", "year", "month", F.when(F.col("n") > 1, twice).otherwise(F.col("value")).alias("value"))
    quality = quality_report(panel if rows is None else rows, panel=rows is None).select(
        "series_id", "completeness", "missing", "outliers", (F.col("total_records") - F.col("missing")).alias("known")
    )
    stationary = augmented_dickey_fuller(panel).select("series_id", "statistic", "p_value", "used_lags", "is_stationary")
    seasonal = seasonal_ratio(panel).select("series_id", "ratio", "is_seasonal")
    report = join_series(join_series(quality, stationary, "left"), seasonal, "left")
    reason = F.when(F.col("known") == 0, "no values").when(F.col("statistic").isNull(), "too short, constant or exactly predictable")
    base = F.when(F.col("is_stationary"), "ARIMA(p,0,q)").otherwise("difference first (d=1 or d=2)")
    advice = F.when(F.col("is_seasonal"), F.concat(base, F.lit("; SARIMA with s=12"))).otherwise(base)
    return report.withColumn("recommendation", F.when(reason.isNull(), advice)).withColumn("reason", reason).drop("known")
