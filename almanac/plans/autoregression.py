"""Autoregressive forecasters fitted per series by least squares.

The sums of products are Spark aggregates over lag columns; what is left per series is a
handful of numbers, solved in closed form or, for the order search, in numpy batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.metrics import error_columns
from almanac.operators.split import chronological_split
from almanac.operators.windows import MONTHLY_ORDER, series_window

SEASON = 12
# Values back from the next step that the seasonal recursion reads.
TAIL = 2 * SEASON + 2


def _positioned(df: DataFrame, order: list[str]) -> DataFrame:
    """Split, 1-based position of each row in its series, and the series' rows and train rows."""
    w = series_window(order)
    whole = Window.partitionBy("series_id")
    return chronological_split(df, order).select(
        "*",
        F.row_number().over(w).alias("position"),
        F.count(F.lit(1)).over(whole).alias("n_all"),
        F.count_if(F.col("split") == "train").over(whole).alias("n_train"),
    )


# --- AR(1) on first differences -------------------------------------------------------


def ar1_rows(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows with the previous value, the difference and the previous difference."""
    order = order or MONTHLY_ORDER
    w = series_window(order)
    v = F.col("value")
    return _positioned(df, order).select(
        "*",
        F.lag(v, 1).over(w).alias("prev"),
        (v - F.lag(v, 1).over(w)).alias("diff"),
        (F.lag(v, 1).over(w) - F.lag(v, 2).over(w)).alias("prev_diff"),
    )


def ar1_fit(rows: DataFrame) -> DataFrame:
    """Slope and intercept of the difference on the one before, from the train rows."""
    train = rows.filter(F.col("split") == "train")
    return train.groupBy("series_id").agg(
        F.regr_slope("diff", "prev_diff").alias("phi"),
        F.regr_intercept("diff", "prev_diff").alias("const"),
        F.max_by("value", "position").alias("last_value"),
        F.max_by("diff", "position").alias("last_diff"),
    )


def ar1_ahead(h: Column) -> Column:
    """Value ``h`` steps after the last train row, in closed form."""
    phi, const = F.col("phi"), F.col("const")
    mean = const / (1 - phi)
    settled = h * mean + (F.col("last_diff") - mean) * phi * (1 - F.pow(phi, h)) / (1 - phi)
    # With phi = 1 the differences grow by the constant each step.
    drifting = h * F.col("last_diff") + const * h * (h + 1) / 2
    return F.col("last_value") + F.when(F.abs(1 - phi) < 1e-12, drifting).otherwise(settled)


def ar1_predictions(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Fitted one-step values on the train rows, forecasts from its end on the test rows."""
    rows = ar1_rows(df, order)
    joined = rows.join(ar1_fit(rows), "series_id")
    one_step = F.col("prev") + F.col("const") + F.col("phi") * F.col("prev_diff")
    predicted = F.when(F.col("split") == "train", one_step).otherwise(
        ar1_ahead(F.col("position") - F.col("n_train"))
    )
    return joined.select(*df.columns, "split", "phi", "const", predicted.alias("predicted"))


def _split_errors(predictions: DataFrame, *coefficients: str) -> DataFrame:
    """Errors on train and test rows side by side, one pass."""
    cols = []
    for split in ("train", "test"):
        actual = F.when(F.col("split") == split, F.col("value"))
        for name, c in zip(("mae", "rmse", "r2"), error_columns(actual, F.col("predicted"))):
            cols.append(c.alias(f"{split}_{name}"))
    return predictions.groupBy("series_id", *coefficients).agg(*cols)


def ar1_report(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    return _split_errors(ar1_predictions(df, order), "phi", "const")


# --- Seasonal: differences of differences, regressed on lags 1 and 12 ------------------


def seasonal_rows(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows with the doubly differenced value ``z`` and its lags 1 and 12.

    All follow from lags of the value itself, so one window pass gives them.
    """
    order = order or MONTHLY_ORDER
    w = series_window(order)

    def lag(k: int) -> Column:
        return F.lag("value", k).over(w) if k else F.col("value")

    def z(k: int) -> Column:
        return lag(k) - lag(k + 1) - lag(k + SEASON) + lag(k + SEASON + 1)

    return _positioned(df, order).select(
        "*",
        z(0).alias("z"),
        z(1).alias("z_1"),
        z(SEASON).alias("z_12"),
        (lag(1) + lag(SEASON) - lag(SEASON + 1)).alias("carried"),
    )


def _seasonal_models(rows: DataFrame) -> DataFrame:
    """Coefficients per series, with the last values of its train rows and its sizes: one aggregate."""
    train = rows.filter(F.col("split") == "train")
    usable = F.col("z_12").isNotNull()
    y, x1, x2 = (F.when(usable, F.col(c)) for c in ("z", "z_1", "z_12"))
    recent = F.when(F.col("position") > F.col("n_train") - TAIL, F.struct("position", "value"))
    moments = train.groupBy("series_id", "n_train", "n_all").agg(
        F.count(y).alias("n"),
        F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"),
        F.var_pop(y).alias("syy"), F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"),
        F.covar_pop(x1, x2).alias("s12"), F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"),
        F.sort_array(F.collect_list(recent)).alias("recent"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = F.try_divide(F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12"), det)
    b2 = F.try_divide(F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12"), det)
    solved = moments.filter(F.col("n") > 0).select("*", b1.alias("b1"), b2.alias("b2"))
    mse = F.col("syy") - F.col("b1") * F.col("s1y") - F.col("b2") * F.col("s2y")
    return solved.select(
        "series_id", "n_train", "n_all", "n", "b1", "b2",
        (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("const"),
        (mse * F.col("n")).alias("sse"),
        F.when(mse > 0, F.col("n") * F.ln(mse) + 6).alias("aic"),
        F.col("recent.value").alias("tail"),
    )


def seasonal_fit(rows: DataFrame) -> DataFrame:
    """Least squares of z on its lags 1 and 12 with a constant, from the train rows; AIC with 3 parameters."""
    return _seasonal_models(rows).select("series_id", "n", "b1", "b2", "const", "sse", "aic")


def _one_step() -> Column:
    return F.col("carried") + F.col("const") + F.col("b1") * F.col("z_1") + F.col("b2") * F.col("z_12")


def _path(horizon: Column) -> Column:
    """Forecasts 1..horizon of a model row as an array. Each one feeds the next."""

    def step(state, _):
        def y(k: int):
            return F.try_element_at(state["tail"], F.lit(-k))

        def z(k: int):
            return y(k) - y(k + 1) - y(k + SEASON) + y(k + SEASON + 1)

        following = (
            y(1) + y(SEASON) - y(SEASON + 1) + F.col("const") + F.col("b1") * z(1) + F.col("b2") * z(SEASON)
        )
        return F.struct(
            F.concat(F.slice(state["tail"], 2, TAIL - 1), F.array(following)).alias("tail"),
            F.concat(state["out"], F.array(following)).alias("out"),
        )

    none = F.array().cast("array<double>")
    start = F.struct(F.col("tail"), none.alias("out"))
    h = horizon.cast("int")
    return F.when(h >= 1, F.aggregate(F.sequence(F.lit(1), h), start, step, lambda s: s["out"])).otherwise(none)


def seasonal_forecast(df: DataFrame, horizon: Column, order: list[str] | None = None) -> DataFrame:
    """Forecasts 1..horizon steps past the train rows: (series_id, step, predicted).

    The recursion runs over an array of the last values per series, as a column
    expression. ``horizon`` may refer to ``n_train`` and ``n_all``.
    """
    models = _seasonal_models(seasonal_rows(df, order)).filter(F.col("b1").isNotNull())
    return models.select("series_id", "n_train", F.posexplode(_path(horizon)).alias("at", "predicted")).select(
        "series_id", "n_train", (F.col("at") + 1).alias("step"), "predicted"
    )


_FIT = ["n", "b1", "b2", "const", "sse", "aic"]


def seasonal_predictions(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Each row with its model: one-step values on the train rows, forecasts from their end on the test rows."""
    rows = seasonal_rows(df, order)
    models = _seasonal_models(rows).select("series_id", *_FIT, _path(F.col("n_all") - F.col("n_train")).alias("path"))
    ahead = F.get("path", (F.col("position") - F.col("n_train") - 1).cast("int"))
    predicted = F.when(F.col("split") == "train", _one_step()).otherwise(ahead)
    return rows.join(models, "series_id").select(*df.columns, "split", *_FIT, predicted.alias("predicted"))


def seasonal_report(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Coefficients, AIC, one-step errors on the train rows and forecast errors on the test rows."""
    return _split_errors(seasonal_predictions(df, order), *_FIT)


# --- Order search -----------------------------------------------------------------------


def ar_order_search(df: DataFrame, max_order: int = 5, d: int = 0, order: list[str] | None = None) -> DataFrame:
    """AIC of AR(p) with a constant for p = 0..max_order, on the ``d`` times differenced value.

    All orders use the rows that have every lag, so their AICs compare. Spark aggregates
    the covariances of the lag columns; each series then is one small matrix, and numpy
    solves a batch of them per call.
    """
    order = order or MONTHLY_ORDER
    w = series_window(order)
    series = df.select("series_id", *order, "value")
    for _ in range(d):
        series = series.withColumn("value", F.col("value") - F.lag("value", 1).over(w)).filter(
            F.col("value").isNotNull()
        )
    size = max_order + 1
    lagged = series.select(
        "series_id", F.col("value").alias("x0"), *[F.lag("value", k).over(w).alias(f"x{k}") for k in range(1, size)]
    ).dropna()
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    moments = lagged.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]
    )

    def solve(batches):
        for pdf in batches:
            cov = np.empty((len(pdf), size, size))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = pdf[f"c{i}_{j}"].to_numpy()
            n = pdf["n"].to_numpy(dtype=float)
            for p in range(size):
                mse = cov[:, 0, 0].copy()
                if p:
                    inner, cross = cov[:, 1 : p + 1, 1 : p + 1], cov[:, 1 : p + 1, 0]
                    coef = np.einsum("nij,nj->ni", np.linalg.pinv(inner), cross)
                    mse -= np.einsum("ni,ni->n", cross, coef)
                good = mse > 0
                aic = np.where(good, n * np.log(np.where(good, mse, 1.0)) + 2 * (p + 1), np.nan)
                yield pd.DataFrame({"series_id": pdf["series_id"], "p": p, "n": pdf["n"], "aic": aic})

    solved = moments.mapInPandas(solve, "series_id string, p int, n bigint, aic double")
    return solved.withColumn("aic", F.nanvl("aic", F.lit(None).cast("double")))


def best_order(searched: DataFrame) -> DataFrame:
    """The order with the least AIC per series, the smaller one on ties."""
    first = F.min(F.struct("aic", "p"))
    return (
        searched.filter(F.col("aic").isNotNull())
        .groupBy("series_id")
        .agg(first.alias("first"))
        .select("series_id", F.col("first.p").alias("p"), F.col("first.aic").alias("aic"))
    )
