"""ARIMA(1,1,1) with a constant, fitted per series by two least-squares stages.

The innovations that a moving-average term needs are not observed. A long autoregression of the
differences estimates them first; the differences are then regressed on the one before and on
the innovation before. Both stages are moments that Spark aggregates over lag columns, and each series leaves
a handful of numbers to solve. The fitted model's own innovations follow by a recursion over a
series' periods, which the calendar bounds, as a fold over an array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.windows import MONTHLY_ORDER, series_window
from almanac.plans.autoregression import _positioned, _split_errors

# Lags of the long autoregression.
LONG = 6
# The moving-average term stays within this, so that innovations die out.
THETA_MOST = 0.98
# Below this share of the regressors' product their determinant counts as zero.
SINGULAR = 1e-10

_COEFFICIENTS = ["n", "phi", "theta", "const"]


def arma_rows(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows with the previous value, the difference and the differences before it."""
    order = order or MONTHLY_ORDER
    w = series_window(order)
    back = [F.lag("value", k).over(w) if k else F.col("value") for k in range(LONG + 2)]
    steps = [(back[k] - back[k + 1]).alias(f"diff_{k}") for k in range(LONG + 1)]
    return _positioned(df, order).select("*", back[1].alias("prev"), *steps)


def long_autoregression(rows: DataFrame) -> DataFrame:
    """(series_id, intercept, weights) of the difference on the ``LONG`` before it, from the train rows."""
    names = [f"diff_{k}" for k in range(LONG + 1)]
    train = rows.filter(F.col("split") == "train").dropna(subset=names)
    pairs = [(i, j) for i in range(LONG + 1) for j in range(i, LONG + 1)]
    moments = train.groupBy("series_id").agg(
        *[F.avg(c).alias(f"m{k}") for k, c in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
    )

    def solve(batches):
        for pdf in batches:
            cov = np.empty((len(pdf), LONG + 1, LONG + 1))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = pdf[f"c{i}_{j}"].to_numpy()
            means = pdf[[f"m{k}" for k in range(LONG + 1)]].to_numpy()
            weights = np.einsum("nij,nj->ni", np.linalg.pinv(cov[:, 1:, 1:], hermitian=True), cov[:, 1:, 0])
            intercept = means[:, 0] - (weights * means[:, 1:]).sum(1)
            yield pd.DataFrame({"series_id": pdf["series_id"], "intercept": intercept, "weights": list(weights)})

    return moments.mapInPandas(solve, "series_id string, intercept double, weights array<double>")


def arma_fit(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(series_id, n, phi, theta, const): the second stage. Series too short for it have NULLs.

    Where the two regressors tell the same, the difference before stands alone.
    """
    w = series_window(order or MONTHLY_ORDER)
    weighted = [F.col("weights")[k - 1] * F.col(f"diff_{k}") for k in range(1, LONG + 1)]
    shock = F.col("diff_0") - F.col("intercept") - sum(weighted[1:], weighted[0])
    train = rows.filter(F.col("split") == "train").join(long_autoregression(rows), "series_id", "left")
    lagged = train.withColumn("shock", shock).withColumn("shock_1", F.lag("shock", 1).over(w))
    usable = F.col("shock_1").isNotNull() & F.col("shock").isNotNull()
    y, x1, x2 = (F.when(usable, F.col(c)) for c in ("diff_0", "diff_1", "shock_1"))
    moments = lagged.groupBy("series_id").agg(
        F.count(y).alias("n"),
        F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"),
        F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"),
        F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"),
    )
    s11, s22, s12, s1y, s2y = (F.col(c) for c in ("s11", "s22", "s12", "s1y", "s2y"))
    det = s11 * s22 - s12 * s12
    alone = det <= SINGULAR * s11 * s22
    phi = F.when(alone, F.coalesce(F.try_divide(s1y, s11), F.lit(0.0))).otherwise(F.try_divide(s1y * s22 - s2y * s12, det))
    theta = F.when(alone, F.lit(0.0)).otherwise(F.try_divide(s2y * s11 - s1y * s12, det))
    held = F.greatest(F.lit(-THETA_MOST), F.least(F.lit(THETA_MOST), theta))
    solved = moments.select("*", phi.alias("phi"), F.when(theta.isNotNull(), held).alias("theta"))
    const = F.col("my") - F.col("phi") * F.col("m1") - F.col("theta") * F.col("m2")
    return solved.select("series_id", "n", "phi", "theta", const.alias("const"))


def _innovations(steps: Column) -> Column:
    """The model's innovation for each difference of an array; none for the first, and none where one is missing."""

    def step(state: Column, d: Column) -> Column:
        e = d - F.col("const") - F.col("phi") * state["before"] - F.col("theta") * state["e"]
        return F.struct(d.alias("before"), F.coalesce(e, F.lit(0.0)).alias("e"), F.concat(state["out"], F.array(e)).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("before"), F.lit(0.0).alias("e"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(steps, start, step, lambda s: s["out"])


def _ahead(h: Column) -> Column:
    """Value ``h`` steps after the last train row. Only the first step sees the last innovation."""
    phi, const = F.col("phi"), F.col("const")
    first = const + phi * F.col("last_diff") + F.col("theta") * F.coalesce("last_shock", F.lit(0.0))
    mean = const / (1 - phi)
    settled = h * mean + (first - mean) * (1 - F.pow(phi, h)) / (1 - phi)
    # With phi = 1 the differences grow by the constant each step.
    drifting = h * first + const * h * (h - 1) / 2
    return F.col("last_value") + F.when(F.abs(1 - phi) < 1e-12, drifting).otherwise(settled)


def arma_predictions(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Fitted one-step values on the train rows, forecasts from their end on the test rows."""
    rows = arma_rows(df, order)
    train = rows.filter(F.col("split") == "train")
    history = train.groupBy("series_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "diff_0"))), lambda s: s["diff_0"]).alias("steps"),
        F.max_by("value", "position").alias("last_value"),
    )
    models = history.join(arma_fit(rows, order), "series_id").withColumn("shocks", _innovations(F.col("steps")))
    models = models.select(
        "series_id", *_COEFFICIENTS, "shocks", "last_value",
        F.try_element_at("steps", F.lit(-1)).alias("last_diff"), F.try_element_at("shocks", F.lit(-1)).alias("last_shock"),
    )
    one_step = F.col("value") - F.get("shocks", (F.col("position") - 1).cast("int"))
    predicted = F.when(F.col("split") == "train", one_step).otherwise(_ahead(F.col("position") - F.col("n_train")))
    return rows.join(models, "series_id", "left").select(*df.columns, "split", *_COEFFICIENTS, predicted.alias("predicted"))


def arma_report(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Coefficients, one-step errors on the train rows and forecast errors on the test rows."""
    return _split_errors(arma_predictions(df, order), *_COEFFICIENTS)
