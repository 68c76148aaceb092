"""Seasonal ARIMA models of any small order, fitted per series by conditional least squares.

The differenced series z follows (1 - phi B ..)(1 - PHI B^12 ..) z = (1 + theta B ..)(1 + THETA B^12 ..) e. Given the
parameters, the innovations e follow from z one after the other; those before the first row with
all lags count as zero. The sum of their squares is least where a fixed number of damped
Gauss-Newton rounds ends. Spark gathers each series' train values, which the calendar bounds, into
an array, and a task fits many series at a time: every step is one numpy operation over all of
them. The order search keeps its frontier in a DataFrame: a round is one job that fits the untried
neighbours of the best model of every series that has not settled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.windows import MONTHLY_ORDER
from almanac.plans.autoregression import _positioned, _split_errors
from almanac.sources.sinks import stored

SEASON = 12
# Greatest orders (p, q, P, Q), and the rows before the first innovation: all models of a search share them.
MOST = (2, 2, 1, 1)
AIRLINE_AR = (1, 1, 1, 1)
SKIP = MOST[0] + SEASON * MOST[2]
ROUNDS = 30
# Series that are fitted together.
TOGETHER = 256
# Models that a search starts from, and how many of the four orders may change in one step.
START = ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))
CHANGES = 2


def _lag_weights(plain: np.ndarray, seasonal: np.ndarray) -> dict[int, np.ndarray]:
    """The product of 1 + sum plain_i B^i and 1 + sum seasonal_j B^12j, without its 1: weights by lag."""
    out: dict[int, np.ndarray] = {}
    for i, j in product(range(plain.shape[1] + 1), range(seasonal.shape[1] + 1)):
        if i or j:
            weight = (plain[:, i - 1] if i else 1.0) * (seasonal[:, j - 1] if j else 1.0)
            out[i + SEASON * j] = out.get(i + SEASON * j, 0.0) + weight
    return out


def _split_parameters(params: np.ndarray, orders: tuple[int, int, int, int]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Weights by lag of the autoregressive and the moving-average side; columns are phi, PHI, theta, THETA."""
    p, q, big_p, big_q = orders
    phi, big_phi, theta, big_theta = np.split(params, np.cumsum((p, big_p, q)), axis=1)
    return _lag_weights(-phi, -big_phi), _lag_weights(theta, big_theta)


def innovations(z: np.ndarray, length: np.ndarray, params: np.ndarray, orders: tuple[int, int, int, int]) -> np.ndarray:
    """Innovations of each series (a row of ``z``, of which ``length`` values count); zero before SKIP and after the end."""
    ar, ma = _split_parameters(params, orders)
    rows, size = z.shape
    driven = z.copy()
    for lag, weight in ar.items():
        driven[:, lag:] += weight[:, None] * z[:, : size - lag]
    inside = (np.arange(size) >= SKIP) & (np.arange(size) < length[:, None])
    driven = np.where(inside, driven, 0.0)
    if not ma:
        return driven
    lags, weights = np.array(list(ma)), np.array(list(ma.values()))
    pad = int(lags.max())
    e = np.zeros((size + pad, rows))
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(SKIP, size):
            e[t + pad] = driven[:, t] - (weights * e[t + pad - lags]).sum(0)
    return np.where(inside, e[pad:].T, 0.0)


def fit_orders(z: np.ndarray, length: np.ndarray, orders: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and sum of squared innovations of every row of ``z``."""
    count = sum(orders)
    params = np.zeros((len(z), count))

    def squares(e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            total = (e * e).sum(1)
        return np.where(np.isfinite(total), total, np.inf)

    e = innovations(z, length, params, orders)
    sse = squares(e)
    damping = np.full(len(z), 1e-2)
    for _ in range(ROUNDS if count else 0):
        slopes = np.empty((count, *z.shape))
        for i in range(count):
            moved = params.copy()
            moved[:, i] += 1e-6
            slopes[i] = (innovations(z, length, moved, orders) - e) / 1e-6
        normal = np.einsum("ist,jst->sij", slopes, slopes)
        gradient = np.einsum("ist,st->si", slopes, e)
        diagonal = np.einsum("sii->si", normal)
        damped = normal + (damping[:, None] * diagonal + 1e-12 + 1e-9 * diagonal.max(1, keepdims=True))[:, :, None] * np.eye(count)
        step = np.linalg.solve(damped, -gradient[:, :, None])[:, :, 0]
        tried = innovations(z, length, params + step, orders)
        less = squares(tried) < sse
        params = np.where(less[:, None], params + step, params)
        e = np.where(less[:, None], tried, e)
        sse = np.where(less, squares(tried), sse)
        damping = np.clip(np.where(less, damping / 5, damping * 5), 1e-9, 1e6)
    return params, sse


def _ahead(y: np.ndarray, e: np.ndarray, params: np.ndarray, orders: tuple[int, int, int, int], steps: int) -> np.ndarray:
    """Forecasts of one series from its values and innovations; later innovations are zero."""
    ar, ma = _split_parameters(params[None], orders)
    y, z = list(y), list(_differenced(y))
    shocks = list(e)
    for _ in range(steps):
        following = sum(float(w[0]) * shocks[-k] for k, w in ma.items() if k <= len(shocks)) - sum(float(w[0]) * z[-k] for k, w in ar.items())
        z.append(following)
        shocks.append(0.0)
        y.append(following + y[-1] + y[-SEASON] - y[-SEASON - 1])
    return np.array(y[len(y) - steps :])


def _differenced(y: np.ndarray) -> np.ndarray:
    """Differences of seasonal differences: the first belongs to the fourteenth value."""
    d = y[SEASON:] - y[:-SEASON]
    return d[1:] - d[:-1]


_MODEL = (
    "series_id string, p int, q int, seasonal_p int, seasonal_q int, n bigint, phi array<double>, seasonal_phi array<double>, "
    "theta array<double>, seasonal_theta array<double>, sse double, aic double, innovations array<double>, path array<double>"
)
ORDERS = ["p", "q", "seasonal_p", "seasonal_q"]


def _fit_batch(group: pd.DataFrame, orders: tuple[int, int, int, int], detail: bool) -> pd.DataFrame:
    """The models of some series, all of the same orders."""
    values = [np.asarray(v, float) for v in group["history"]]
    z = [_differenced(v) for v in values]
    length = np.array([len(x) for x in z])
    padded = np.zeros((len(z), length.max()))
    for i, x in enumerate(z):
        padded[i, : len(x)] = x
    params, sse = fit_orders(padded, length, orders)
    n = length - SKIP
    aic = np.where(sse > 0, n * np.log(np.where(sse > 0, sse, 1.0) / n) + 2 * (sum(orders) + 1), np.nan)
    p, q, big_p, big_q = orders
    phi, big_phi, theta, big_theta = np.split(params, np.cumsum((p, big_p, q)), axis=1)
    shocks, paths = [None] * len(z), [None] * len(z)
    if detail:
        e = innovations(padded, length, params, orders)
        shocks = [e[i, : length[i]] for i in range(len(z))]
        paths = [_ahead(values[i], shocks[i], params[i], orders, int(h)) for i, h in enumerate(group["horizon"])]
    return pd.DataFrame(
        {
            "series_id": group["series_id"].to_numpy(), "p": p, "q": q, "seasonal_p": big_p, "seasonal_q": big_q, "n": n,
            "phi": list(phi), "seasonal_phi": list(big_phi), "theta": list(theta), "seasonal_theta": list(big_theta),
            "sse": sse, "aic": aic, "innovations": shocks, "path": paths,
        }
    )


def histories(df: DataFrame, order: list[str] | None = None, horizon: Column | None = None) -> DataFrame:
    """(series_id, history, horizon): train values in order, of the series that are long enough to fit.

    Missing values would shift the seasons, so series with any fall out, as do those of
    fewer than two seasons more than the lags take.
    """
    rows = _positioned(df, order or MONTHLY_ORDER)
    train = rows.filter(F.col("split") == "train").groupBy("series_id", "n_train", "n_all").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "value"))), lambda s: s["value"]).alias("history")
    )
    whole = ~F.exists("history", lambda v: v.isNull() | F.isnan(v))
    long_enough = F.size("history") >= SKIP + 1 + SEASON + 2 * SEASON
    steps = horizon if horizon is not None else F.col("n_all") - F.col("n_train")
    return train.filter(whole & long_enough).select("series_id", "n_train", "history", steps.cast("int").alias("horizon"))


def fit_models(asked: DataFrame, detail: bool = True) -> DataFrame:
    """A model for each row of (series_id, history, horizon, p, q, seasonal_p, seasonal_q).

    With ``detail`` each has its innovations and its forecasts 1..horizon; without, both are NULL.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for orders, group in pdf.groupby(ORDERS):
                for at in range(0, len(group), TOGETHER):
                    yield _fit_batch(group.iloc[at : at + TOGETHER], tuple(int(x) for x in orders), detail)

    return asked.select("series_id", "history", "horizon", *ORDERS).mapInPandas(run, _MODEL)


def _with_orders(frame: DataFrame, orders: list[tuple[int, int, int, int]]) -> DataFrame:
    every = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(ORDERS, o, strict=True)]) for o in orders])
    return frame.withColumn("o", F.explode(every)).select(*frame.columns, *[F.col(f"o.{c}") for c in ORDERS])


def sarima_fit(df: DataFrame, orders: tuple[int, int, int, int] = AIRLINE_AR, order: list[str] | None = None, horizon: Column | None = None) -> DataFrame:
    """One model per series, with forecasts 1..horizon past its train rows (as many as test rows unless said otherwise)."""
    return fit_models(_with_orders(histories(df, order, horizon), [orders]))


_FIT = ["n", "phi", "seasonal_phi", "theta", "seasonal_theta", "sse", "aic"]


def sarima_predictions(df: DataFrame, orders: tuple[int, int, int, int] = AIRLINE_AR, order: list[str] | None = None) -> DataFrame:
    """Each row with its model: one-step values on the train rows, forecasts from their end on the test rows.

    Rows before the first innovation, and all rows of a series without a model, have no prediction.
    """
    rows = _positioned(df, order or MONTHLY_ORDER)
    models = sarima_fit(df, orders, order)
    at = F.col("position") - 1 - (SEASON + 1)
    one_step = F.when(at >= SKIP, F.col("value") - F.get("innovations", at.cast("int")))
    ahead = F.get("path", (F.col("position") - F.col("n_train") - 1).cast("int"))
    predicted = F.when(F.col("split") == "train", one_step).otherwise(ahead)
    return rows.join(models, "series_id", "left").select(*df.columns, "split", *_FIT, predicted.alias("predicted"))


def sarima_report(df: DataFrame, orders: tuple[int, int, int, int] = AIRLINE_AR, order: list[str] | None = None) -> DataFrame:
    """Parameters, AIC, one-step errors on the train rows and forecast errors on the test rows."""
    return _split_errors(sarima_predictions(df, orders, order), *_FIT)


def every_order() -> list[tuple[int, int, int, int]]:
    return list(product(*(range(m + 1) for m in MOST)))


def neighbours(orders: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    """Models that differ in one place, or in up to CHANGES."""
    return [o for o in every_order() if 0 < sum(a != b for a, b in zip(o, orders, strict=True)) <= CHANGES]


def order_search(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Every model that a stepwise search by AIC tried, per series: (series_id, orders, n, sse, aic, round).

    Each round tries the neighbours of each series' best model so far; a series whose best one did
    not change has settled. Every series tries each model at most once, so that there are never
    more rounds than models.
    """
    panel = stored(histories(df, order), "histories")
    kept = ["series_id", *ORDERS, "n", "sse", "aic"]
    tried = stored(fit_models(_with_orders(panel, list(START)), detail=False).select(*kept, F.lit(0).alias("round")), "tried")
    steps = {o: neighbours(o) for o in every_order()}
    listed = F.create_map(
        *[
            x
            for o, near in steps.items()
            for x in (F.lit("-".join(map(str, o))), F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(ORDERS, n, strict=True)]) for n in near]))
        ]
    )
    number = 0
    while True:
        number += 1
        best = best_orders(tried)
        around = best.select("series_id", F.explode(listed[F.concat_ws("-", *ORDERS)]).alias("o"))
        fresh = around.select("series_id", *[F.col(f"o.{c}") for c in ORDERS]).join(tried, ["series_id", *ORDERS], "left_anti")
        asked = panel.join(fresh, "series_id").repartition("series_id", *ORDERS)
        found = stored(fit_models(asked, detail=False).select(*kept, F.lit(number).alias("round")), "tried")
        if found.isEmpty():
            return tried
        tried = stored(tried.unionByName(found), "tried")


def best_orders(tried: DataFrame) -> DataFrame:
    """The model with the least AIC per series, the smaller orders on ties."""
    least = F.min(F.struct("aic", F.struct(*ORDERS).alias("o")))
    chosen = tried.filter(F.col("aic").isNotNull() & ~F.isnan("aic")).groupBy("series_id").agg(least.alias("b"))
    return chosen.select("series_id", *[F.col(f"b.o.{c}").alias(c) for c in ORDERS], F.col("b.aic").alias("aic"))


def sarima_innovations(df: DataFrame, params: list[float], orders: tuple[int, int, int, int] = AIRLINE_AR, order: list[str] | None = None) -> DataFrame:
    """(series_id, position, innovation) of the train rows under given parameters, phi, PHI, theta, THETA in a row."""
    schema = "series_id string, innovations array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for series, values in zip(pdf["series_id"], pdf["history"], strict=True):
                z = _differenced(np.asarray(values, float))[None]
                e = innovations(z, np.array([z.shape[1]]), np.array([params], float), orders)
                yield pd.DataFrame({"series_id": [series], "innovations": [e[0]]})

    found = histories(df, order).mapInPandas(run, schema)
    return found.select("series_id", F.posexplode("innovations").alias("at", "innovation")).select(
        "series_id", (F.col("at") + SEASON + 2).alias("position"), "innovation"
    ).filter(F.col("position") > SKIP + SEASON + 1)
