"""Autocorrelation and partial autocorrelation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def acf_arrays(df: DataFrame, order: list[str], max_lag: int = 40, value: str = "value") -> DataFrame:
    """One row per series: the autocorrelations of lags 0..max_lag as an array.

    The lagged products are window columns summed in one pass, so a row is never copied
    once per lag. A lag the series is too short for is NULL.
    """
    whole = Window.partitionBy("series_id")
    w = whole.orderBy(*order)
    centred = df.filter(F.col(value).isNotNull()).select(
        "series_id", *order, (F.col(value) - F.avg(value).over(whole)).alias("e")
    )
    products = centred.select(
        "series_id", *[(F.col("e") * F.lag("e", k).over(w)).alias(f"p{k}") for k in range(max_lag + 1)]
    )
    sums = products.groupBy("series_id").agg(*[F.sum(f"p{k}").alias(f"s{k}") for k in range(max_lag + 1)])
    total = F.when(F.col("s0") > 0, F.col("s0"))
    return sums.select(
        "series_id", F.array(*[F.col(f"s{k}") / total for k in range(max_lag + 1)]).alias("acf")
    )


def acf(df: DataFrame, order: list[str], max_lag: int = 40, value: str = "value") -> DataFrame:
    arrays = acf_arrays(df, order, max_lag, value)
    return arrays.select("series_id", F.posexplode("acf").alias("lag", "acf")).filter(F.col("acf").isNotNull())


def pacf(df: DataFrame, order: list[str], max_lag: int = 40, value: str = "value") -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion on each series' ACF array.

    The state carries the coefficients of the current order; step k reads the ACF up to
    lag k. Everything stays a column expression over one short array per series.
    """
    arrays = acf_arrays(df, order, max_lag, value).withColumn(
        "acf", F.filter("acf", lambda r: r.isNotNull())
    ).filter(F.size("acf") > 1)
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), F.array(F.lit(1.0)).alias("pacf"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state, k):
        phi = state["phi"]
        # Autocorrelations of lags 1..k-1, nearest first and farthest first.
        near = F.slice(F.col("acf"), F.lit(2), k - 1)
        far = F.reverse(near)
        reflection = F.try_divide(F.get(F.col("acf"), k) - dot(phi, far), 1 - dot(phi, near))
        updated = F.zip_with(phi, F.reverse(phi), lambda a, b: a - reflection * b)
        return F.struct(
            F.concat(updated, F.array(reflection)).alias("phi"),
            F.concat(state["pacf"], F.array(reflection)).alias("pacf"),
        )

    # Counting up from 1 to a lower bound would count down.
    steps = F.when(F.size("acf") > 1, F.sequence(F.lit(1), F.size("acf") - 1)).otherwise(F.array().cast("array<int>"))
    solved = arrays.select(
        "series_id", F.aggregate(steps, start, step, lambda s: s["pacf"]).alias("pacf")
    )
    return solved.select("series_id", F.posexplode("pacf").alias("lag", "pacf"))
