"""Forecast errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.scoring import accuracy_percent, r2_band


def error_columns(actual: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """MAE, RMSE and R2 as aggregates of one pass.

    The total sum of squares is population variance times count, which stays accurate
    where sum(y^2) - n*mean^2 cancels. A constant actual has no R2.
    """
    both = actual.isNotNull() & predicted.isNotNull()
    y = F.when(both, actual)
    e = F.when(both, actual - predicted)
    total = F.var_pop(y) * F.count(y)
    r2 = 1 - F.try_divide(F.sum(e * e), F.when(total > 0, total))
    return F.avg(F.abs(e)), F.sqrt(F.avg(e * e)), r2


def regression_metrics(df: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    mae, rmse, r2 = error_columns(F.col(actual), F.col(predicted))
    n = F.count(F.when(F.col(predicted).isNotNull(), F.col(actual)))
    return df.groupBy(*keys).agg(n.alias("n"), mae.alias("mae"), rmse.alias("rmse"), r2.alias("r2"))


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.filter(F.col(predicted).isNotNull()).select(
        "*", e.alias("residual"), F.abs(e).alias("absolute_error")
    )


def leaderboard(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Error metrics by model of prediction rows tagged ``model_key``, with score and band."""
    scored = regression_metrics(predictions, [*(keys or []), "model_key"])
    return scored.select(
        "*", accuracy_percent(F.col("r2")).alias("accuracy_percent"), r2_band(F.col("r2")).alias("band")
    )


def best_model(board: DataFrame, keys: list[str], score: str = "r2") -> DataFrame:
    """Model with the highest score; the first name in alphabetical order wins a tie."""
    first = F.min(F.struct((-F.col(score)).alias("rank"), F.col("model_key")))
    return (
        board.filter(F.col(score).isNotNull())
        .groupBy(*keys)
        .agg(first.alias("first"))
        .select(*keys, "first.model_key", (-F.col("first.rank")).alias(score))
    )
