"""Ranked selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, spread: list[str], slots: int = 64
) -> DataFrame:
    """The first n rows of each key, with their ``rank``.

    Each key is first cut into slots by a hash of ``spread`` and reduced to n rows per
    slot, so that a key with a large share of all rows is ranked by many tasks; the second
    ranking sees at most ``slots * n`` rows of a key. Spark also applies the row-number
    limit before each shuffle.
    """
    slot = F.pmod(F.xxhash64(*spread), F.lit(slots))
    by_slot = Window.partitionBy(*keys, "slot").orderBy(*order)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("slot", slot)
        .withColumn("rank", F.row_number().over(by_slot))
        .filter(F.col("rank") <= n)
        .drop("slot")
        .withColumn("rank", F.row_number().over(by_key))
        .filter(F.col("rank") <= n)
    )


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows overall; Spark keeps n per task and merges, without a full sort."""
    return df.orderBy(*order).limit(n)
