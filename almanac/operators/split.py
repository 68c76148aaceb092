"""Train/test splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chronological_split(df: DataFrame, order: list[str], test_share: float = 0.2) -> DataFrame:
    """Add ``split``: the last ceil(share * n) rows of a series are its test rows."""
    w = Window.partitionBy("series_id").orderBy(*order)
    whole = Window.partitionBy("series_id")
    n = F.count(F.lit(1)).over(whole)
    position = F.row_number().over(w)
    return df.withColumn(
        "split",
        F.when(position <= n - F.ceil(F.lit(test_share) * n), "train").otherwise("test"),
    )


def hashed_split(key: list[Column], seed: int, test_percent: int = 20) -> Column:
    """Random split decided by a hash of the row's key.

    Stateless: the same row lands on the same side whatever the partitioning, and a
    recomputed partition after a lost executor agrees with the first run.
    """
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key], F.lit(str(seed))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < test_percent, "test").otherwise("train")


def contiguous_folds(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Add ``fold`` 0..k-1: unshuffled blocks in time order whose sizes differ by at most one."""
    w = Window.partitionBy("series_id").orderBy(*order)
    return df.withColumn("fold", (F.ntile(k).over(w) - 1).cast("int"))
