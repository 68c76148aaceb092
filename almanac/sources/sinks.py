"""Table, metrics and history writers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.session import shared_dir
from almanac.sources import commits

METRIC_FIELDS = ["mae", "rmse", "r2_score", "accuracy_percent"]
METRICS_SCHEMA = "model_key STRING, " + ", ".join(f"{m} DOUBLE" for m in METRIC_FIELDS)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table.

    Partitioned output is rebalanced on the partition key first: rows of one folder come
    together in few files, and AQE splits a folder that is too large for one writer.
    """
    writer = df.hint("rebalance", *partition_by) if partition_by else df
    out = writer.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        out = out.option("header", True)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.save(path)


# Removes the shuffle files of a query when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Rows that a join would drop are left out before its shuffle, by a Bloom filter of the smaller side, which has a condition.
BLOOM = "spark.sql.optimizer.runtime.bloomFilter"
BLOOM_BITS = (1 << 16, 1 << 26)


def sifting(keys: int) -> dict[str, str]:
    """Settings for ``stored`` by which joins with a table of so many keys are sifted; beyond some 8 million keys less and less."""
    least, most = BLOOM_BITS
    return {
        f"{BLOOM}.enabled": "true", f"{BLOOM}.applicationSideScanSizeThreshold": "0", f"{BLOOM}.creationSideThreshold": "1g",
        f"{BLOOM}.expectedNumItems": str(max(keys, 1)), f"{BLOOM}.numBits": str(min(max(8 * keys, least), most)),
    }


def stored(df: DataFrame, purpose: str, settings: dict[str, str] | None = None) -> DataFrame:
    """The frame as a table in the shared folder.

    For a panel that several branches of a job read: it is computed once, whatever columns
    each branch needs, and a lost executor costs a re-read instead of a re-run. The shuffle
    files behind it go as soon as the table stands, so that a job of several steps holds
    those of one step at a time. ``settings`` hold while it is computed.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    settings = {SHUFFLE_CLEANUP: "true", **(settings or {})}
    before = {k: spark.conf.get(k, "false" if k == SHUFFLE_CLEANUP else None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(path)


def upsert_metrics(stored: DataFrame, fresh: DataFrame, key: str | list[str] = "model_key") -> DataFrame:
    """Rows of ``fresh`` replace those with the same key; all others stay."""
    keys = [key] if isinstance(key, str) else key
    return stored.join(fresh, keys, "left_anti").unionByName(fresh.select(*stored.columns))


def overwrite_metrics(metrics: DataFrame, path: str) -> None:
    """These rows as the whole table. Until they are complete, and if the job is lost, the old ones count."""
    commits.commit(metrics.sparkSession, path, lambda _: metrics)


def merge_metrics(fresh: DataFrame, path: str) -> None:
    """The rows merged into the table, which may be absent; no other writer's rows are lost."""
    spark = fresh.sparkSession

    def merged(now: str | None) -> DataFrame:
        return upsert_metrics(spark.read.schema(METRICS_SCHEMA).json(now), fresh) if now else fresh

    commits.commit(spark, path, merged)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    now = commits.current(spark, path)
    if now is None:
        raise FileNotFoundError(f"no metrics in {path}")
    return spark.read.schema(METRICS_SCHEMA).json(now)


def history_rows(scored: DataFrame, user: Column, historical: Column, created_at: Column | None = None) -> DataFrame:
    """Scored requests in the layout of the prediction history."""
    day = F.col("day") if "day" in scored.columns else F.lit(None)
    return scored.select(
        user.alias("user_id"),
        "year",
        "month",
        day.cast("int").alias("day"),
        F.col("predicted").alias("predicted_value"),
        historical.cast("double").alias("historical_avg"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
    )


HISTORY_SCHEMA = (
    "user_id BIGINT, year INT, month INT, day INT, predicted_value DOUBLE, historical_avg DOUBLE, created_at TIMESTAMP"
)


def append_history(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append to the history: whether the rows were added. A job that may run again names its ``batch``, which is added once."""
    return commits.append_batch(rows, path, batch or uuid.uuid4().hex)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All batches of the history that were completed."""
    return commits.read_batches(spark, path, HISTORY_SCHEMA)
