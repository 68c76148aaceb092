"""Incremental daily totals: the same roll-up as in batch, over files as they arrive.

State is one running total per series and open day. A day closes once the watermark has
passed its end; its total is then appended and its state dropped. Rows later than the
watermark are left to the next batch run over the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.sources.raw import NUMBER_PATTERN, RAW_TIMESTAMP_FORMAT


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw delimited observations (series_id, date, value) as text, file by file."""
    return (
        spark.readStream.schema("series_id STRING, date STRING, value STRING")
        .option("header", False)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )


def clean_stream(raw: DataFrame) -> DataFrame:
    """Text rows to (series_id, ts, value); rows that do not parse are dropped."""
    number = F.when(F.col("value").rlike(NUMBER_PATTERN), F.col("value").try_cast("double"))
    return raw.select(
        "series_id",
        F.try_to_timestamp("date", F.lit(RAW_TIMESTAMP_FORMAT)).cast("timestamp").alias("ts"),
        number.alias("value"),
    ).dropna()


def daily_totals(observations: DataFrame, delay: str = "1 day") -> DataFrame:
    """Totals per series and day of a stream (series_id, ts, value)."""
    totals = (
        observations.withWatermark("ts", delay)
        .groupBy("series_id", F.window("ts", "1 day"))
        .agg(F.sum("value").alias("value"), F.count("value").alias("n"))
    )
    return totals.select("series_id", F.to_date("window.start").alias("date"), "value", "n")


def append_available(totals: DataFrame, target: str, checkpoint: str) -> None:
    """Process what has arrived, append the closed days to ``target`` and stop.

    The checkpoint folder carries offsets and state to the next call and must be shared
    by all executors.
    """
    query = (
        totals.writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
