"""Tolerant scans: delimited text full of junk, and columnar JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Timestamp layout of a raw daily observation.
RAW_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# What counts as a number. The cast alone would also accept a trailing type letter ("1.5d"),
# infinities and NaN, which no statistic here has a use for.
NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?)\s*$"

# Payload field -> covariate name, fixed by the archive's response format.
PAYLOAD_FIELDS = {
    "temperature_2m_mean": "temperature",
    "relative_humidity_2m_mean": "humidity",
    "wind_speed_10m_mean": "wind_speed",
    "cloud_cover_mean": "cloud_cover",
    "surface_pressure_mean": "surface_pressure",
}

PAYLOAD_SCHEMA = "daily STRUCT<time: ARRAY<STRING>, {}>".format(
    ", ".join(f"{field}: ARRAY<DOUBLE>" for field in PAYLOAD_FIELDS)
)


def read_raw_daily(spark: SparkSession, path: str, with_series: bool = False) -> DataFrame:
    """Raw delimited observations as text columns; nothing is skipped by position.

    Junk and header lines go later, because their timestamp does not parse. That keeps
    the file splittable, unlike skipping the first lines.
    """
    schema = "date STRING, value STRING"
    if with_series:
        schema = "series_id STRING, " + schema
    return spark.read.schema(schema).option("header", False).csv(path)


def clean_raw_daily(df: DataFrame) -> DataFrame:
    """Text observations to typed ones: unparsable rows dropped, timestamps cut to dates."""
    number = F.when(F.col("value").rlike(NUMBER_PATTERN), F.col("value").try_cast("double"))
    typed = df.withColumn(
        "date", F.to_date(F.try_to_timestamp(F.col("date"), F.lit(RAW_TIMESTAMP_FORMAT)))
    ).withColumn("value", number)
    return typed.dropna(subset=["date", "value"])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(path)


def parse_payloads(df: DataFrame, text: str) -> DataFrame:
    """Parse a column of payload text; the other columns stay."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.from_json(F.col(text), PAYLOAD_SCHEMA).alias("payload")).select(
        *others, "payload.daily"
    )


def payload_rows(df: DataFrame) -> DataFrame:
    """Parallel arrays to rows: one per element of ``daily.time``, fields renamed, NULLs kept."""
    others = [c for c in df.columns if c != "daily"]
    arrays = [F.col("daily.time").alias("time")] + [
        F.col(f"daily.{field}").alias(name) for field, name in PAYLOAD_FIELDS.items()
    ]
    flat = df.select(*others, *arrays)
    names = ["time", *PAYLOAD_FIELDS.values()]
    return (
        flat.select(*others, F.inline(F.arrays_zip(*names)))
        .withColumn("date", F.try_to_date(F.col("time"), "yyyy-MM-dd"))
        .select(*others, "date", *PAYLOAD_FIELDS.values())
    )
