"""Data-quality report of rows as delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.scoring import completeness_band
from almanac.operators.distribution import finite, iqr_fences
from almanac.operators.relate import join_series


def quality_report(rows: DataFrame, panel: bool = False) -> DataFrame:
    """Data-quality report of monthly rows as delivered: (series_id, year, month, value).

    Delivered rows may repeat, so nothing bounds how many a series has. Identical rows
    collapse to a counter first, and everything else comes from these; the quartiles from
    ``iqr_fences``, which spreads a busy series over many tasks. A ``panel`` has one row per
    month, so that the calendar bounds a series and ``percentile`` does. Rows without a
    series form a report of their own; values that are not finite count as missing.
    """
    # Grouping treats NULL values as equal, as the duplicate count needs.
    value = F.when(finite(F.col("value")), F.col("value"))
    distinct = rows.groupBy("series_id", "year", "month", "value").agg(F.count(F.lit(1)).alias("copies")).withColumn("v", value)
    v, copies = F.col("v"), F.col("copies")
    known = F.sum(F.when(v.isNotNull(), copies).otherwise(0))
    mean = F.try_divide(F.sum(v * copies), known)
    figures = distinct.groupBy("series_id").agg(
        F.sum(copies).alias("total_records"),
        F.sum(F.when(v.isNull(), copies).otherwise(0)).alias("missing"),
        (F.sum(copies) - F.count(F.lit(1))).alias("duplicates"),
        F.min(F.struct("year", "month")).alias("first"),
        F.max(F.struct("year", "month")).alias("last"),
        ((F.max("year") - F.min("year") + 1) * 12).alias("expected_months"),
        mean.alias("mean"),
        known.alias("known"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        *([F.percentile(v, [0.25, 0.5, 0.75], copies).alias("q")] if panel else []),
    )
    if not panel:
        fences = iqr_fences(distinct, "v", "copies").select("series_id", F.array("q1", "median", "q3").alias("q"))
        # A series without any value has no quartiles, but it still has a report.
        figures = join_series(figures, fences, "left")
    q1, median, q3 = (F.col("q")[i] for i in range(3))
    marked = join_series(distinct.select("series_id", "v", "copies"), figures)
    outside = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
    # The spread is taken from the mean, which the first pass gave: sums of squares would cancel.
    apart = F.sum(copies * (v - F.col("mean")) * (v - F.col("mean")))
    second = marked.groupBy("series_id").agg(
        F.sum(F.when(outside, copies).otherwise(0)).alias("outliers"),
        F.sqrt(F.when(F.max("known") > 1, apart / (F.max("known") - 1))).alias("std"),
    )
    completeness = F.col("total_records") * 100.0 / F.col("expected_months")
    return join_series(figures, second).select(
        "series_id", "total_records", "missing", "duplicates",
        F.format_string("%d-%02d", F.col("first.year"), F.col("first.month")).alias("first_period"),
        F.format_string("%d-%02d", F.col("last.year"), F.col("last.month")).alias("last_period"),
        "mean", median.alias("median"), "std", "min", "max", (q3 - q1).alias("iqr"),
        "outliers", (F.col("outliers") * 100.0 / F.col("total_records")).alias("outlier_percent"),
        "expected_months", completeness.alias("completeness"),
        completeness_band(completeness).alias("status"),
    )
