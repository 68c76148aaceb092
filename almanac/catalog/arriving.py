"""The roll-up over a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.panels import query, settle
from almanac.session import shared_dir
from almanac.sources.tables import read_table
from almanac.streaming import rollup


@query("a1_incremental_daily_totals", """
    select event_type as series_id, cast(ts as date) as date, round(sum(value) + 1e-8, 4) + 0.0 as value, count(value) as n
    from events group by 1, 2
    having cast(ts as date) + interval 2 day <= (select max(ts) from events)""")
def incremental_daily_totals(spark, d):
    """Totals of the days that have closed when the last file has been read."""
    schema = read_table(spark, d, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    observations = files.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    target = shared_dir(spark, "totals")
    rollup.append_available(rollup.daily_totals(observations), target, shared_dir(spark, "progress"))
    return settle(spark.read.parquet(target))
