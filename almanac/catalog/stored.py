"""Sources and sinks (S). What a query writes goes to a fresh shared folder and is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog import panels as P
from almanac.catalog.joins import overall_metrics, stored_metrics
from almanac.catalog.panels import COVARIATES, check, query, r, settle
from almanac.catalog.projections import backtest_steps
from almanac.operators.relate import daily_with_covariates
from almanac.operators.summary import latest_same_month
from almanac.plans import forecasts
from almanac.session import shared_dir
from almanac.sources import raw, sinks
from almanac.sources.tables import read_csv, read_table


@query("s1_tolerant_scan", """
    select series_id, cast(try_strptime(t, '%Y-%m-%d %H:%M:%S') as date) as date, try_cast(v as double) as value from (
    select event_type as series_id, case when hour(ts) = 0 then 'Time' when hour(ts) = 1 then strftime(ts, '%Y-%m-%d')
    else strftime(ts, '%Y-%m-%d %H:%M:%S') end as t, case when value < 1 then 'n/a' else cast(value as varchar) end as v
    from events) where try_strptime(t, '%Y-%m-%d %H:%M:%S') is not null and try_cast(v as double) is not null""")
def tolerant_scan(spark, d):
    """Observations written as text with header words, dates without time and words for numbers."""
    hour = F.hour(F.col("ts").cast("timestamp"))
    stamp = F.date_format("ts", raw.RAW_TIMESTAMP_FORMAT)
    text = P.event_values(spark, d).select(
        "series_id",
        F.when(hour == 0, "Time").when(hour == 1, F.substring(stamp, 1, 10)).otherwise(stamp).alias("date"),
        F.when(F.col("value") < 1, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
    )
    path = shared_dir(spark, "raw")
    text.write.csv(path)
    return raw.clean_raw_daily(raw.read_raw_daily(spark, path, with_series=True))


@query("s2_payload_rows", check(
    f"select series_id, date, {', '.join(r(c, c) for c in COVARIATES)} from cd", "cd"))
def payload_rows(spark, d):
    """Covariates packed into the archive's columnar payloads, one per series and year, and unpacked."""
    names = {name: field for field, name in raw.PAYLOAD_FIELDS.items()}
    days = F.sort_array(F.collect_list(F.struct("date", *names)))
    packed = (
        P.covariates_daily(spark, d)
        .groupBy("series_id", F.year("date").alias("year"))
        .agg(days.alias("days"))
        .select(
            "series_id",
            F.to_json(
                F.struct(
                    F.struct(
                        F.transform("days.date", lambda x: x.cast("string")).alias("time"),
                        *[F.col(f"days.{name}").alias(field) for name, field in names.items()],
                    ).alias("daily")
                )
            ).alias("payload"),
        )
    )
    return settle(raw.payload_rows(raw.parse_payloads(packed, "payload")))


@query("s3_typed_csv_scan", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def typed_csv_scan(spark, d):
    path = shared_dir(spark, "csv")
    sinks.write_table(read_table(spark, d, "supplier"), path, "csv")
    return read_csv(spark, path, "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE")


@query("s3_typed_parquet_scan", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def typed_parquet_scan(spark, d):
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("s4_partitioned_sink", check(
    f"select year, count(*) as n, {r('sum(value)', 'total', 2)} from sm group by 1", "sm"))
def partitioned_sink(spark, d):
    path = shared_dir(spark, "monthly")
    sinks.write_table(P.supplier_monthly(spark, d), path, partition_by=["year"])
    return settle(
        spark.read.parquet(path).groupBy(F.col("year").cast("int").alias("year")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
        ), 2)


@query("s5_without_covariates", check(
    """select series_id, date, value, cast(year(date) as int) as year, cast(month(date) as int) as month,
    cast(day(date) as int) as day from qd""", "qd"))
def without_covariates(spark, d):
    return daily_with_covariates(P.quantity_daily(spark, d), None)


_OVERALL = """select model_key, {}, {}, {}, round(least(100, greatest(0, r2_score * 100)), 1) as accuracy_percent from (
    select model_key, avg(abs(actual - predicted)) as mae, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse,
    1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(case when predicted is not null then actual end)
    * count(predicted)) as r2_score from {{}} group by 1)""".format(r("mae", "mae"), r("rmse", "rmse"), r("r2_score", "r2_score"))


@query("s6_metrics_upsert", check(
    f"""select * from ({_OVERALL.format('bt')}) where model_key not in ('lag_12', 'last_value')
    union all select * from ({_OVERALL.format('xbt')}) where model_key in ('lag_12', 'last_value')""",
    "qm", "sm", **backtest_steps("qm"), **backtest_steps("sm", "x")))
def metrics_upsert(spark, d):
    stored = stored_metrics(spark, overall_metrics(P.quantity_monthly(spark, d)))
    fresh = overall_metrics(P.supplier_monthly(spark, d)).filter(F.col("model_key").isin("lag_12", "last_value"))
    return settle(sinks.upsert_metrics(stored, fresh))


@query("s7_metrics_overwrite", check(_OVERALL.format("bt"), "qm", **backtest_steps("qm")))
def metrics_overwrite(spark, d):
    path = shared_dir(spark, "metrics")
    sinks.overwrite_metrics(overall_metrics(P.quantity_monthly(spark, d)).withColumn("mae", F.lit(0.0)), path)
    sinks.overwrite_metrics(overall_metrics(P.quantity_monthly(spark, d)), path)
    return settle(sinks.read_metrics(spark, path))


# The climatology-with-trend forecast of every request, as a step over a monthly panel.
FORECAST_STEPS = {
    "fy": "select series_id, month, year, avg(value) as v, sum(value) as t, count(value) as c from pm group by 1, 2, 3",
    "ft": """select series_id, month, sum(t) / sum(c) as mean, sum(c) as nr, count(*) as ny, avg(year) as my,
        regr_sxy(v, year) / (regr_sxx(v, year) + 1e-8) as slope from fy group by 1, 2""",
    "fc": """select request_id, user_id, priority as series_id, rq.year, rq.month, greatest(0.0, case when nr >= 5 and ny >= 2
        then coalesce(mean, 100) + slope * (rq.year - my) else coalesce(mean, 100) * (1 + 0.004 * (rq.year - 2020)) end) as predicted
        from rq left join ft on ft.series_id = rq.priority and ft.month = rq.month""",
}


@query("s9_history_append", check(
    f"""select user_id, fc.year, fc.month, cast(null as int) as day, {r("predicted", "predicted_value", 2)},
    l.v as historical_avg from fc left join (select series_id, month, arg_max(value, year) as v from pm group by 1, 2) l
    on l.series_id = fc.series_id and l.month = fc.month
    union all select fc.user_id, fc.year, fc.month, rq.day, {r("predicted / day(last_day(rq.date))", "p", 2)}, null
    from fc join rq on rq.request_id = fc.request_id""", "pm", "rq", **FORECAST_STEPS))
def history_append(spark, d):
    """Monthly forecasts beside the month's last value, then each day's share of them, in one history."""
    requests = P.lookback_requests(spark, d)
    monthly = P.price_monthly(spark, d)
    path = shared_dir(spark, "history")
    asked = requests.withColumnRenamed("priority", "series_id")
    scored = forecasts.climatology_trend_forecast(asked, monthly).join(
        latest_same_month(monthly).select("series_id", "month", "latest_value"), ["series_id", "month"], "left"
    )
    sinks.append_history(sinks.history_rows(scored.drop("day"), F.col("user_id"), F.col("latest_value")), path)
    daily = scored.withColumn("predicted", F.col("predicted") / F.dayofmonth(F.last_day("date")))
    sinks.append_history(sinks.history_rows(daily, F.col("user_id"), F.lit(None)), path)
    return settle(sinks.read_history(spark, path).drop("created_at"), 2)
