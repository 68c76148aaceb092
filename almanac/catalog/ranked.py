"""Sorts, limits and top-k (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog import panels as P
from almanac.catalog.panels import check, query, r, settle
from almanac.catalog.projections import backtest_steps
from almanac.operators import distribution, metrics, summary, topk
from almanac.plans import forecasts, tuning
from almanac.sources.tables import read_table


@query("t1_sorted_by_period", check("select series_id, year, month, value from sm order by 1, 2, 3", "sm"))
def sorted_by_period(spark, d):
    return P.supplier_monthly(spark, d).orderBy("series_id", "year", "month")


@query("t2_top_and_bottom_months", check(
    f"""select series_id, month, {r("mean", "mean")}, side, cast(rank as int) as rank from (
    select series_id, month, mean, 'highest' as side, row_number() over (partition by series_id order by mean desc, month) as rank from bm
    union all select series_id, month, mean, 'lowest', row_number() over (partition by series_id order by mean, month) from bm)
    where rank <= 3""", "sm", bm="select series_id, month, avg(value) as mean from sm group by 1, 2"))
def top_and_bottom_months(spark, d):
    return settle(summary.top_and_bottom_months(P.supplier_monthly(spark, d)))


@query("t4_best_results", check(
    f"""select series_id, model_key, {r("r2", "r2")} from lb
    order by r2 desc nulls last, series_id, model_key limit 10""", "sm", **backtest_steps("sm")))
def best_results(spark, d):
    board = metrics.leaderboard(forecasts.backtest_baselines(P.supplier_monthly(spark, d)), ["series_id"])
    top = tuning.top_results(board, 10, score="r2", tiebreak=["series_id", "model_key"])
    return settle(top.select("series_id", "model_key", "r2"))


@query("t5_history_per_user", """
    select user_id, event_id, ts, value, cast(rank as int) as rank from (
    select *, row_number() over (partition by user_id order by ts desc, event_id) as rank from events) where rank <= 50""")
def history_per_user(spark, d):
    history = read_table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    newest = [F.desc("ts"), F.asc("event_id")]
    return topk.first_per_key(history, ["user_id"], newest, 50, ["event_id"])


@query("t5_history_newest", "select user_id, event_id, ts, value from events order by ts desc, event_id limit 10")
def history_newest(spark, d):
    history = read_table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return topk.first_rows(history, [F.desc("ts"), F.asc("event_id")], 10)


@query("t6_best_model", check(
    f"""select series_id, model_key, {r("r2", "r2")} from (select *, row_number() over
    (partition by series_id order by r2 desc, model_key) as k from lb where r2 is not null) where k = 1""",
    "sm", **backtest_steps("sm")))
def best_model(spark, d):
    board = metrics.leaderboard(forecasts.backtest_baselines(P.supplier_monthly(spark, d)), ["series_id"])
    return settle(metrics.best_model(board, ["series_id"]))


@query("t7_first_outliers", """
    select event_type as series_id, event_id, value from events join (
      select event_type as t, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by 1)
    on event_type = t where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) order by event_id limit 5""")
def first_outliers(spark, d):
    outliers = distribution.iqr_outliers(P.event_values(spark, d)).select("series_id", "event_id", "value")
    return topk.first_rows(outliers, [F.asc("event_id")], 5)
