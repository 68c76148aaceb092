"""The series panels and request tables drawn from the shared test tables.

Each panel exists twice: as a DataFrame, and as a common table expression for the
DuckDB check, written independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators import rollup
from almanac.operators.relate import daily_with_covariates, monthly_with_covariates
from almanac.sources.tables import OPTIONAL_COVARIATES, REQUIRED_COVARIATES, daily_series, read_table

COVARIATES = REQUIRED_COVARIATES + OPTIONAL_COVARIATES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its DuckDB check where SQL can express it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _nudge(digits: int) -> float:
    return 10.0 ** -(digits + 4)


def settle(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every DOUBLE column so that two engines agree to the digit.

    A mean often ends exactly in the middle between two rounded values, give or take the
    last bit. A nudge far below the kept digits settles which way it goes; adding 0.0
    turns -0.0 into 0.0. The checks do the same, see ``r``.
    """
    types = dict(df.dtypes)

    def rounded(c: str):
        n = special.get(c, digits)
        return (F.round(F.col(c) + F.lit(_nudge(n)), n) + F.lit(0.0)).alias(c)

    return df.select(*[rounded(c) if types[c] == "double" else F.col(c) for c in df.columns])


# --- Panels -----------------------------------------------------------------------------


def quantity_daily(spark: SparkSession, d: str) -> DataFrame:
    """Dense daily series: quantity shipped by return flag."""
    return daily_series(read_table(spark, d, "lineitem"), "l_returnflag", "l_shipdate", F.sum("l_quantity"))


def partial_daily(spark: SparkSession, d: str) -> DataFrame:
    """The same restricted to finished lines: NULL on days that have none."""
    done = F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")))
    return daily_series(read_table(spark, d, "lineitem"), "l_returnflag", "l_shipdate", done)


def covariates_daily(spark: SparkSession, d: str) -> DataFrame:
    """Five daily covariates by return flag, in the roles of weather measurements."""
    return (
        read_table(spark, d, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.avg("l_linenumber").alias("temperature"),
            F.avg(F.round(F.col("l_discount") * 100)).alias("humidity"),
            F.avg(F.round(F.col("l_tax") * 100)).alias("wind_speed"),
            F.avg("l_quantity").alias("cloud_cover"),
            F.avg(F.round("l_extendedprice")).alias("surface_pressure"),
        )
    )


def combined_daily(spark: SparkSession, d: str) -> DataFrame:
    return daily_with_covariates(quantity_daily(spark, d), covariates_daily(spark, d))


def quantity_monthly(spark: SparkSession, d: str) -> DataFrame:
    return rollup.monthly_sum(quantity_daily(spark, d))


def combined_monthly(spark: SparkSession, d: str) -> DataFrame:
    return monthly_with_covariates(quantity_monthly(spark, d), rollup.monthly_means(covariates_daily(spark, d)))


def price_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Monthly order value by priority; some (series, month) cells are missing."""
    orders = read_table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("value")
    )
    return rollup.monthly_sum(orders, digits=2)


def supplier_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Many series: monthly quantity by supplier."""
    lines = read_table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("series_id"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("value")
    )
    return rollup.monthly_sum(lines)


def delivered_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Monthly rows as delivered, with duplicates and missing values.

    One row per customer, month and order status, the status then dropped; pending months
    have no value yet.
    """
    return (
        read_table(spark, d, "orders")
        .groupBy(
            F.col("o_custkey").cast("string").alias("series_id"),
            F.year("o_orderdate").cast("int").alias("year"),
            F.month("o_orderdate").cast("int").alias("month"),
            "o_orderstatus",
        )
        .agg(F.floor(F.sum("o_totalprice") / 50000).cast("double").alias("value"))
        .select(
            "series_id", "year", "month",
            F.when(F.col("o_orderstatus") != "P", F.col("value")).alias("value"),
        )
    )


def event_values(spark: SparkSession, d: str) -> DataFrame:
    """Row-level values in few, very large series."""
    return read_table(spark, d, "events").select(
        F.col("event_type").alias("series_id"), F.col("event_id"), F.col("ts"), F.col("value")
    )


def lookback_requests(spark: SparkSession, d: str) -> DataFrame:
    """Forecast requests: each order asks for its own calendar day one year later."""
    day = F.date_add(F.col("o_orderdate").cast("date"), 365)
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("priority"),
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("flag"),
        day.alias("date"),
        F.year(day).cast("int").alias("year"),
        F.month(day).cast("int").alias("month"),
        F.dayofmonth(day).cast("int").alias("day"),
    )


def unchecked_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests with all the faults a caller can make, derived from order keys."""
    key = F.col("o_orderkey")
    model = (
        F.when(F.col("o_orderstatus") == "F", "gradient_boosting_weather")
        .when(F.col("o_orderstatus") == "O", "daily_random_forest")
        .otherwise("sarimax")
    )
    return read_table(spark, d, "orders").select(
        key.alias("request_id"),
        (F.lit(1975) + key % 130).cast("int").alias("year"),
        (key % 14).cast("int").alias("month"),
        F.when(F.col("o_orderstatus") == "O", (F.col("o_custkey") % 33).cast("int")).alias("day"),
        F.when(F.col("o_orderpriority") == "5-LOW", "unheard_of").otherwise(model).alias("model_key"),
    )


# --- The same in DuckDB -----------------------------------------------------------------

CTES = {
    "qd": """select l_returnflag as series_id, cast(l_shipdate as date) as date, sum(l_quantity) as value
        from lineitem group by 1, 2""",
    "pd": """select l_returnflag as series_id, cast(l_shipdate as date) as date,
        sum(case when l_linestatus = 'F' then l_quantity end) as value from lineitem group by 1, 2""",
    "cd": """select l_returnflag as series_id, cast(l_shipdate as date) as date,
        avg(l_linenumber) as temperature, avg(round(l_discount * 100)) as humidity,
        avg(round(l_tax * 100)) as wind_speed, avg(l_quantity) as cloud_cover,
        avg(round(l_extendedprice)) as surface_pressure from lineitem group by 1, 2""",
    "dd": """select qd.series_id, qd.date, value, temperature, humidity, wind_speed, cloud_cover, surface_pressure,
        cast(year(qd.date) as int) as year, cast(month(qd.date) as int) as month, cast(day(qd.date) as int) as day
        from qd join cd on qd.series_id = cd.series_id and qd.date = cd.date""",
    "qm": """select series_id, cast(year(date) as int) as year, cast(month(date) as int) as month, sum(value) as value
        from qd group by 1, 2, 3""",
    "cm": """select series_id, cast(year(date) as int) as year, cast(month(date) as int) as month,
        avg(temperature) as temperature, avg(humidity) as humidity, avg(wind_speed) as wind_speed,
        avg(cloud_cover) as cloud_cover, avg(surface_pressure) as surface_pressure from cd group by 1, 2, 3""",
    "mm": """select qm.series_id, qm.year, qm.month, value, temperature, humidity, wind_speed, cloud_cover,
        surface_pressure, make_date(qm.year, qm.month, 1) as date
        from qm join cm on qm.series_id = cm.series_id and qm.year = cm.year and qm.month = cm.month""",
    "pm": """select o_orderpriority as series_id, cast(year(o_orderdate) as int) as year,
        cast(month(o_orderdate) as int) as month, round(sum(o_totalprice), 2) as value from orders group by 1, 2, 3""",
    "sm": """select cast(l_suppkey as varchar) as series_id, cast(year(l_shipdate) as int) as year,
        cast(month(l_shipdate) as int) as month, sum(l_quantity) as value from lineitem group by 1, 2, 3""",
    "dm": """select series_id, year, month, case when st <> 'P' then v end as value from (
        select cast(o_custkey as varchar) as series_id, cast(year(o_orderdate) as int) as year,
        cast(month(o_orderdate) as int) as month, o_orderstatus as st,
        cast(floor(sum(o_totalprice) / 50000) as double) as v from orders group by 1, 2, 3, 4)""",
    "rq": """select request_id, user_id, priority, flag, date, cast(year(date) as int) as year,
        cast(month(date) as int) as month, cast(day(date) as int) as day from (
        select o_orderkey as request_id, o_custkey as user_id, o_orderpriority as priority,
        case o_custkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as flag,
        cast(o_orderdate as date) + 365 as date from orders)""",
    "ur": """select o_orderkey as request_id, cast(1975 + o_orderkey % 130 as int) as year,
        cast(o_orderkey % 14 as int) as month,
        case when o_orderstatus = 'O' then cast(o_custkey % 33 as int) end as day,
        case when o_orderpriority = '5-LOW' then 'unheard_of' when o_orderstatus = 'F' then 'gradient_boosting_weather'
             when o_orderstatus = 'O' then 'daily_random_forest' else 'sarimax' end as model_key from orders""",
}

NEEDS = {"dd": ["qd", "cd"], "qm": ["qd"], "cm": ["cd"], "mm": ["qd", "qm", "cd", "cm"]}


def check(body: str, *panels: str, **steps: str) -> str:
    """A statement over the named panels; ``steps`` add further expressions, in order."""
    names: list[str] = []
    for p in panels:
        for n in [*NEEDS.get(p, []), p]:
            if n not in names:
                names.append(n)
    parts = [f"{n} as ({CTES[n]})" for n in names] + [f"{n} as ({s})" for n, s in steps.items()]
    return f"with {', '.join(parts)} {body}" if parts else body


def r(expr: str, name: str, digits: int = 4) -> str:
    """The DuckDB side of ``settle`` for one column."""
    return f"round(({expr}) + {_nudge(digits)!r}, {digits}) + 0.0 as {name}"
