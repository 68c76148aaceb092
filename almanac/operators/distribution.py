"""Histograms, exact quantiles, outliers and box-plot figures over row-level data.

These take raw rows, where one series may hold a large share of everything, so no step
gathers a series into one task. Values that are not finite count as missing. Joins with the few
figures of each series are left to AQE, which broadcasts what is small and splits what is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.relate import join_series
from almanac.sources.sinks import stored

# Slots of a counting round: what a window over a series' slots may hold.
SLOTS = 4096


def finite(c: Column) -> Column:
    """Whether a value is a number: not NULL, not NaN, not infinite."""
    return F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))


def histogram(df: DataFrame, bins: int, value: str = "value") -> DataFrame:
    """Equal-width counts per series between its minimum and maximum, empty bins included.

    The last bin is closed on the right. A constant series gets a range of one around it.
    """
    known = df.filter(finite(F.col(value)))
    lo, hi = F.col("lo"), F.col("hi")
    bounds = (
        known.groupBy("series_id")
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        .select(
            "series_id",
            F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
            F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"),
        )
    )
    width = (hi - lo) / bins
    position = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / width)).cast("int")
    counted = (
        join_series(known, bounds)
        .groupBy("series_id", position.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    slots = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = counted.withColumnsRenamed({"series_id": "s", "bin": "b"})
    same = F.col("series_id").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))
    return slots.join(filled, same, "left").select(
        "series_id",
        "bin",
        (lo + F.col("bin") * width).alias("left_edge"),
        (lo + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _magnitude(v: Column) -> Column:
    """An integer that never falls where the value rises, the same for values within a factor of four of each other."""
    steps = F.floor(F.log2(F.abs(v)) / 2) + 600
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * steps).cast("long")


def _counted_slots(weights: DataFrame, sought: DataFrame, slot: Column) -> DataFrame:
    """The ranks of ``sought`` with the slot that holds each, in place of the range that held them."""
    # The ranks of a range are sought together.
    ranges = sought.groupBy("series_id", "lo", "hi", "before").agg(F.collect_list("rank").alias("ranks"))
    inside = weights.join(ranges, "series_id").where(F.col("v").between(F.col("lo"), F.col("hi")))
    counted = inside.groupBy("series_id", F.col("lo").alias("from"), slot.alias("slot")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.first("before").alias("before"), F.first("ranks").alias("ranks"),
    )
    upward = Window.partitionBy("series_id", "from").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("through", F.col("before") + F.sum("c").over(upward))
    start = (F.col("through") - F.col("c")).alias("before")
    return (
        placed.select("series_id", "lo", "hi", start, "through", "held", F.explode("ranks").alias("rank"))
        .where((F.col("rank") < F.col("through")) & (F.col("rank") >= F.col("before")))
        .select("series_id", "rank", "lo", "hi", "before", "held")
    )


def exact_quantiles(df: DataFrame, probs: list[float], value: str = "value", weight: str | None = None, slots: int = SLOTS) -> DataFrame:
    """Interpolated quantiles per series, exact, without gathering a series in one task.

    Equal values fold into counters, which are stored. Every quantile lies between two ranks, and
    each rank is sought in a range of values. While a range holds more than ``slots`` distinct ones, a round
    counts them in slots and the rank moves on to the slot that holds it: first in slots by
    sign and magnitude, so that no outlier can empty the others, then in ``slots`` of equal width between the range's
    least and greatest value. Within a magnitude a round leaves no more than one in ``slots`` of the
    possible numbers, so that a handful of rounds ends it for any values. Then the
    values of a rank's range are put in order. No window holds more than ``slots`` rows.

    ``weight`` names a column that says how often a row counts. The result has the count ``n`` and
    an array ``quantiles``; a series without values has no row.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    # Inside a struct, rows without a series join each other.
    known = df.filter(finite(F.col(value)))
    folded = known.groupBy(F.struct("series_id").alias("series_id"), F.col(value).cast("double").alias("v")).agg(F.sum(times).alias("c"))
    weights = stored(folded, "weights")
    span = weights.groupBy("series_id").agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("held"))
    position = [(F.col("n") - 1) * F.lit(p) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in position for f in (F.floor, F.ceil)]))
    sought = span.select("series_id", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), "held")
    # Halved, the difference of any two numbers is a number.
    share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
    by_width = F.least(F.lit(slots - 1), F.floor(F.coalesce(share, F.lit(0.0)) * slots))
    slot = _magnitude(F.col("v"))
    large = F.col("held") > slots
    while not sought.where(large).isEmpty():
        moved = _counted_slots(weights, sought.where(large), slot)
        # A few rows for each series.
        sought = stored(sought.where(~large).unionByName(moved), "sought")
        slot = by_width
    ranges = sought.groupBy("series_id", "lo", "hi", "before").agg(F.collect_list("rank").alias("ranks"))
    inside = weights.join(ranges, "series_id").where(F.col("v").between(F.col("lo"), F.col("hi")))
    upward = Window.partitionBy("series_id", "lo").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    through = F.col("before") + F.sum("c").over(upward)
    found = (
        inside.withColumn("through", through)
        .select("series_id", "v", "c", "through", F.explode("ranks").alias("rank"))
        .where((F.col("rank") < F.col("through")) & (F.col("rank") >= F.col("through") - F.col("c")))
        .groupBy("series_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    )

    def quantile(x: Column) -> Column:
        lower, upper = (F.col("at")[f(x).cast("long")] for f in (F.floor, F.ceil))
        return lower + (upper - lower) * (x - F.floor(x))

    return found.join(span.select("series_id", "n"), "series_id").select("series_id.series_id", "n", F.array(*[quantile(x) for x in position]).alias("quantiles"))


def iqr_fences(df: DataFrame, value: str = "value", weight: str | None = None) -> DataFrame:
    """Quartiles per series and the bounds 1.5 interquartile ranges beyond them."""
    q = exact_quantiles(df, [0.25, 0.5, 0.75], value, weight)
    q1, q2, q3 = (F.col("quantiles")[i] for i in range(3))
    iqr = q3 - q1
    return q.select(
        "series_id",
        q1.alias("q1"),
        q2.alias("median"),
        q3.alias("q3"),
        (q1 - 1.5 * iqr).alias("low_fence"),
        (q3 + 1.5 * iqr).alias("high_fence"),
    )


def iqr_outliers(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows outside 1.5 interquartile ranges of their series' quartiles."""
    fences = iqr_fences(df, value).select("series_id", "low_fence", "high_fence")
    outside = (F.col(value) < F.col("low_fence")) | (F.col(value) > F.col("high_fence"))
    return df.filter(finite(F.col(value))).transform(join_series, fences).filter(outside).drop("low_fence", "high_fence")


def box_plot(df: DataFrame, value: str = "value") -> DataFrame:
    """Quartiles, whiskers at the last value inside the fences, and the number beyond them."""
    fences = iqr_fences(df, value)
    v = F.col(value)
    inside = v.between(F.col("low_fence"), F.col("high_fence"))
    return (
        df.filter(finite(v))
        .transform(join_series, fences)
        .groupBy("series_id")
        .agg(
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("n_fliers"),
        )
    )
