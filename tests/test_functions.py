import math

from pyspark.sql import functions as F

from almanac.functions import calendar as C
from almanac.functions import scoring as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_leap_day_parts(spark):
    parts = C.date_parts(F.to_date(F.lit("2024-02-29")))
    row = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert (row.year, row.month, row.day, row.day_of_year) == (2024, 2, 29, 60)


def test_last_day_of_leap_year_passes_a_full_turn(spark):
    sin, _ = C.cyclic(F.lit(366), 365)
    assert math.isclose(one(spark, sin), math.sin(2 * math.pi * 366 / 365), abs_tol=1e-12)


def test_quarters(spark):
    rows = spark.range(1, 13).select(C.quarter_of("id").alias("q")).collect()
    assert [r.q for r in rows] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_month_counter_is_consecutive_over_new_year(spark):
    assert one(spark, C.month_index(F.lit(2001), F.lit(1)) - C.month_index(F.lit(2000), F.lit(12))) == 1


def test_month_trend_stops_at_zero(spark):
    assert one(spark, C.month_trend(F.lit(1970), F.lit(5))) == 0
    assert one(spark, C.month_trend(F.lit(1980), F.lit(5))) == 16


def test_day_trend(spark):
    assert one(spark, C.day_trend(F.lit(1981), F.lit(10))) == 740


def test_accuracy_is_held_within_bounds(spark):
    assert one(spark, S.accuracy_percent(F.lit(0.7277))) == 72.8
    assert one(spark, S.accuracy_percent(F.lit(-3.0))) == 0.0
    assert one(spark, S.accuracy_percent(F.lit(1.2))) == 100.0


def test_accuracy_falls_back_to_relative_error(spark):
    none = F.lit(None).cast("double")
    assert one(spark, S.accuracy_with_fallback(none, F.lit(45.0), F.lit(180.0))) == 75.0
    assert one(spark, S.accuracy_with_fallback(none, F.lit(45.0), F.lit(0.0))) is None
    assert one(spark, S.accuracy_with_fallback(F.lit(0.5), F.lit(45.0), F.lit(180.0))) == 50.0


def test_bands(spark):
    names = [one(spark, S.r2_band(F.lit(x))) for x in (0.81, 0.8, 0.61, 0.41, 0.4)]
    assert names == ["excellent", "good", "good", "moderate", "weak"]
    assert one(spark, S.r2_display_band(F.lit(0.7))) == "good"
    assert [one(spark, S.completeness_band(F.lit(x))) for x in (95.1, 95.0, 80.0)] == [
        "excellent", "good", "needs attention",
    ]


def test_labels(spark):
    day = S.period_label(F.lit(2024), F.lit(7), F.lit(3))
    month = S.period_label(F.lit(2024), F.lit(7), F.lit(None).cast("int"))
    assert one(spark, day) == "03/07/2024"
    assert one(spark, month) == "7/2024"
