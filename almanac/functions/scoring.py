"""Score, band and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the R2 quality bands, best first; any other score is "weak".
R2_BANDS = [(0.8, "excellent"), (0.6, "good"), (0.4, "moderate")]
R2_DISPLAY_BANDS = [(0.75, "excellent"), (0.65, "good")]
# Lower bounds of the completeness bands in percent.
COMPLETENESS_BANDS = [(95.0, "excellent"), (80.0, "good")]


def non_negative(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def accuracy_percent(r2: Column) -> Column:
    """R2 as a percentage held within 0..100, one decimal."""
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), r2 * 100)), 1)


def accuracy_percent_from_mae(mae: Column, average: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 100 - F.try_divide(mae, average) * 100), 1)


def accuracy_with_fallback(r2: Column, mae: Column, average: Column) -> Column:
    """Accuracy from R2 where known, else from the error relative to a positive average."""
    positive = F.when(average > 0, average)
    from_mae = F.when(positive.isNotNull() & mae.isNotNull(), accuracy_percent_from_mae(mae, positive))
    return F.when(r2.isNotNull(), accuracy_percent(r2)).otherwise(from_mae)


def band(x: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """Name of the first band whose lower bound ``x`` exceeds."""
    expr = None
    for low, name in bounds:
        expr = F.when(x > low, name) if expr is None else expr.when(x > low, name)
    return F.when(x.isNotNull(), expr.otherwise(otherwise))


def r2_band(r2: Column) -> Column:
    return band(r2, R2_BANDS, "weak")


def r2_display_band(r2: Column) -> Column:
    return band(r2, R2_DISPLAY_BANDS, "weak")


def completeness_band(percent: Column) -> Column:
    return band(percent, COMPLETENESS_BANDS, "needs attention")


def period_label(year: Column, month: Column, day: Column) -> Column:
    """``dd/mm/yyyy`` for a day, ``m/yyyy`` for a month (day is NULL)."""
    return F.when(day.isNull(), F.format_string("%d/%d", month, year)).otherwise(
        F.format_string("%02d/%02d/%d", day, month, year)
    )


def presented(x: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(x, F.lit(0.0)), digits)
