"""Rounding and ratio helpers with one contract for every job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_ratio(total: Column, count: Column, places: int = 2) -> Column:
    """``total / count`` rounded half-up; 0 where the count is 0.

    The quotient is rounded as a decimal: rounding doubles would depend on the
    binary representation of values such as 1.005.
    """
    quotient = F.try_divide(total.cast("double"), count.cast("double"))
    exact = quotient.cast("decimal(28,10)").cast(f"decimal(20,{places})").cast("double")
    return F.coalesce(exact, F.lit(0.0))


def rounded_average(value: Column, places: int = 2) -> Column:
    """Aggregate: average with NULL counted as zero, rounded half-up."""
    return rounded_ratio(F.sum(F.coalesce(value, F.lit(0))), F.count(F.lit(1)), places)


def percentage(part: Column, whole: Column, places: int = 1) -> Column:
    return rounded_ratio(part * F.lit(100), whole, places)


def price_or_zero(price: Column) -> Column:
    return F.coalesce(price.cast("double"), F.lit(0.0))
