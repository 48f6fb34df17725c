"""Distinct counts as state that merges: per day now, for any trailing window later.

The exact form numbers the distinct values densely and keeps a bitmap per day and
bucket of numbers; a window's count is that of the union of its days' bitmaps.
The approximate form keeps a HyperLogLog sketch per day, needs no numbering, and
works on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import skew
from vitrine.operators.search import ranked_within

LOG_SKETCH = 12


def numbered(values: DataFrame, value: str, known: DataFrame | None = None) -> DataFrame:
    """(value, number): distinct values numbered from 0 without gaps, whatever their amount.
    Values ``known`` under a number keep it; new ones follow the greatest."""
    new = values.select(F.col(value).alias("value")).filter("value IS NOT NULL").distinct()
    if known is None:
        return ranked_within(new, [], [F.col("value")], "number").withColumn("number", F.col("number") - 1)
    new = new.join(known, "value", "left_anti")
    first = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).scalar()
    return known.unionByName(ranked_within(new, [], [F.col("value")], "number").withColumn("number", F.col("number") - 1 + first))


def daily_bitmaps(events: DataFrame, value: str, numbers: DataFrame, moment: str, *keys: str) -> DataFrame:
    """State: per keys, date and bucket of numbers, the bitmap of the values seen. A value is counted
    once per day before it meets its number, so a very frequent one is a few rows of the join."""
    seen = events.filter(F.col(value).isNotNull()).select(*keys, F.to_date(moment).alias("date"), F.col(value).alias("value")).distinct()
    found = skew.join(seen, numbers, ["value"], "inner", spread=[*keys, "date"])
    bucket = F.bitmap_bucket_number("number")
    return found.groupBy(*keys, "date", bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def _windows(state: DataFrame, days: int) -> DataFrame:
    """Each day's state under every day whose trailing window of ``days`` holds it, up to the last day."""
    last = state.agg(F.max("date")).scalar()
    until = F.least(F.date_add("date", days - 1), last)
    return state.withColumn("date", F.explode(F.sequence("date", until, F.expr("INTERVAL 1 DAY"))))


def trailing_distinct(state: DataFrame, days: int, *keys: str, name: str = "distinct_values") -> DataFrame:
    """Per keys and date, how many values the last ``days`` days (the date's included) have seen. Dates on
    which a key's window has no value are left out."""
    merged = _windows(state, days).groupBy(*keys, "date", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return merged.groupBy(*keys, "date").agg(F.sum(F.bitmap_count("bitmap")).cast("bigint").alias(name))


def daily_sketches(events: DataFrame, value: str, moment: str, *keys: str, log_size: int = LOG_SKETCH) -> DataFrame:
    """State: per keys and date a sketch of the values seen."""
    dated = events.withColumn("date", F.to_date(moment))
    return dated.groupBy(*keys, "date").agg(F.hll_sketch_agg(value, log_size).alias("sketch"))


def trailing_estimate(state: DataFrame, days: int, *keys: str, name: str = "distinct_values") -> DataFrame:
    """The same from sketches: the estimate's standard error is about 1.04 / sqrt(2 ** log_size)."""
    merged = _windows(state, days).groupBy(*keys, "date").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*keys, "date", F.hll_sketch_estimate("sketch").alias(name))


def within_error(estimate: Column, exact: Column, log_size: int = LOG_SKETCH, errors: float = 4.0) -> Column:
    """Whether an estimate lies within so many standard errors of the exact count (or one value) of it."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), F.lit(errors * 1.04 / 2 ** (log_size / 2)) * exact)
