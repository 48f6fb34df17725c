"""Most frequent items of a growing log: mergeable summaries, then an exact second pass.

A frequent-items summary keeps a bounded number of counters per batch; summaries
add up over batches. Their estimates are off by a known share of all rows, so the
items that may be among the top ones are few, and only these are counted exactly.
Where the exact counts show that an item outside the summary might belong to the
top ones (no item is frequent), all items are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import sizing

TRACKED = 4096
# A summary with m counters is off by at most this share of the rows, divided by m.
_ERROR = 3.5


def summarise(events: DataFrame, item: str, *keys: str, tracked: int = TRACKED) -> DataFrame:
    """State per keys: a summary of the items (NULL is none) and their number."""
    rows = events.filter(F.col(item).isNotNull())
    return rows.groupBy(*keys).agg(F.expr(f"approx_top_k_accumulate(`{item}`, {int(tracked)})").alias("summary"), F.count(F.lit(1)).alias("rows"))


def _counters(tracked: int) -> int:
    """Counters of a summary that tracks so many items: a power of two, three quarters used."""
    return 1 << (-(-4 * tracked // 3) - 1).bit_length()


def candidates(states: DataFrame, limit: int, tracked: int = TRACKED) -> tuple[list[str], int]:
    """Items that may be among the ``limit`` most frequent, and the greatest count that an item
    outside any summary can have. At most ``tracked`` items."""
    merged = states.agg(F.expr(f"approx_top_k_combine(summary, {int(tracked)})").alias("summary"), F.sum("rows").alias("rows"))
    facts = merged.select(F.expr(f"approx_top_k_estimate(summary, {int(tracked)})").alias("items"), "rows").first()
    items = sorted(facts["items"] or [], key=lambda r: -r["count"])
    slack = int(-(-_ERROR * (facts["rows"] or 0) // _counters(tracked)))
    floor = items[limit - 1]["count"] - 2 * slack if len(items) >= limit else 0
    return [r["item"] for r in items if r["count"] >= floor], slack if len(items) >= tracked // 2 else 0


def top(events: DataFrame, states: DataFrame, item: str, limit: int, tracked: int = TRACKED) -> DataFrame:
    """The events of the candidates only, if these surely hold the ``limit`` most frequent items;
    else all events. Count and order them as usual."""
    names, slack = candidates(states, limit, tracked)
    wanted = sizing.small_side(events.sparkSession.createDataFrame([(n,) for n in names], f"`{item}` string"))
    some = events.join(wanted, item, "left_semi")
    if slack:
        exact = some.groupBy(item).count().orderBy(F.desc("count")).limit(limit).agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("n")).first()
        if exact["n"] < limit or exact["least"] <= slack:
            return events.filter(F.col(item).isNotNull())
    return some
