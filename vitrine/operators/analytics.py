"""Search statistics, rollups and activity, over all tenants at once.

The ``keys`` argument names the grouping beyond the day or query: none for the
whole service, ``shop_domain`` for one answer per tenant.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import numeric as N
from vitrine.functions import predicates as P
from vitrine.functions import sizing


def in_period(events: DataFrame, as_of: datetime, days: int = 7, shop: str | None = None) -> DataFrame:
    return events.filter(P.all_of([P.since_days("created_at", as_of, days), P.tenant(shop)]))


def daily_stats(events: DataFrame, *keys: str) -> DataFrame:
    """Counts per day. A NULL result count is neither with nor without results."""
    return (
        events.groupBy(*keys, F.to_date("created_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_searches"),
            F.count_if(F.col("results_count") > 0).alias("searches_with_results"),
            F.count_if(F.col("results_count") == 0).alias("searches_no_results"),
            N.rounded_average(F.col("results_count")).alias("avg_results"),
        )
        .orderBy(F.desc("date"), *keys)
    )


def query_counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys, "query").agg(
        F.count(F.lit(1)).alias("search_count"),
        N.rounded_average(F.col("results_count")).alias("avg_results"),
        F.max("created_at").alias("last_searched"),
    )


def top_queries(events: DataFrame, limit: int = 20, *keys: str) -> DataFrame:
    """Most frequent queries, overall or per tenant; ties go by the query text."""
    counted = query_counts(events, *keys)
    if not keys:
        return counted.orderBy(F.desc("search_count"), "query").limit(limit)
    order = Window.partitionBy(*keys).orderBy(F.desc("search_count"), "query")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def recent_searches(events: DataFrame, limit: int = 50) -> DataFrame:
    return (
        events.select("id", "query", F.coalesce("results_count", F.lit(0)).alias("results_count"), "created_at")
        .orderBy(F.desc_nulls_first("created_at"), F.desc("id"))
        .limit(limit)
    )


def summary(events: DataFrame, *keys: str) -> DataFrame:
    """Totals and zero-result share. Here a NULL result count is without results.

    Queries are counted first, so distinct counting costs one shuffle of
    pre-aggregated rows.
    """
    none = F.coalesce("results_count", F.lit(0)) == 0
    per_query = events.groupBy(*keys, "query").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(none).alias("without"),
        F.sum(F.coalesce("results_count", F.lit(0))).alias("results"),
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    without = F.coalesce(F.sum("without"), F.lit(0))
    return per_query.groupBy(*keys).agg(
        total.cast("bigint").alias("total_searches"),
        F.count("query").alias("unique_queries"),
        without.cast("bigint").alias("no_results_count"),
        N.rounded_ratio(F.coalesce(F.sum("results"), F.lit(0)), total).alias("avg_results"),
        N.percentage(without, total).alias("no_results_percentage"),
    )


def daily_rollup(searches: DataFrame, store: str = "store_id", top: int = 5) -> DataFrame:
    """One row per store and day: volume, users, engagement and its top queries.

    Rates are percentages of the day's searches; a NULL result count is zero.
    """
    dated = searches.withColumn("date", F.to_date("created_at"))
    clicked = F.col("clicked_product_id").isNotNull()
    per_session = dated.groupBy(store, "date", "session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("results_count", F.lit(0))).alias("results"),
        F.count_if(F.coalesce("results_count", F.lit(0)) == 0).alias("zero"),
        F.count_if(clicked).alias("clicks"),
        F.sum("time_to_click_ms").alias("click_ms"),
        F.count("time_to_click_ms").alias("timed"),
        F.sum("clicked_position").alias("positions"),
        F.count("clicked_position").alias("placed"),
    )
    total = F.sum("n")
    measures = per_session.groupBy(store, "date").agg(
        total.cast("bigint").alias("total_searches"),
        F.count("session_id").alias("unique_users"),
        N.rounded_ratio(F.sum("results"), total).alias("avg_results_per_search"),
        N.percentage(F.sum("zero"), total, 2).alias("zero_results_rate"),
        N.percentage(F.sum("clicks"), total, 2).alias("click_through_rate"),
        N.rounded_ratio(F.sum("click_ms"), F.sum("timed"), 0).cast("int").alias("avg_time_to_click_ms"),
        N.rounded_ratio(F.sum("positions"), F.sum("placed")).alias("avg_clicked_position"),
    )
    counted = dated.groupBy(store, "date", "query").agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy(store, "date").orderBy(F.desc("count"), "query")
    best = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    listed = best.groupBy(store, "date").agg(
        F.array_sort(F.collect_list(F.struct("rank", "query", "count"))).alias("ranked")
    )
    as_json = F.to_json(F.transform("ranked", lambda r: F.struct(r["query"].alias("query"), r["count"].alias("count"))))
    return measures.join(listed.select(store, "date", as_json.alias("top_queries")), [store, "date"])


def click_details(searches: DataFrame, products: DataFrame) -> DataFrame:
    """Clicks with the clicked product's fields; searches without a click are left out.

    Clicks are counted per store and product before the join, so a product
    clicked by everyone is one row of it.
    """
    clicks = (
        searches.filter(F.col("clicked_product_id").isNotNull())
        .groupBy(F.col("clicked_product_id").alias("product_id"))
        .agg(F.count(F.lit(1)).alias("clicks"), F.min("clicked_position").alias("best_position"))
    )
    return sizing.lookup(clicks, products, ["product_id"])


def tenant_activity(events: DataFrame, tenants: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Searches per tenant in the last hours; tenants without any are inactive."""
    counted = (
        events.filter(P.within_hours("created_at", as_of, hours))
        .groupBy("shop_domain")
        .agg(F.count(F.lit(1)).alias("recent_searches"))
    )
    joined = tenants.select("shop_domain").distinct().join(counted, "shop_domain", "left").fillna(0, ["recent_searches"])
    active = F.col("recent_searches") > 0
    return joined.withColumns({"active": active, "status": F.when(active, "active").otherwise("inactive")})


def last_pings(pings: DataFrame) -> DataFrame:
    return pings.groupBy("shop_domain").agg(F.max("pinged_at").alias("last_seen"))


def tenant_liveness(pings: DataFrame, tenants: DataFrame, as_of: datetime, hours: int = 48) -> DataFrame:
    """``active`` when the last ping is under ``hours`` old, ``inactive`` after,
    ``never_activated`` without one."""
    seen = tenants.select("shop_domain").distinct().join(last_pings(pings), "shop_domain", "left")
    active = F.coalesce(P.within_hours("last_seen", as_of, hours), F.lit(False))
    status = F.when(F.col("last_seen").isNull(), "never_activated").when(active, "active").otherwise("inactive")
    return seen.select("shop_domain", "last_seen", active.alias("active"), status.alias("status"))
