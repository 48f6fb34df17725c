"""Plans, usage and billing cycles, for all tenants in one job."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import jsonfields as J
from vitrine.functions import sizing
from vitrine.operators import coverage, merge

CYCLE_DAYS = 30


def _today(as_of: date) -> Column:
    return F.lit(as_of).cast("date")


def cycle_due(as_of: date) -> Column:
    return F.col("search_reset_date") <= F.date_sub(_today(as_of), CYCLE_DAYS)


def reset_cycles(subscriptions: DataFrame, as_of: date) -> DataFrame:
    """Start a new cycle for subscriptions whose reset date is 30 or more days back."""
    due = cycle_due(as_of)
    today = _today(as_of)
    fresh = {
        "searches_this_month": F.lit(0).cast("bigint"),
        "search_reset_date": today,
        "billing_cycle_start": today,
        "billing_cycle_end": F.date_add(today, CYCLE_DAYS),
    }
    # All new values look at the old reset date.
    return subscriptions.select(
        *[F.when(due, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in subscriptions.columns]
    )


def reset_counters(subscriptions: DataFrame, as_of: date) -> DataFrame:
    """Monthly counter reset alone, leaving the billing cycle."""
    due = cycle_due(as_of)
    return subscriptions.withColumns(
        {
            "searches_this_month": F.when(due, F.lit(0)).otherwise(F.col("searches_this_month")).cast("bigint"),
            "search_reset_date": F.when(due, _today(as_of)).otherwise(F.col("search_reset_date")),
        }
    )


def usage_from_events(events: DataFrame, usage_type: str = "search") -> DataFrame:
    """Daily counters from search events."""
    dated = events.withColumn("usage_date", F.to_date("created_at"))
    return dated.groupBy("shop_domain", F.lit(usage_type).alias("usage_type"), "usage_date").agg(
        F.count(F.lit(1)).alias("usage_count")
    )


def usage_since_reset(subscriptions: DataFrame, usage: DataFrame, usage_type: str = "search") -> DataFrame:
    """Usage of one type since each tenant's reset date; 0 without any.

    Days before the earliest reset of all are not read, and a tenant's other days leave the
    usage side as one row, from which the tenant takes those since its own reset.
    """
    since = subscriptions.select("shop_domain", "search_reset_date")
    earliest = since.agg(F.min("search_reset_date")).scalar()
    used = usage.filter((F.col("usage_type") == usage_type) & (F.col("usage_date") >= earliest))
    daily = used.groupBy("shop_domain", "usage_date").agg(F.sum("usage_count").cast("bigint").alias("n"))
    history = daily.groupBy("shop_domain").agg(F.collect_list(F.struct("usage_date", "n")).alias("days"))
    counted = F.filter("days", lambda d: d["usage_date"] >= F.col("search_reset_date"))
    total = F.aggregate(counted, F.lit(0).cast("bigint"), lambda sum_, d: sum_ + d["n"])
    return since.join(history, "shop_domain", "left").select(
        "shop_domain", F.coalesce(total, F.lit(0).cast("bigint")).alias("current_searches")
    )


def plan_limits(
    subscriptions: DataFrame,
    plans: DataFrame,
    catalog: DataFrame,
    usage: DataFrame,
    as_of: date | None = None,
    tenants: DataFrame | None = None,
) -> DataFrame:
    """Usage against the plan's caps per tenant (-1 is unlimited).

    Products may reach their cap; searches may not. With ``as_of`` overdue
    cycles are reset first, and those of ``tenants`` (``shop_domain``) that have no
    subscription are checked against the default plan, from ``as_of`` on.
    """
    if tenants is not None:
        if as_of is None:
            raise ValueError("new subscriptions need as_of, the day they start")
        subscriptions = merge.subscribe_new(subscriptions, tenants, plans, as_of)
    current = subscriptions if as_of is None else reset_cycles(subscriptions, as_of)
    caps = plans.select(
        F.col("id").alias("plan_id"), F.col("name").alias("plan"), "max_products",
        F.col("max_searches_per_month").alias("max_searches"),
    )
    joined = (
        current.select("shop_domain", "plan_id")
        .join(sizing.small_side(caps), "plan_id", "left")
        .join(coverage.product_counts(catalog), "shop_domain", "left")
        .join(usage_since_reset(current, usage), "shop_domain", "left")
        .withColumn("current_products", F.coalesce("products", F.lit(0)).cast("bigint"))
    )
    over_products = (F.col("max_products") != -1) & (F.col("current_products") > F.col("max_products"))
    over_searches = (F.col("max_searches") != -1) & (F.col("current_searches") >= F.col("max_searches"))
    flagged = joined.withColumns(
        {
            "products_exceeded": F.coalesce(over_products, F.lit(False)),
            "searches_exceeded": F.coalesce(over_searches, F.lit(False)),
        }
    )
    return flagged.select(
        F.col("shop_domain").alias("shop"),
        "plan",
        "current_products",
        "max_products",
        "current_searches",
        "max_searches",
        "products_exceeded",
        "searches_exceeded",
        (F.col("products_exceeded") | F.col("searches_exceeded")).alias("upgrade_required"),
    )


def limits_document(limits: DataFrame) -> DataFrame:
    return limits.select("shop", J.document(*limits.columns).alias("limits"))


def count_searches(subscriptions: DataFrame, events: DataFrame) -> DataFrame:
    """Add each tenant's number of search events to its monthly counter."""
    counted = events.groupBy("shop_domain").agg(F.count(F.lit(1)).alias("_n"))
    joined = subscriptions.join(counted, "shop_domain", "left")
    bumped = F.coalesce("searches_this_month", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return joined.withColumn("searches_this_month", bumped.cast("bigint")).select(*subscriptions.columns)


def plan_distribution(plans: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Subscribers per active plan, plans without any included.

    Subscriptions are counted before the join; a popular plan is one row of it.
    """
    counted = subscriptions.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    offered = plans.filter("active").select(F.col("id").alias("plan_id"), "name", "price")
    joined = offered.join(counted, "plan_id", "left")
    return (
        joined.groupBy("name", "price")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("user_count"))
        .orderBy(F.asc_nulls_last("price"), "name")
    )


def _rename_pairs(plans: DataFrame, renames: DataFrame) -> DataFrame:
    ids = plans.select("name", "id")
    old = ids.select(F.col("name").alias("old_name"), F.col("id").alias("old_id"))
    new = ids.select(F.col("name").alias("new_name"), F.col("id").alias("new_id"))
    return renames.join(old, "old_name", "left").join(new, "new_name", "left")


def migrate_plans(subscriptions: DataFrame, plans: DataFrame, renames: DataFrame) -> DataFrame:
    """Move subscribers of renamed plans; a pair with an unknown name moves nobody."""
    pairs = _rename_pairs(plans, renames).filter("old_id IS NOT NULL AND new_id IS NOT NULL")
    moves = pairs.select(F.col("old_id").alias("plan_id"), "new_id")
    joined = subscriptions.join(sizing.small_side(moves), "plan_id", "left")
    return joined.withColumn("plan_id", F.coalesce("new_id", "plan_id")).select(*subscriptions.columns)


def migration_report(subscriptions: DataFrame, plans: DataFrame, renames: DataFrame) -> DataFrame:
    """Outcome per rename: moved users, or why nobody moved."""
    users = subscriptions.groupBy(F.col("plan_id").alias("old_id")).agg(F.count(F.lit(1)).alias("users"))
    joined = _rename_pairs(plans, renames).join(users, "old_id", "left")
    status = (
        F.when(F.col("old_id").isNull(), "old_plan_missing")
        .when(F.col("new_id").isNull(), "new_plan_missing")
        .when(F.col("users").isNull(), "no_users")
        .otherwise("migrated")
    )
    moved = F.when(status == "migrated", F.col("users")).otherwise(F.lit(0)).cast("bigint")
    return joined.select("old_name", "new_name", status.alias("status"), moved.alias("migrated_users"))


def backfill_cycle_end(subscriptions: DataFrame, as_of: date) -> DataFrame:
    end = F.date_add(_today(as_of), CYCLE_DAYS)
    return subscriptions.withColumn("billing_cycle_end", F.coalesce("billing_cycle_end", end))


def backfill_count(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.agg(F.count_if(F.col("billing_cycle_end").isNull()).alias("updated_rows"))


