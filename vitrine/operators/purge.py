"""Deletes: tenant erasure, retention, flagged and orphaned rows."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import jsonfields as J
from vitrine.functions import sizing


def settings_tenant(settings: DataFrame, tenants: DataFrame) -> DataFrame:
    """Settings rows owned by the given tenants.

    A key belongs to a tenant when it is the tenant's name, alone or followed
    by ``:`` or ``_`` and more. Each key offers all its such beginnings, so the
    match is an equi-join.
    """
    cuts = F.filter(
        F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), i, F.lit(1)).isin(":", "_")
    )
    heads = F.array_append(F.transform(cuts, lambda i: F.substring(F.col("key"), F.lit(1), i - 1)), F.col("key"))
    offered = settings.select("key", F.explode(heads).alias("shop_domain"))
    return offered.join(tenants.select("shop_domain"), "shop_domain", "left_semi")


def erase_tenants(tables: dict[str, DataFrame], tenants: DataFrame) -> dict[str, DataFrame]:
    """Tables without the tenants' rows. A table named ``settings`` goes by its keys,
    the others by ``shop_domain``."""
    gone = sizing.small_side(tenants.select("shop_domain").distinct())
    kept = {}
    for name, table in tables.items():
        if name == "settings":
            owned = sizing.small_side(settings_tenant(table, gone).select("key").distinct())
            kept[name] = table.join(owned, "key", "left_anti")
        else:
            kept[name] = table.join(gone, "shop_domain", "left_anti")
    return kept


def erased_counts(tables: dict[str, DataFrame], tenants: DataFrame) -> DataFrame:
    """Rows an erasure removes, per tenant and table (0 where there are none)."""
    gone = sizing.small_side(tenants.select("shop_domain").distinct())
    parts = []
    for name, table in tables.items():
        owned = settings_tenant(table, gone) if name == "settings" else table.join(gone, "shop_domain", "left_semi")
        parts.append(owned.select("shop_domain", F.lit(name).alias("table_name")))
    everything = reduce(DataFrame.unionByName, parts)
    counted = everything.groupBy("shop_domain").agg(
        *[F.count_if(F.col("table_name") == name).alias(name) for name in tables]
    )
    return gone.join(counted, "shop_domain", "left").fillna(0, list(tables))


def drop_orphans(table: DataFrame) -> DataFrame:
    return table.filter(F.col("shop_domain").isNotNull())


def retain_usage(usage: DataFrame, resets: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Drop usage older than ``days`` for the tenants whose cycle resets."""
    due = resets.select("shop_domain").distinct().withColumn("_due", F.lit(True))
    fresh = F.col("usage_date") >= F.date_sub(F.lit(as_of).cast("date"), days)
    return usage.join(due, "shop_domain", "left").filter(F.col("_due").isNull() | fresh).drop("_due")


def drop_flagged(table: DataFrame, key: str = "test") -> DataFrame:
    """Remove rows whose metadata sets ``key`` to true."""
    return table.filter(~J.flag("metadata", key))


def reset_setting(settings: DataFrame, key: str) -> DataFrame:
    return settings.filter(F.col("key") != key)
