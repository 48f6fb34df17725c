"""Per-tenant search configuration with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import jsonfields as J
from vitrine.functions import text as X
from vitrine.sources import seeds

CONFIG_KEY = "ai_search"


def config_columns(value: Column, defaults: dict) -> dict[str, Column]:
    """Typed configuration fields of a JSON document; an absent key takes its default."""
    return {
        "ai_search_enabled": J.flag(value, "ai_search_enabled", defaults["ai_search_enabled"]),
        "autocorrect": J.flag(value, "autocorrect", defaults["autocorrect"]),
        "results_limit": J.string(value, "results_limit", defaults["results_limit"]),
        "similarity_threshold": J.number(value, "similarity_threshold", defaults["similarity_threshold"]),
        "exclude_out_of_stock": J.flag(value, "exclude_out_of_stock", defaults["exclude_out_of_stock"]),
        "exclude_archived": J.flag(value, "exclude_archived", defaults["exclude_archived"]),
        "language": J.string(value, "language", defaults["language"]),
    }


def tenant_config(settings: DataFrame, tenants: DataFrame, defaults: dict | None = None) -> DataFrame:
    """One configuration row per tenant. A tenant with nothing stored takes
    ``defaults``; a key absent from a stored document takes that key's own default."""
    keyed = tenants.select("shop_domain").distinct().withColumn("key", F.concat_ws(":", "shop_domain", F.lit(CONFIG_KEY)))
    joined = keyed.join(settings.select("key", "value"), "key", "left")
    none = config_columns(F.col("value"), defaults or seeds.DEFAULT_CONFIG)
    some = config_columns(F.col("value"), seeds.ABSENT_KEY_CONFIG)
    fields = {name: F.when(F.col("value").isNull(), none[name]).otherwise(some[name]) for name in none}
    return joined.select("shop_domain", *[column.alias(name) for name, column in fields.items()])


def with_config(requests: DataFrame, config: DataFrame, defaults: dict | None = None) -> DataFrame:
    """``requests`` with their tenant's configuration; a tenant that has no row in
    ``config`` takes ``defaults``."""
    joined = requests.join(config.withColumn("_known", F.lit(True)), "shop_domain", "left")
    values = defaults or seeds.DEFAULT_CONFIG
    filled = {
        name: F.when(F.col("_known"), F.col(name)).otherwise(F.lit(value).cast(config.schema[name].dataType))
        for name, value in values.items()
        if name in config.columns
    }
    return joined.withColumns(filled).drop("_known")


def ping_writes(pings: DataFrame) -> DataFrame:
    """Storefront pings (``shop`` as a URL or host, ``value``, ``updated_at``) as
    settings writes for ``merge.last_write_wins``; pings without a shop are dropped."""
    host = X.tenant_host(F.col("shop"))
    named = pings.filter(F.coalesce(host, F.lit("")) != "")
    return named.select(X.settings_key(host, "extension_last_active").alias("key"), "value", "updated_at")
