"""Explicit schemas of the service's tables and payloads."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR_DIM = 1536

PRODUCT_EMBEDDINGS = T.StructType(
    [
        T.StructField("product_id", T.StringType(), False),
        T.StructField("shop_domain", T.StringType()),
        T.StructField("title", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("price", T.DecimalType(10, 2)),
        T.StructField("vendor", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

SEARCH_ANALYTICS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("query", T.StringType(), False),
        T.StructField("results_count", T.IntegerType()),
        T.StructField("clicked_product_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("shop_domain", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

APP_SETTINGS = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

SUBSCRIPTION_PLANS = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType(), False),
        T.StructField("price", T.DecimalType(10, 2), False),
        T.StructField("max_products", T.IntegerType(), False),
        T.StructField("max_searches_per_month", T.IntegerType(), False),
        T.StructField("features", T.StringType()),
        T.StructField("active", T.BooleanType()),
    ]
)

USER_SUBSCRIPTIONS = T.StructType(
    [
        T.StructField("shop_domain", T.StringType(), False),
        T.StructField("plan_id", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("searches_this_month", T.LongType()),
        T.StructField("search_reset_date", T.DateType()),
        T.StructField("billing_cycle_start", T.DateType()),
        T.StructField("billing_cycle_end", T.DateType()),
    ]
)

USAGE_TRACKING = T.StructType(
    [
        T.StructField("shop_domain", T.StringType(), False),
        T.StructField("usage_type", T.StringType(), False),
        T.StructField("usage_date", T.DateType()),
        T.StructField("usage_count", T.LongType()),
    ]
)

CATALOG_PAYLOAD = T.StructType(
    [
        T.StructField("shop", T.StringType()),
        T.StructField(
            "products",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("product_id", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField("description", T.StringType()),
                        T.StructField("price", T.DoubleType()),
                        T.StructField("vendor", T.StringType()),
                        T.StructField("category", T.StringType()),
                        T.StructField("product_type", T.StringType()),
                        T.StructField("tags", T.StringType()),
                        T.StructField("metadata", T.StringType()),
                        T.StructField(
                            "variants",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("id", T.StringType()),
                                        T.StructField("title", T.StringType()),
                                        T.StructField("price", T.StringType()),
                                    ]
                                )
                            ),
                        ),
                        T.StructField("images", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
