"""Catalogue sources: scans, payloads, lookups and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.functions import jsonfields as J
from vitrine.functions import sizing
from vitrine.functions import text as X

DISPLAY_COLUMNS = [
    "product_id", "shop_domain", "title", "description", "price", "vendor", "category", "tags", "metadata",
]


def read_catalog(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet catalogue with its declared schema; only ``columns`` are read."""
    scan = spark.read.schema(schemas.PRODUCT_EMBEDDINGS).parquet(path)
    return scan.select(*columns) if columns else scan


def with_tenant(catalog: DataFrame) -> DataFrame:
    """One tenant key per row: the column, else the shop named in the metadata."""
    return catalog.withColumn(
        "shop_domain", F.coalesce("shop_domain", F.get_json_object("metadata", "$.shop"))
    )


def read_payload(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Catalogue payloads ``{shop, products: [...]}``, one row per product.

    One payload per file, or one per line without ``multi_line``; only the
    latter lets a large file be split over tasks.
    """
    files = spark.read.schema(schemas.CATALOG_PAYLOAD).json(path, multiLine=multi_line)
    products = files.select(F.col("shop").alias("shop_domain"), F.posexplode("products").alias("ordinal", "p"))
    return products.select(
        "shop_domain",
        "p.product_id",
        "p.title",
        F.coalesce("p.description", F.lit("")).alias("description"),
        F.col("p.price").cast("decimal(10,2)").alias("price"),
        "p.vendor",
        "p.category",
        "p.product_type",
        X.parse_tags(F.col("p.tags")).alias("tags"),
        "p.metadata",
        F.transform(
            "p.variants",
            lambda v: F.struct(
                v["id"].alias("id"),
                v["title"].alias("title"),
                v["price"].try_cast("decimal(10,2)").alias("price"),
            ),
        ).alias("variants"),
        "p.images",
        F.col("ordinal").cast("long").alias("ordinal"),
    )


def lookup_products(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the products named in ``wanted`` (its columns are the lookup key)."""
    return catalog.join(sizing.small_side(wanted.distinct()), wanted.columns, "left_semi")


def product_details(catalog: DataFrame) -> DataFrame:
    """Product detail rows with typed defaults for the metadata fields."""
    return catalog.select(
        F.col("product_id").alias("id"),
        "title",
        "description",
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
        "vendor",
        "category",
        "tags",
        J.flag("metadata", "in_stock").alias("in_stock"),
        J.integer("metadata", "stock_quantity").alias("stock_quantity"),
        J.string_list("metadata", "sizes").alias("sizes"),
    )


def first_ids(catalog: DataFrame, n: int = 10) -> DataFrame:
    return catalog.select("product_id").orderBy("product_id").limit(n)


def newest_first() -> list[Column]:
    return [F.desc_nulls_first("updated_at"), F.asc("product_id")]


def listing(catalog: DataFrame, shop: str | None = None, limit: int | None = None) -> DataFrame:
    """Products with their sync status, newest first."""
    rows = catalog if not shop else catalog.filter(F.col("shop_domain") == shop)
    has_vector = F.col("embedding").isNotNull()
    listed = rows.select(
        "product_id",
        "shop_domain",
        "title",
        F.col("price").cast("double").alias("price"),
        "vendor",
        has_vector.alias("has_embedding"),
        J.flag("metadata", "needs_resync").alias("needs_resync"),
        "updated_at",
        F.when(has_vector, "ready").otherwise("needs_sync").alias("status"),
    ).orderBy(*newest_first())
    return listed if limit is None else listed.limit(limit)
