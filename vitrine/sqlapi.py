"""Functions that SQL text can call: product search and plan limits.

They are SQL functions over temporary views, so Catalyst plans a query that
calls them like any other. A search through ``search_products`` meets its tenant's
products in a join; for large request tables ``operators.search`` is the better way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.vectors import SIMILARITY_PLACES

_COSINE = """
CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
  / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)), 0D)
"""

_SEARCH = f"""
CREATE OR REPLACE TEMPORARY FUNCTION search_products(query ARRAY<DOUBLE>, shop STRING, threshold DOUBLE, max_results INT)
RETURNS TABLE (product_id STRING, shop_domain STRING, title STRING, price DOUBLE, similarity DOUBLE, rank INT)
RETURN SELECT product_id, shop_domain, title, price, similarity, rank FROM (
  SELECT *, row_number() OVER (ORDER BY similarity DESC, product_id) AS rank FROM (
    SELECT p.product_id, p.shop_domain, p.title, p.price,
           round(cosine_similarity(p.embedding, search_products.query), {SIMILARITY_PLACES}) AS similarity
    FROM vitrine_products p WHERE p.shop_domain = search_products.shop
  ) WHERE similarity >= search_products.threshold
) WHERE rank <= search_products.max_results
"""

_LIMITS = """
CREATE OR REPLACE TEMPORARY FUNCTION check_plan_limits(shop STRING)
RETURNS TABLE (plan STRING, current_products BIGINT, max_products INT, current_searches BIGINT, max_searches INT,
               products_exceeded BOOLEAN, searches_exceeded BOOLEAN, upgrade_required BOOLEAN)
RETURN SELECT l.plan, l.current_products, l.max_products, l.current_searches, l.max_searches,
              l.products_exceeded, l.searches_exceeded, l.upgrade_required
FROM vitrine_limits l WHERE l.shop = check_plan_limits.shop
"""

_DOCUMENT = """
CREATE OR REPLACE TEMPORARY FUNCTION plan_limits_document(shop STRING) RETURNS STRING
RETURN (SELECT max(l.document) FROM vitrine_limits l WHERE l.shop = plan_limits_document.shop)
"""


def register_search(spark: SparkSession, catalog: DataFrame) -> None:
    """``cosine_similarity`` and ``search_products`` over a catalogue (keys, title, price,
    embedding). A threshold below -1 lets every product pass."""
    vectors = catalog.filter("embedding IS NOT NULL").select(
        "product_id", "shop_domain", "title", F.col("price").cast("double").alias("price"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    vectors.createOrReplaceTempView("vitrine_products")
    spark.sql(_COSINE)
    spark.sql(_SEARCH)


def register_limits(spark: SparkSession, limits: DataFrame) -> None:
    """``check_plan_limits`` and ``plan_limits_document`` over the rows of ``metering.plan_limits``."""
    kept = limits.withColumn("document", F.to_json(F.struct(*limits.columns), {"ignoreNullFields": "false"}))
    kept.createOrReplaceTempView("vitrine_limits")
    spark.sql(_LIMITS)
    spark.sql(_DOCUMENT)
