"""How much of a catalogue is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import predicates as P


def _counts() -> list[Column]:
    present = P.has_embedding()
    return [
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(present).alias("indexed_products"),
        F.count_if(~present).alias("missing_embeddings"),
    ]


def index_coverage(catalog: DataFrame, *keys: str) -> DataFrame:
    return catalog.groupBy(*keys).agg(*_counts())


def product_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("shop_domain").agg(F.count(F.lit(1)).alias("products"))


def sync_status(catalog: DataFrame, samples: int = 3) -> DataFrame:
    """Coverage per tenant with an alert and the first few missing titles.

    Only the sampled rows of a tenant meet in a list.
    """
    counted = index_coverage(catalog, "shop_domain")
    missing = catalog.filter(P.missing_embedding()).select("shop_domain", "title", "product_id")
    order = Window.partitionBy("shop_domain").orderBy("title", "product_id")
    first = missing.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= samples)
    titles = first.groupBy("shop_domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda s: s["title"]).alias("sample_products")
    )
    joined = counted.join(titles, "shop_domain", "left")
    missing_some = F.col("missing_embeddings") > 0
    return joined.select(
        "shop_domain",
        "total_products",
        F.col("indexed_products").alias("with_embeddings"),
        F.col("missing_embeddings").alias("needs_sync"),
        missing_some.alias("show_alert"),
        F.when(missing_some, "needs_sync").otherwise("ready").alias("status"),
        F.coalesce("sample_products", F.array().cast("array<string>")).alias("sample_products"),
    )


def vector_quality(catalog: DataFrame, dim: int) -> DataFrame:
    """Vector check: NULL, wrong length and zero vectors counted in one pass."""
    vector = F.col("embedding")
    wrong = vector.isNotNull() & (F.size(vector) != dim)
    zero = vector.isNotNull() & ~F.exists(vector, lambda x: x != 0)
    return catalog.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(vector.isNull()).alias("null_vectors"),
        F.count_if(wrong).alias("wrong_length"),
        F.count_if(zero).alias("zero_vectors"),
    )


def repaired_vectors(catalog: DataFrame) -> DataFrame:
    """A vector column of the wrong type is replaced by an empty one of the right type."""
    wanted = "array<float>"
    if "embedding" in catalog.columns and catalog.schema["embedding"].dataType.simpleString() == wanted:
        return catalog
    return catalog.withColumn("embedding", F.lit(None).cast(wanted))


def ensure_columns(table: DataFrame, schema) -> DataFrame:
    """Add the schema's missing columns as typed NULLs; idempotent."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in table.columns}
    return table.withColumns(missing) if missing else table
