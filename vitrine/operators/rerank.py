"""Business re-ranking and filtering of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import predicates as P

# Enough decimals to hold a six-decimal similarity times every boost exactly.
SCORE_PLACES = 12


def _boost(condition: Column, factor: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(float(factor))).otherwise(F.lit(1.0))


def _reorder(results: DataFrame, score: Column) -> DataFrame:
    """Order by the new score within a request; equal scores keep their prior order."""
    scored = results.withColumn("final_score", F.round(score, SCORE_PLACES))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "rank")
    return scored.withColumn("final_rank", F.row_number().over(order))


def storefront_rerank(
    results: DataFrame,
    preferred_range: tuple[float, float] | None = None,
    stock_boost: float = 1.1,
    range_boost: float = 1.05,
) -> DataFrame:
    """Boost products that are available and stocked, lie in the preferred price
    range, or are popular (a percentage; NULL or 0 leaves the score alone).

    ``results`` has ``query_id, rank, similarity, available, inventory_quantity,
    price_min, price_max, popularity_score``.
    """
    score = F.col("similarity").cast("double")
    score = score * _boost(F.col("available") & P.stocked(), stock_boost)
    if preferred_range is not None:
        low, high = preferred_range
        score = score * _boost((F.col("price_min") >= low) & (F.col("price_max") <= high), range_boost)
    score = score * (1 + F.coalesce(F.col("popularity_score").cast("double"), F.lit(0.0)) / 100)
    return _reorder(results, score)


def assistant_rerank(
    results: DataFrame,
    stock_boost: float = 1.2,
    price_range: tuple[float, float] | None = None,
    vendors: list[str] | None = None,
    range_boost: float = 1.1,
    vendor_boost: float = 1.15,
) -> DataFrame:
    """Boost stocked products, a closed price range and chosen vendors.

    ``results`` has ``query_id, rank, similarity, price, vendor, inventory``.
    """
    score = F.col("similarity").cast("double") * _boost(P.stocked("inventory"), stock_boost)
    if price_range:
        score = score * _boost(P.price_between(*price_range), range_boost)
    if vendors:
        score = score * _boost(P.any_of("vendor", vendors), vendor_boost)
    return _reorder(results, score)


def business_stages(
    max_price: float | None = None,
    min_price: float | None = None,
    tags: list[str] | None = None,
    vendors: list[str] | None = None,
    in_stock_only: bool = True,
) -> list[tuple[str, Column]]:
    """The filters in use, in their order of application."""
    stages = [
        ("max_price", P.price_between(high=max_price)),
        ("min_price", P.price_between(low=min_price)),
        ("tags", P.any_tag(tags)),
        ("vendors", P.any_of("vendor", vendors)),
        ("in_stock", P.stocked("inventory") if in_stock_only else None),
    ]
    return [(name, F.coalesce(test, F.lit(False))) for name, test in stages if test is not None]


def business_filter(results: DataFrame, **filters) -> DataFrame:
    return results.filter(P.all_of(test for _, test in business_stages(**filters)))


def filter_funnel(results: DataFrame, keys: list[str], **filters) -> DataFrame:
    """Rows left after each filter stage, all stages counted in one pass."""
    passed = F.lit(True)
    counts = [F.count(F.lit(1)).alias("original_count")]
    for name, test in business_stages(**filters):
        passed = passed & test
        counts.append(F.count_if(passed).alias(f"after_{name}"))
    return results.groupBy(*keys).agg(*counts)
