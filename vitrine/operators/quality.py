"""Retrieval quality: precision and recall against expected products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import numeric as N
from vitrine.functions import sizing


def quality_metrics(results: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits, precision, recall and grade per query.

    ``results`` and ``expected`` have ``query_id, product_id, shop_domain``;
    ``queries`` lists every query, so one without results still gets a row.
    The results are computed once and go to the expected rows, which may be as
    many as the products.
    """
    keys = ["query_id", "product_id", "shop_domain"]
    found = sizing.small_side(results.select(*keys).distinct())
    returned = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"))
    hits = expected.select(*keys).join(found, keys, "left_semi").distinct()
    hits = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    wanted = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    joined = queries.select("query_id").distinct()
    for part in (returned, hits, wanted):
        joined = joined.join(part, "query_id", "left")
    counted = joined.fillna(0, ["returned", "hits", "expected"])
    recall = N.rounded_ratio(F.col("hits"), F.col("expected"), 4)
    grade = F.when(recall >= 0.8, "excellent").when(recall >= 0.5, "acceptable").otherwise("improvable")
    return counted.select(
        "query_id",
        "returned",
        "hits",
        "expected",
        N.rounded_ratio(F.col("hits"), F.col("returned"), 4).alias("precision"),
        recall.alias("recall"),
        grade.alias("grade"),
    )


def quality_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count(F.lit(1)).alias("queries"),
        N.rounded_ratio(F.sum("precision"), F.count(F.lit(1)), 4).alias("mean_precision"),
        N.rounded_ratio(F.sum("recall"), F.count(F.lit(1)), 4).alias("mean_recall"),
    )
