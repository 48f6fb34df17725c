"""Answering a table of search requests end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import jsonfields as J
from vitrine.functions import numeric as N
from vitrine.functions import sizing
from vitrine.operators import search, settings, typos
from vitrine.session import cut_lineage


@dataclass
class Answers:
    """``results``: one row per returned product; ``counts``: one row per answered
    request; ``limited`` and ``disabled``: requests turned away by the plan's
    search limit and by the tenant's configuration."""

    results: DataFrame
    counts: DataFrame
    limited: DataFrame
    disabled: DataFrame


def prepare(
    requests: DataFrame, config: DataFrame, vocabulary: DataFrame, embed: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Requests with corrected text, limit, threshold and query vector.

    ``embed`` adds ``qvec`` to rows that have ``query_id`` and ``corrected_query``.
    """
    configured = settings.with_config(requests, config).filter("ai_search_enabled")
    corrected = typos.correct_queries(configured, vocabulary)
    text = F.when(F.col("autocorrect"), F.col("corrected_query")).otherwise(F.col("query"))
    ready = corrected.withColumns(
        {
            "corrected_query": text,
            "was_corrected": F.col("autocorrect") & F.col("was_corrected"),
            "k": search.effective_limit(F.col("results_limit"), F.col("max_results")),
            "min_similarity": search.threshold_fraction(F.col("similarity_threshold")),
            "in_stock_only": F.col("exclude_out_of_stock"),
        }
    )
    return embed(ready)


def answer(
    requests: DataFrame,
    catalog: DataFrame,
    config: DataFrame,
    vocabulary: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    limits: DataFrame | None = None,
    archived_filter: str = "post",
) -> Answers:
    """Plan limit, configuration gate, typo correction, embedding, top-k within
    the tenant, threshold, archived filter, formatting.

    ``requests``: ``query_id, shop_domain, query, max_results, max_price``. A tenant
    that ``config`` doesn't know is answered with the default configuration.
    The threshold goes before the top-k, where it gives the same rows. Archived
    products leave after the top-k (``post``), so fewer than k rows may remain,
    or before it (``pre``).
    """
    config = sizing.small_side(config)
    limited = requests.limit(0)
    if limits is not None:
        over = sizing.small_side(limits.filter("searches_exceeded").select(F.col("shop").alias("shop_domain")))
        limited = requests.join(over, "shop_domain", "left_semi")
        requests = requests.join(over, "shop_domain", "left_anti")
    disabled = requests.join(config.filter("NOT ai_search_enabled").select("shop_domain"), "shop_domain", "left_semi")
    # The prepared requests are read several times below; prepare them once.
    asked = cut_lineage(prepare(requests, config, vocabulary, embed))

    hidden = J.flag("metadata", "archived")
    source = catalog.withColumn("archived", hidden)
    searched = source
    if archived_filter == "pre":
        excluding = config.filter("exclude_archived").select("shop_domain", F.lit(True).alias("_excluding"))
        searched = source.join(sizing.small_side(excluding), "shop_domain", "left").filter(
            ~(F.coalesce("_excluding", F.lit(False)) & F.col("archived"))
        )
    found = search.top_k(searched, asked, by_tenant=True)
    shown = search.with_products(
        found, source, ["title", "description", "price", "vendor", "category", "metadata", "archived"]
    )
    rules = asked.select("query_id", "query", "corrected_query", "was_corrected", "exclude_archived")
    results = (
        shown.join(rules, "query_id")
        .filter(~(F.col("exclude_archived") & F.col("archived")))
        .select(
            "query_id",
            "shop_domain",
            "corrected_query",
            "rank",
            F.col("product_id").alias("id"),
            "title",
            "description",
            N.price_or_zero(F.col("price")).alias("price"),
            "vendor",
            F.coalesce("category", F.lit("")).alias("category"),
            J.string("metadata", "handle", "").alias("handle"),
            F.col("similarity").alias("similarity_score"),
        )
    )
    counted = results.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("results_count"))
    counts = (
        asked.select(
            "query_id", "shop_domain", "query", "corrected_query", "was_corrected", "max_price", "k", "min_similarity"
        )
        .join(counted, "query_id", "left")
        .fillna(0, ["results_count"])
    )
    return Answers(results, counts, limited, disabled)


def response_documents(results: DataFrame) -> DataFrame:
    """Results as one JSON document per row, NULL fields kept."""
    fields = ["id", "title", "description", "price", "vendor", "category", "handle", "similarity_score"]
    return results.select("query_id", "rank", J.document(*fields).alias("document"))
