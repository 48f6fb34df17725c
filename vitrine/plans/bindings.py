"""The service's tables expressed over the given test tables (whole tables only)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.functions.vectors import mean_vectors
from vitrine.sources import seeds

AS_OF = datetime(2024, 1, 31)
AS_OF_DATE = date(2024, 1, 31)
SHOPS = 20


# Schemas of the given tables, so that no read has to look into the files first.
TABLES = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _shop(number) -> F.Column:
    return F.concat(F.lit("shop_"), (number % SHOPS).cast("string"))


_METADATA = f"""to_json(named_struct(
    'in_stock', p_size > 10, 'stock_quantity', greatest(p_size - 10, 0),
    'sizes', array(cast(p_size as string), cast(p_size + 1 as string)),
    'archived', p_size between 20 and 23, 'needs_resync', p_size >= 45,
    'handle', lower(replace(p_name, ' ', '-')), 'shop', concat('shop_', p_partkey % {SHOPS})))"""

# Catalogue columns over ``part``; the last ones are the storefront's own fields.
_CATALOG = [
    "cast(p_partkey as string) AS product_id",
    f"concat('shop_', p_partkey % {SHOPS}) AS shop_domain",
    "p_name AS title",
    "description",
    "cast(p_retailprice as decimal(10,2)) AS price",
    "p_brand AS vendor",
    "p_type AS category",
    "split(p_name, ' ') AS tags",
    "embedding",
    f"{_METADATA} AS metadata",
    "timestamp_ntz '2024-01-01 00:00:00' AS created_at",
    "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, p_partkey) AS updated_at",
    "p_partkey AS id",
    "p_type AS product_type",
    "cast(cast(p_retailprice as decimal(10,2)) as double) AS price_min",
    "cast(cast(p_retailprice as decimal(10,2)) as double) + p_size AS price_max",
    "p_size % 10 != 0 AS available",
    "greatest(p_size - 10, 0) AS inventory_quantity",
    "greatest(p_size - 10, 0) AS inventory",
    "cast(p_size % 7 as double) AS popularity_score",
    "p_size > 10 AS in_stock",
    "label",
]


def catalog(spark: SparkSession, sf_dir: str, vectors: bool = True, descriptions: bool = False) -> DataFrame:
    """Products from ``part``; vectors from ``embeddings``, descriptions from ``documents``."""
    rows = table(spark, sf_dir, "part")
    if vectors:
        found = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS p_partkey", "embedding", "label")
        rows = rows.join(found, "p_partkey", "left")
    else:
        rows = rows.selectExpr("*", "cast(null as array<float>) AS embedding", "cast(null as int) AS label")
    if descriptions:
        texts = table(spark, sf_dir, "documents").selectExpr("doc_id AS p_partkey", "text AS description")
        rows = rows.join(texts, "p_partkey", "left")
    else:
        rows = rows.selectExpr("*", "cast(null as string) AS description")
    return rows.selectExpr(*_CATALOG)


def stored_catalog(spark: SparkSession, sf_dir: str, descriptions: bool = True) -> DataFrame:
    """The catalogue with exactly the declared product columns."""
    return catalog(spark, sf_dir, descriptions=descriptions).select(*schemas.PRODUCT_EMBEDDINGS.names)


def label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per embedding label: the mean vector of the label."""
    means = mean_vectors(catalog(spark, sf_dir), ["label"])
    return means.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("query_id"), "label", "qvec")


def title_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per distinct title."""
    return mean_vectors(catalog(spark, sf_dir), ["title"])


def shop_label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per tenant and label the tenant sells."""
    sold = catalog(spark, sf_dir).filter("label IS NOT NULL").select("shop_domain", "label").distinct()
    asked = sold.join(label_requests(spark, sf_dir).select("label", "qvec"), "label")
    return asked.select(F.concat_ws("/", "shop_domain", F.col("label").cast("string")).alias("query_id"), "shop_domain", "label", "qvec")


def misspelt(title: F.Column) -> F.Column:
    """Each word of more than three letters without its second letter, capitalised."""
    return F.array_join(
        F.transform(
            F.split(title, " "),
            lambda w: F.initcap(
                F.when(F.length(w) > 3, F.concat(F.substring(w, F.lit(1), F.lit(1)), F.substring(w, F.lit(3), F.length(w)))).otherwise(w)
            ),
        ),
        "  ",
    )


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One misspelt text request per tenant and title the tenant sells with a vector."""
    sold = catalog(spark, sf_dir).filter("embedding IS NOT NULL").select("shop_domain", "title").distinct()
    number = F.regexp_extract("shop_domain", r"(\d+)", 1).cast("int")
    return sold.select(
        F.concat_ws("/", "shop_domain", "title").alias("query_id"),
        "shop_domain",
        misspelt(F.col("title")).alias("query"),
        F.when(number % 3 != 0, F.lit(5)).alias("max_results"),
        F.when(number % 4 == 0, F.lit(915.0)).alias("max_price"),
        F.col("title").alias("wanted_title"),
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored configuration for some tenants (from the tenants of the catalogue)."""
    shops = catalog(spark, sf_dir, vectors=False).select("shop_domain").distinct()
    number = F.regexp_extract("shop_domain", r"(\d+)", 1).cast("int")
    value = F.to_json(
        F.struct(
            (number % 10 != 9).alias("ai_search_enabled"),
            F.when(number % 5 == 1, F.lit("unlimited")).otherwise(F.lit("8")).alias("results_limit"),
            F.lit(5).alias("similarity_threshold"),
            (number % 2 == 0).alias("exclude_out_of_stock"),
            (number % 3 == 0).alias("exclude_archived"),
        )
    )
    return shops.filter(number % 7 != 6).select(
        F.concat_ws(":", "shop_domain", F.lit("ai_search")).alias("key"),
        value.alias("value"),
        F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("updated_at"),
    )


def _event_number() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def search_events_of(events: DataFrame) -> DataFrame:
    """Search events expressed over the ``events`` columns (batch or stream)."""
    k = _event_number()
    clicked = F.col("event_type") == "click"
    return events.select(
        F.col("event_id").alias("id"),
        F.concat_ws(" ", "event_type", k.cast("string")).alias("query"),
        F.when(k % 10 != 0, k % 7).cast("int").alias("results_count"),
        F.when(clicked, k.cast("string")).alias("clicked_product_id"),
        F.when(clicked, k % 10 + 1).cast("int").alias("clicked_position"),
        F.when(clicked, F.floor(F.col("value") * 100)).cast("bigint").alias("time_to_click_ms"),
        F.col("user_id").cast("string").alias("session_id"),
        _shop(F.col("user_id")).alias("shop_domain"),
        F.col("ts").alias("created_at"),
    )


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_events_of(table(spark, sf_dir, "events"))


# Market segment of a customer -> plan name.
SEGMENT_PLANS = {
    "HOUSEHOLD": "starter",
    "BUILDING": "launch",
    "MACHINERY": "growth",
    "AUTOMOBILE": "scale",
    "FURNITURE": "enterprise",
}


def subscriptions(spark: SparkSession, sf_dir: str, plan_ids: dict[str, int] | None = None) -> DataFrame:
    """One subscription per customer, the tenant being ``shop_<custkey>``."""
    ids = plan_ids or {name: i for i, (name, *_) in enumerate(seeds.PLAN_ROWS, start=1)}
    plan = F.lit(None).cast("int")
    for segment, name in SEGMENT_PLANS.items():
        plan = F.when(F.col("c_mktsegment") == segment, F.lit(ids[name])).otherwise(plan)
    key = F.col("c_custkey")
    reset = F.date_add(F.lit(date(2024, 1, 1)), (key % 45 - 15).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("shop_"), key.cast("string")).alias("shop_domain"),
        plan.cast("int").alias("plan_id"),
        F.lit("active").alias("status"),
        (key % 400).cast("bigint").alias("searches_this_month"),
        reset.alias("search_reset_date"),
        reset.alias("billing_cycle_start"),
        F.when(key % 6 != 0, F.date_add(reset, 30)).alias("billing_cycle_end"),
    )


def incoming_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later snapshot of the catalogue: some titles and prices changed, one new
    product per given one of the first size, and two versions of some rows."""
    base = catalog(spark, sf_dir, vectors=False, descriptions=True)
    size = F.col("inventory_quantity")
    known = base.select(
        "shop_domain",
        "product_id",
        F.when(F.col("id") % 11 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"),
        "description",
        (F.col("price") + F.when(F.col("id") % 7 == 0, F.lit(1)).otherwise(F.lit(0))).cast("decimal(10,2)").alias("price"),
        "vendor",
        "category",
        "tags",
        F.to_json(F.struct((size > 0).alias("in_stock"), "shop_domain")).alias("metadata"),
        F.col("id").alias("ordinal"),
    )
    new = known.filter(size == 0).withColumns(
        {"product_id": F.concat(F.lit("new_"), F.col("product_id")), "ordinal": F.col("ordinal") + 1_000_000_000}
    )
    again = known.filter(size == 5).withColumns(
        {"price": (F.col("price") + 2).cast("decimal(10,2)"), "ordinal": F.col("ordinal") + 2_000_000_000}
    )
    return known.unionByName(new).unionByName(again)
