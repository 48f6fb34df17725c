"""Registered queries: sources, merges, deletes, comparison, configuration, embedding."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.functions import jsonfields as J
from vitrine.functions import predicates as P
from vitrine.functions import text as X
from vitrine.functions import vectors as V
from vitrine.operators import buckets, coverage, diff, embedding, merge, metering, purge, settings
from vitrine.plans import bindings as B
from vitrine.plans import sql
from vitrine.plans.registry import day, listed, moment, query
from vitrine.session import fresh_dir
from vitrine.sources import catalog as C
from vitrine.sources import seeds

LATER = datetime(2024, 2, 1)
_LATER = "TIMESTAMP '2024-02-01'"

# ---------------------------------------------------------------- sources


@query(
    f"""WITH {sql.CAT} SELECT product_id, shop_domain, title, CAST(price AS DOUBLE) AS price, vendor,
       embedding IS NOT NULL AS has_embedding, needs_resync, {sql.moment('updated_at')} AS updated_at,
       CASE WHEN embedding IS NOT NULL THEN 'ready' ELSE 'needs_sync' END AS status FROM cat"""
)
def product_listing(spark, sf_dir):
    """All products with their sync status, newest first."""
    return C.listing(B.catalog(spark, sf_dir)).withColumn("updated_at", moment("updated_at"))


@query(
    f"""WITH {sql.CAT} SELECT product_id, title, embedding IS NULL AS missing_embedding, shop_domain AS shop_value,
       {sql.moment('updated_at')} AS updated_at FROM cat ORDER BY cat.updated_at DESC, product_id LIMIT 20"""
)
def latest_products(spark, sf_dir):
    """The debug view: the twenty newest products of any tenant."""
    rows = C.listing(B.catalog(spark, sf_dir), limit=20)
    return rows.select(
        "product_id", "title", (~F.col("has_embedding")).alias("missing_embedding"),
        F.col("shop_domain").alias("shop_value"), moment("updated_at").alias("updated_at"),
    )


@query(f"WITH {sql.CAT} SELECT product_id FROM cat ORDER BY product_id LIMIT 10")
def first_product_ids(spark, sf_dir):
    return C.first_ids(B.catalog(spark, sf_dir, vectors=False))


@query(
    f"""WITH {sql.CAT}, {sql.SEARCHES}
SELECT product_id AS id, title, CAST(price AS DOUBLE) AS price, vendor, category, array_to_string(tags, '|') AS tags,
       in_stock, stock_quantity, CAST(size AS VARCHAR) || '|' || CAST(size + 1 AS VARCHAR) AS sizes
FROM cat WHERE product_id IN (SELECT clicked_product_id FROM searches)"""
)
def product_details(spark, sf_dir):
    """Bulk lookup: details of every product clicked in the search log."""
    clicked = B.search_events(spark, sf_dir).filter("clicked_product_id IS NOT NULL")
    found = C.lookup_products(
        B.catalog(spark, sf_dir, vectors=False), clicked.select(F.col("clicked_product_id").alias("product_id"))
    )
    return C.product_details(found).drop("description").withColumns({"tags": listed("tags"), "sizes": listed("sizes")})


@query(
    f"""WITH {sql.CAT} SELECT shop_domain, product_id, title, COALESCE(description IS NOT NULL, FALSE) AS described,
       CAST(price AS DOUBLE) AS price, vendor, category, array_to_string(tags, '|') AS tags,
       CAST(price AS DOUBLE) AS variant_price, CAST(1 AS BIGINT) AS variants FROM cat"""
)
def catalog_payload(spark, sf_dir):
    """Payload files of at most a hundred products each, written and read back."""
    rows = B.catalog(spark, sf_dir, vectors=False, descriptions=True)
    variant = F.struct(
        F.col("product_id").alias("id"), F.col("vendor").alias("title"), F.col("price").cast("string").alias("price")
    )
    product = F.struct(
        "product_id", "title", "description", F.col("price").cast("double").alias("price"), "vendor", "category",
        F.col("category").alias("product_type"), F.array_join("tags", ", ").alias("tags"), "metadata",
        F.array(variant).alias("variants"), F.array().cast("array<string>").alias("images"),
    )
    batch = F.floor(F.col("id") / (B.SHOPS * 100))
    payloads = rows.groupBy(F.col("shop_domain").alias("shop"), batch.alias("batch")).agg(F.collect_list(product).alias("products"))
    path = fresh_dir(spark, "payload")
    payloads.select("shop", "products").write.json(path)
    back = C.read_payload(spark, path, multi_line=False)
    return back.select(
        "shop_domain", "product_id", "title", (F.col("description") != "").alias("described"),
        F.col("price").cast("double").alias("price"), "vendor", "category", listed("tags").alias("tags"),
        F.col("variants")[0]["price"].cast("double").alias("variant_price"), F.size("variants").cast("bigint").alias("variants"),
    )


_PREDICATES = {
    "has_vector": ("embedding IS NOT NULL", lambda: P.has_embedding()),
    "no_vector": ("embedding IS NULL", lambda: P.missing_embedding()),
    "cheap": ("price <= 950", lambda: P.price_between(high=950.0)),
    "dear": ("price >= 905.5", lambda: P.price_between(low=905.5)),
    "in_stock": ("in_stock", lambda: P.in_stock_flag()),
    "not_archived": ("NOT archived", lambda: P.not_archived()),
    "vendor_like": ("vendor ILIKE '%BRAND#1%'", lambda: P.contains("vendor", "BRAND#1")),
    "type_like": ("category ILIKE '%nom%'", lambda: P.contains("category", "nom")),
    "any_tag": ("list_has_any(tags, ['red', 'anvil'])", lambda: P.any_tag(["red", "anvil"])),
    "stocked": ("inventory_quantity > 0", lambda: P.stocked()),
    "vendor_in": ("vendor IN ('Brand#1', 'Brand#2')", lambda: P.any_of("vendor", ["Brand#1", "Brand#2"])),
    "resync": ("needs_resync", lambda: P.needs_resync()),
    "shop_three": ("shop_domain = 'shop_3'", lambda: P.tenant("shop_3")),
    "shop_in_json": ("shop_domain = 'shop_4'", lambda: P.tenant_in_metadata("shop_4")),
    "described": ("length(trim(regexp_replace(COALESCE(description, ''), '\\s+', ' ', 'g'))) > 0", lambda: P.not_blank("description")),
    "dynamic": (
        "price_min >= 900 AND price_max <= 940 AND vendor ILIKE '%2%' AND inventory_quantity > 0",
        lambda: P.product_filters(price_min=900.0, price_max=940.0, vendor="2", in_stock=True),
    ),
}


@query(
    f"WITH {sql.CAT} SELECT shop_domain, "
    + ", ".join(f"COUNT(*) FILTER ({test}) AS {name}" for name, (test, _) in _PREDICATES.items())
    + " FROM cat GROUP BY shop_domain"
)
def predicate_counts(spark, sf_dir):
    """Rows passing each predicate, per tenant, in one pass."""
    rows = B.catalog(spark, sf_dir, descriptions=True)
    return rows.groupBy("shop_domain").agg(*[F.count_if(make()).alias(name) for name, (_, make) in _PREDICATES.items()])


# ------------------------------------------------------------ JSON, vectors as text


@query(
    f"""WITH {sql.CAT} SELECT product_id, in_stock, stock_quantity, CAST(size AS VARCHAR) || '|' || CAST(size + 1 AS VARCHAR) AS sizes,
       shop_domain AS shop, FALSE AS test, handle, 7 AS keys_before, 7 AS keys_set, TRUE AS flag_set, 6 AS keys_dropped, TRUE AS flag_dropped
FROM cat"""
)
def json_fields(spark, sf_dir):
    """Typed reads of the metadata, setting a key and dropping a key."""
    rows = B.catalog(spark, sf_dir, vectors=False)
    made = rows.withColumns(
        {
            "_set": J.set_flag("metadata", "needs_resync", F.lit(True)),
            "_dropped": J.drop_key("metadata", "needs_resync"),
        }
    )

    def keys(name):
        return F.size(F.json_object_keys(name))

    return made.select(
        "product_id",
        J.flag("metadata", "in_stock").alias("in_stock"),
        J.integer("metadata", "stock_quantity").cast("int").alias("stock_quantity"),
        listed(J.string_list("metadata", "sizes")).alias("sizes"),
        J.string("metadata", "shop").alias("shop"),
        J.flag("metadata", "test").alias("test"),
        J.string("metadata", "handle", "").alias("handle"),
        keys("metadata").alias("keys_before"),
        keys("_set").alias("keys_set"),
        J.flag("_set", "needs_resync").alias("flag_set"),
        keys("_dropped").alias("keys_dropped"),
        J.flag("_dropped", "needs_resync", None).isNull().alias("flag_dropped"),
    )


@query(
    """SELECT vec_id, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, TRUE AS same FROM embeddings"""
)
def vector_text_form(spark, sf_dir):
    """Vectors to their text form and back."""
    rows = B.table(spark, sf_dir, "embeddings")
    back = V.from_text(V.to_text(F.col("embedding")))
    total = F.aggregate(back, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.withColumn("back", back).select(
        "vec_id", F.size("back").cast("bigint").alias("dim"), F.round(total, 6).alias("total"), (F.col("back") == F.col("embedding")).alias("same")
    )


# ---------------------------------------------------------------- merges

_MERGED = f"""WITH {sql.CAT}, {sql.INCOMING}, merged AS (
  SELECT c.shop_domain, c.product_id,
         CASE WHEN l.product_id IS NULL THEN c.title ELSE l.title END AS title,
         CASE WHEN l.product_id IS NULL THEN c.description ELSE l.description END AS description,
         CASE WHEN l.product_id IS NULL THEN c.price ELSE l.price END AS price,
         {{embedding}} AS has_embedding,
         c.created_at, CASE WHEN l.product_id IS NULL THEN c.updated_at ELSE {_LATER} END AS updated_at
  FROM cat c LEFT JOIN {{source}} l ON c.shop_domain = l.shop_domain AND c.product_id = l.product_id
  UNION ALL
  SELECT l.shop_domain, l.product_id, l.title, l.description, l.price, FALSE, {_LATER}, {_LATER}
  FROM {{source}} l LEFT JOIN cat c ON c.shop_domain = l.shop_domain AND c.product_id = l.product_id WHERE c.product_id IS NULL
)
SELECT shop_domain, product_id, title, md5(COALESCE(description, '-')) AS description_md5, CAST(price AS DOUBLE) AS price,
       has_embedding, {sql.moment('created_at')} AS created_at, {sql.moment('updated_at')} AS updated_at FROM merged"""


def _merged_view(snapshot):
    return snapshot.select(
        "shop_domain", "product_id", "title", F.md5(F.coalesce("description", F.lit("-"))).alias("description_md5"),
        F.col("price").cast("double").alias("price"), F.col("embedding").isNotNull().alias("has_embedding"),
        moment("created_at").alias("created_at"), moment("updated_at").alias("updated_at"),
    )


@query(_MERGED.format(embedding="CASE WHEN l.product_id IS NULL THEN c.embedding IS NOT NULL ELSE FALSE END", source="latest"))
def upsert_full(spark, sf_dir):
    """Full upsert of a later snapshot that carries no vectors: they are cleared."""
    incoming = merge.keep_last(B.incoming_catalog(spark, sf_dir), merge.PRODUCT_KEYS)
    incoming = incoming.withColumn("embedding", F.lit(None).cast("array<float>"))
    return _merged_view(merge.upsert_products(B.stored_catalog(spark, sf_dir), incoming, LATER))


@query(_MERGED.format(embedding="CASE WHEN l.product_id IS NULL THEN c.embedding IS NOT NULL ELSE FALSE END", source="latest"))
def upsert_repeated_keys(spark, sf_dir):
    """The same upsert of a batch that repeats keys: the last row of each counts."""
    incoming = B.incoming_catalog(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    return _merged_view(merge.upsert_products(B.stored_catalog(spark, sf_dir), incoming, LATER))


@query(_MERGED.format(embedding="c.embedding IS NOT NULL", source="latest"))
def upsert_preserve_embedding(spark, sf_dir):
    incoming = merge.keep_last(B.incoming_catalog(spark, sf_dir), merge.PRODUCT_KEYS)
    return _merged_view(merge.upsert_product_info(B.stored_catalog(spark, sf_dir), incoming, LATER))


@query(
    f"""WITH {sql.CAT} SELECT c.product_id, c.embedding IS NOT NULL AS has_embedding,
       round(COALESCE(list_sum(CASE WHEN c.embedding IS NOT NULL THEN list_transform(c.embedding, lambda x: -x) END), 0), 6) AS total,
       CASE WHEN c.embedding IS NOT NULL THEN FALSE ELSE c.needs_resync END AS needs_resync,
       {sql.moment(f"CASE WHEN c.embedding IS NOT NULL THEN {_LATER} ELSE c.updated_at END")} AS updated_at FROM cat c"""
)
def embedding_writeback(spark, sf_dir):
    """New vectors (the old ones negated) written back, clearing the resync flag."""
    stored = B.stored_catalog(spark, sf_dir, descriptions=False)
    vectors = stored.filter(P.has_embedding()).select(
        "shop_domain", "product_id", F.transform("embedding", lambda x: -x).alias("embedding")
    )
    snapshot, _ = merge.write_back_embeddings(stored, vectors, LATER)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return snapshot.select(
        "product_id", P.has_embedding().alias("has_embedding"), F.round(F.coalesce(total, F.lit(0.0)), 6).alias("total"),
        J.flag("metadata", "needs_resync").alias("needs_resync"), moment("updated_at").alias("updated_at"),
    )


_BUCKET_ROWS = 2000


@query(_MERGED.format(embedding="c.embedding IS NOT NULL", source="latest"))
def bucket_upsert(spark, sf_dir):
    """A later snapshot merged into a catalogue in key buckets, vectors left as they are."""
    path = fresh_dir(spark, "buckets")
    buckets.create(B.stored_catalog(spark, sf_dir), path, _BUCKET_ROWS)
    incoming = merge.keep_last(B.incoming_catalog(spark, sf_dir), merge.PRODUCT_KEYS)
    buckets.upsert_product_info(spark, path, incoming, LATER)
    return _merged_view(buckets.current(spark, path))


@query(
    f"""WITH {sql.CAT}, hit AS (SELECT *, embedding IS NOT NULL AND shop_domain = 'shop_3' AS h FROM cat)
SELECT product_id, shop_domain, round(COALESCE(list_sum(CASE WHEN h THEN list_transform(embedding, lambda x: -x) ELSE embedding END), 0), 6) AS total,
       CASE WHEN h THEN FALSE ELSE needs_resync END AS needs_resync,
       {sql.moment(f"CASE WHEN h THEN {_LATER} ELSE updated_at END")} AS updated_at FROM hit"""
)
def bucket_writeback(spark, sf_dir):
    """One tenant's vectors written back into its buckets; the others are not read."""
    path, stored = fresh_dir(spark, "buckets"), B.stored_catalog(spark, sf_dir, descriptions=False)
    buckets.create(stored, path, _BUCKET_ROWS)
    vectors = stored.filter(P.has_embedding() & (F.col("shop_domain") == "shop_3")).select(
        "shop_domain", "product_id", F.transform("embedding", lambda x: -x).alias("embedding")
    )
    buckets.write_back_embeddings(spark, path, vectors, LATER)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return buckets.current(spark, path).select(
        "product_id", "shop_domain", F.round(F.coalesce(total, F.lit(0.0)), 6).alias("total"),
        J.flag("metadata", "needs_resync").alias("needs_resync"), moment("updated_at").alias("updated_at"),
    )


@query("SELECT CAST(vec_id AS VARCHAR) AS product_id FROM embeddings WHERE vec_id NOT IN (SELECT s_suppkey FROM supplier)")
def embedding_unknown_ids(spark, sf_dir):
    """Vectors whose product is unknown (a catalogue of the suppliers' numbers)."""
    known = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("product_id"))
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.PRODUCT_EMBEDDINGS.fields if f.name not in ("product_id", "shop_domain", "metadata")]
    stored = known.select("product_id", F.lit("one").alias("shop_domain"), F.lit("{}").alias("metadata"), *columns)
    vectors = B.table(spark, sf_dir, "embeddings").select(
        F.lit("one").alias("shop_domain"), F.col("vec_id").cast("string").alias("product_id"), "embedding"
    )
    _, unknown = merge.write_back_embeddings(stored, vectors, LATER)
    return unknown.select("product_id")


@query(
    f"""WITH {sql.SEARCHES}, {sql.USAGE}, more AS (SELECT shop_domain, usage_type, usage_date, 2 * usage_count AS usage_count FROM usage
  UNION ALL SELECT DISTINCT shop_domain, 'sync', usage_date, 1 FROM usage)
SELECT shop_domain, usage_type, {sql.day('usage_date')} AS usage_date, CAST(SUM(usage_count) AS BIGINT) AS usage_count
FROM (SELECT * FROM usage UNION ALL SELECT * FROM more) GROUP BY 1, 2, 3"""
)
def usage_counters(spark, sf_dir):
    """Daily counters with increments added: known counters grow, new ones appear."""
    usage = metering.usage_from_events(B.search_events(spark, sf_dir))
    grown = usage.withColumn("usage_count", F.col("usage_count") * 2)
    new = usage.select("shop_domain", F.lit("sync").alias("usage_type"), "usage_date", F.lit(1).cast("bigint").alias("usage_count")).distinct()
    return merge.add_usage(usage, grown.unionByName(new)).withColumn("usage_date", day("usage_date"))


@query(
    f"""WITH writes AS (
  SELECT 'shop_' || CAST(user_id % 20 AS VARCHAR) || ':' || event_type AS key, props AS value, ts AS updated_at FROM events
)
SELECT key, value, {sql.moment('updated_at')} AS updated_at FROM writes
QUALIFY row_number() OVER (PARTITION BY key ORDER BY writes.updated_at DESC, value DESC) = 1"""
)
def settings_lww(spark, sf_dir):
    """Last write per settings key."""
    writes = B.table(spark, sf_dir, "events").select(
        F.concat(B._shop(F.col("user_id")), F.lit(":"), "event_type").alias("key"), F.col("props").alias("value"), F.col("ts").alias("updated_at")
    )
    early, late = writes.filter(F.col("updated_at") < "2024-01-15"), writes.filter(F.col("updated_at") >= "2024-01-15")
    stored = merge.last_write_wins(early, early.filter("false"))
    return merge.last_write_wins(stored, late).withColumn("updated_at", moment("updated_at"))


@query(
    f"""WITH writes AS (
  SELECT string_split(regexp_replace(url, 'https?://', '', 'g'), '/')[1] || ':extension_last_active' AS key, CAST(page_id AS VARCHAR) AS value,
         TIMESTAMP '2024-01-01' + to_seconds(page_id) AS updated_at FROM pages
)
SELECT key, value, {sql.moment('updated_at')} AS updated_at FROM writes
QUALIFY row_number() OVER (PARTITION BY key ORDER BY writes.updated_at DESC) = 1"""
)
def ping_settings(spark, sf_dir):
    """Pings by storefront URL as settings, the last one per tenant kept."""
    pings = B.table(spark, sf_dir, "pages").select(
        F.col("url").alias("shop"),
        F.col("page_id").cast("string").alias("value"),
        (F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("page_id"))).alias("updated_at"),
    )
    writes = settings.ping_writes(pings)
    return merge.last_write_wins(writes.filter("false"), writes).withColumn("updated_at", moment("updated_at"))


@query(
    f"""WITH {sql.plans()}, {sql.subscriptions({s: [n for n, *_ in seeds.PLAN_ROWS].index(p) + 1 for s, p in B.SEGMENT_PLANS.items()})},
asked AS (
  SELECT 'shop_' || CAST(o_custkey AS VARCHAR) AS shop_domain, o_orderkey AS ordinal,
         CASE o_orderstatus WHEN 'O' THEN 'growth' WHEN 'F' THEN 'scale' ELSE 'basic' END AS plan_name FROM orders
), good AS (
  SELECT a.shop_domain, p.id FROM asked a JOIN plans p ON p.name = a.plan_name
  QUALIFY row_number() OVER (PARTITION BY a.shop_domain ORDER BY a.ordinal DESC) = 1
)
SELECT COALESCE(s.shop_domain, g.shop_domain) AS shop_domain, COALESCE(g.id, s.plan_id) AS plan_id,
       {sql.day("CASE WHEN g.id IS NULL THEN s.billing_cycle_start ELSE DATE '2024-01-31' END")} AS cycle_start,
       COALESCE({sql.day("CASE WHEN g.id IS NULL THEN s.billing_cycle_end ELSE DATE '2024-03-01' END")}, 'none') AS cycle_end
FROM subs s FULL JOIN good g ON s.shop_domain = g.shop_domain"""
)
def subscription_upgrades(spark, sf_dir):
    """Upgrade requests (one per order); a tenant's last valid request counts."""
    asked = _upgrade_requests(spark, sf_dir)
    merged, _ = merge.upgrade_subscriptions(B.subscriptions(spark, sf_dir), asked, seeds.plans(spark), B.AS_OF_DATE)
    return merged.select(
        "shop_domain", "plan_id", day("billing_cycle_start").alias("cycle_start"),
        F.coalesce(day("billing_cycle_end"), F.lit("none")).alias("cycle_end"),
    )


def _upgrade_requests(spark, sf_dir):
    status = F.col("o_orderstatus")
    plan = F.when(status == "O", "growth").when(status == "F", "scale").otherwise("basic")
    return B.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("shop_"), F.col("o_custkey").cast("string")).alias("shop_domain"), plan.alias("plan_name"), F.col("o_orderkey").alias("ordinal")
    )


@query(
    "SELECT 'shop_' || CAST(o_custkey AS VARCHAR) AS shop_domain, COUNT(*) AS rejected FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1"
)
def subscription_upgrade_errors(spark, sf_dir):
    """Upgrade requests naming no active plan, per tenant."""
    _, unknown = merge.upgrade_subscriptions(
        B.subscriptions(spark, sf_dir), _upgrade_requests(spark, sf_dir), seeds.plans(spark), B.AS_OF_DATE
    )
    return unknown.groupBy("shop_domain").agg(F.count(F.lit(1)).alias("rejected"))


@query(
    f"""WITH {sql.CAT}, {sql.subscriptions({s: i for i, s in enumerate(B.SEGMENT_PLANS, start=1)})},
kept AS (SELECT * FROM subs WHERE plan_id <> 1)
SELECT shop_domain, plan_id, {sql.day('search_reset_date')} AS search_reset_date FROM kept
UNION ALL
SELECT DISTINCT shop_domain, 1, '2024-01-31' FROM cat WHERE shop_domain NOT IN (SELECT shop_domain FROM kept)"""
)
def subscribe_new_tenants(spark, sf_dir):
    """Default subscriptions for catalogue tenants that have none."""
    some = B.subscriptions(spark, sf_dir, {name: i for i, name in enumerate(B.SEGMENT_PLANS.values(), start=1)}).filter("plan_id <> 1")
    tenants = B.catalog(spark, sf_dir, vectors=False)
    merged = merge.subscribe_new(some, tenants, seeds.plans(spark), B.AS_OF_DATE)
    return merged.select("shop_domain", "plan_id", day("search_reset_date").alias("search_reset_date"))


_STORED_CONFIG = """
stored AS (
  SELECT shop_domain, n FROM (SELECT DISTINCT shop_domain, CAST(replace(shop_domain, 'shop_', '') AS INTEGER) AS n FROM cat)
)"""


@query(
    f"""WITH {sql.CAT}, {_STORED_CONFIG}
SELECT shop_domain, CASE WHEN n % 7 <> 6 THEN n % 10 <> 9 ELSE TRUE END AS ai_search_enabled, TRUE AS autocorrect,
       CASE WHEN n % 7 <> 6 THEN CASE WHEN n % 5 = 1 THEN 'unlimited' ELSE '8' END ELSE '10' END AS results_limit,
       CASE WHEN n % 7 <> 6 THEN 5.0::DOUBLE ELSE 70.0::DOUBLE END AS similarity_threshold,
       CASE WHEN n % 7 <> 6 THEN n % 2 = 0 ELSE FALSE END AS exclude_out_of_stock,
       CASE WHEN n % 7 <> 6 THEN n % 3 = 0 ELSE FALSE END AS exclude_archived, 'es' AS language
FROM stored"""
)
def config_defaults(spark, sf_dir):
    """Stored configuration per tenant, with defaults for what is absent."""
    tenants = B.catalog(spark, sf_dir, vectors=False)
    return settings.tenant_config(B.settings(spark, sf_dir), tenants)


@query(
    f"""WITH {sql.CAT}, {_STORED_CONFIG}
SELECT shop_domain, '8' AS results_limit, 10.0::DOUBLE AS similarity_threshold, FALSE AS exclude_out_of_stock,
       TRUE AS exclude_archived, TRUE AS ai_search_enabled FROM stored WHERE n % 7 <> 6
UNION ALL SELECT shop_domain, '10', 70.0::DOUBLE, FALSE, FALSE, TRUE FROM stored WHERE n % 7 = 6"""
)
def config_partial(spark, sf_dir):
    """Stored configurations that lack most keys, beside tenants that stored nothing."""
    stored = B.settings(spark, sf_dir).withColumn("value", F.lit('{"results_limit": "8"}'))
    found = settings.tenant_config(stored, B.catalog(spark, sf_dir, vectors=False))
    return found.select(
        "shop_domain", "results_limit", "similarity_threshold", "exclude_out_of_stock", "exclude_archived", "ai_search_enabled"
    )


@query(
    f"""WITH {sql.CAT}, {_STORED_CONFIG}
SELECT shop_domain || ':ai_search' AS key, CASE WHEN n % 7 <> 6 THEN CASE WHEN n % 5 = 1 THEN 'unlimited' ELSE '8' END ELSE 'unlimited' END AS results_limit,
       CASE WHEN n % 7 <> 6 THEN '2024-01-01' ELSE '2024-01-31' END AS written
FROM stored"""
)
def config_initialise(spark, sf_dir):
    """Installation defaults for tenants without a configuration."""
    tenants = B.catalog(spark, sf_dir, vectors=False)
    merged = merge.initialise_config(B.settings(spark, sf_dir), tenants, json.dumps(seeds.INSTALL_CONFIG), B.AS_OF)
    return merged.select("key", J.string("value", "results_limit").alias("results_limit"), day("updated_at").alias("written"))


@query(
    f"""WITH {sql.SEARCHES} SELECT shop_domain, COUNT(*) AS events, CAST(SUM(COALESCE(results_count, 0)) AS BIGINT) AS results,
       COUNT(DISTINCT query) AS queries FROM searches GROUP BY 1"""
)
def event_append(spark, sf_dir):
    """Search events appended in two writes and read back."""
    events = B.search_events(spark, sf_dir)
    path = fresh_dir(spark, "events")
    half = F.col("created_at") < "2024-01-15"
    merge.append_events(events.filter(half), path)
    merge.append_events(events.filter(~half), path)
    back = spark.read.schema(events.schema).parquet(path)
    return back.groupBy("shop_domain").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.coalesce("results_count", F.lit(0))).cast("bigint").alias("results"),
        F.countDistinct("query").alias("queries"),
    )


@query(
    f"""WITH {sql.CAT}, {sql.INCOMING}, merged AS (
  SELECT c.shop_domain, COALESCE(l.price, c.price) AS price, c.embedding IS NOT NULL AS has_embedding FROM cat c LEFT JOIN latest l USING (shop_domain, product_id)
  UNION ALL SELECT shop_domain, price, FALSE FROM latest WHERE product_id LIKE 'new%'
)
SELECT shop_domain, COUNT(*) AS products, COUNT(*) FILTER (has_embedding) AS embedded, CAST(SUM(price) AS DOUBLE) AS total_price FROM merged GROUP BY 1"""
)
def snapshot_write(spark, sf_dir):
    """A merged snapshot written per tenant and read back."""
    incoming = merge.keep_last(B.incoming_catalog(spark, sf_dir), merge.PRODUCT_KEYS)
    snapshot = merge.upsert_product_info(B.stored_catalog(spark, sf_dir), incoming, LATER)
    path = fresh_dir(spark, "snapshot")
    merge.write_snapshot(snapshot, path)
    back = C.read_catalog(spark, path, ["shop_domain", "price", "embedding"])
    return back.groupBy("shop_domain").agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(P.has_embedding()).alias("embedded"),
        F.sum("price").cast("double").alias("total_price"),
    )


@query(
    f"""WITH {sql.CAT} SELECT product_id, title, CAST(price AS DOUBLE) AS price, description IS NULL AS null_kept, CAST(5 AS BIGINT) AS keys FROM cat"""
)
def response_documents(spark, sf_dir):
    """Products as JSON documents; NULL fields stay in them."""
    rows = B.catalog(spark, sf_dir, vectors=False, descriptions=True)
    made = rows.select(
        J.document(F.col("product_id").alias("id"), "title", F.col("price").cast("double").alias("price"), "vendor", "description").alias("d")
    )
    return made.select(
        J.string("d", "id").alias("product_id"),
        J.string("d", "title").alias("title"),
        J.number("d", "price").alias("price"),
        (F.col("d").endswith('"description":null}')).alias("null_kept"),
        F.size(F.json_object_keys("d")).cast("bigint").alias("keys"),
    )


# ---------------------------------------------------------------- deletes

_SETTINGS_SQL = f"""
keys AS (
  SELECT DISTINCT 'shop_' || CAST(c_custkey AS VARCHAR) || s.suffix AS key FROM customer, (VALUES (''), (':extension_last_active'), ('_theme')) s(suffix)
),
gone AS (SELECT DISTINCT 'shop_' || CAST(s_suppkey AS VARCHAR) AS shop_domain FROM supplier)"""


def _settings_rows(spark, sf_dir):
    name = F.concat(F.lit("shop_"), F.col("c_custkey").cast("string"))
    suffixes = F.array(F.lit(""), F.lit(":extension_last_active"), F.lit("_theme"))
    return B.table(spark, sf_dir, "customer").select(F.explode(F.transform(suffixes, lambda s: F.concat(name, s))).alias("key"), F.lit("{}").alias("value"))


def _erasable(spark, sf_dir):
    events = B.search_events(spark, sf_dir)
    return {
        "usage_tracking": metering.usage_from_events(events),
        "subscriptions": B.subscriptions(spark, sf_dir),
        "products": B.catalog(spark, sf_dir, vectors=False),
        "searches": events,
        "settings": _settings_rows(spark, sf_dir),
    }


def _gone(spark, sf_dir):
    """Tenants to erase: the suppliers' numbers."""
    return B.table(spark, sf_dir, "supplier").select(F.concat(F.lit("shop_"), F.col("s_suppkey").cast("string")).alias("shop_domain"))


def _owned(table: str) -> str:
    return f"(SELECT shop_domain, COUNT(*) AS n FROM {table} GROUP BY 1)"


_SUBS = sql.subscriptions({s: i for i, s in enumerate(B.SEGMENT_PLANS, start=1)})


@query(
    f"""WITH {sql.CAT}, {sql.SEARCHES}, {sql.USAGE}, {_SUBS}, {_SETTINGS_SQL},
owners AS (SELECT regexp_extract(key, '^(shop_[0-9]+)', 1) AS shop_domain FROM keys)
SELECT g.shop_domain, COALESCE(u.n, 0) AS usage_tracking, COALESCE(b.n, 0) AS subscriptions, COALESCE(c.n, 0) AS products,
       COALESCE(s.n, 0) AS searches, COALESCE(k.n, 0) AS settings
FROM gone g LEFT JOIN {_owned('usage')} u USING (shop_domain) LEFT JOIN {_owned('subs')} b USING (shop_domain)
LEFT JOIN {_owned('cat')} c USING (shop_domain) LEFT JOIN {_owned('searches')} s USING (shop_domain) LEFT JOIN {_owned('owners')} k USING (shop_domain)"""
)
def tenant_erase_counts(spark, sf_dir):
    """Rows an erasure of tenants removes from each table."""
    return purge.erased_counts(_erasable(spark, sf_dir), _gone(spark, sf_dir))


@query(
    f"""WITH {sql.CAT}, {sql.SEARCHES}, {sql.USAGE}, {_SUBS}, {_SETTINGS_SQL}
SELECT 'usage_tracking' AS table_name, COUNT(*) AS remaining FROM usage WHERE shop_domain NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'subscriptions', COUNT(*) FROM subs WHERE shop_domain NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'products', COUNT(*) FROM cat WHERE shop_domain NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'searches', COUNT(*) FROM searches WHERE shop_domain NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'settings', COUNT(*) FROM keys WHERE regexp_extract(key, '^(shop_[0-9]+)', 1) NOT IN (SELECT * FROM gone)"""
)
def tenant_erase(spark, sf_dir):
    """Rows left in each table after the erasure."""
    kept = purge.erase_tenants(_erasable(spark, sf_dir), _gone(spark, sf_dir))
    parts = [t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("remaining")) for name, t in kept.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    f"""WITH {sql.SEARCHES}, {sql.USAGE}, {_SUBS}, due AS (
  SELECT shop_domain FROM subs WHERE search_reset_date <= DATE '2024-04-15' - 30
)
SELECT shop_domain, COUNT(*) AS days, {sql.day('MIN(usage_date)')} AS oldest FROM usage
WHERE shop_domain NOT IN (SELECT shop_domain FROM due) OR usage_date >= DATE '2024-04-15' - 90 GROUP BY 1"""
)
def usage_retention(spark, sf_dir):
    """Old usage dropped for tenants whose cycle resets."""
    as_of = datetime(2024, 4, 15).date()
    due = B.subscriptions(spark, sf_dir).filter(metering.cycle_due(as_of))
    kept = purge.retain_usage(metering.usage_from_events(B.search_events(spark, sf_dir)), due, as_of)
    return kept.groupBy("shop_domain").agg(F.count(F.lit(1)).alias("days"), day(F.min("usage_date")).alias("oldest"))


@query(f"WITH {sql.CAT} SELECT shop_domain, COUNT(*) AS products FROM cat WHERE NOT archived GROUP BY 1")
def drop_flagged_rows(spark, sf_dir):
    """Rows flagged in their metadata removed."""
    kept = purge.drop_flagged(B.catalog(spark, sf_dir, vectors=False), "archived")
    return coverage.product_counts(kept)


@query("SELECT source AS shop_domain, COUNT(*) AS products FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def drop_orphan_rows(spark, sf_dir):
    """Rows without a tenant removed (documents lacking a label have none)."""
    labelled = B.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known"))
    rows = B.table(spark, sf_dir, "documents").select("doc_id", "source").join(labelled, "doc_id", "left")
    owned = rows.withColumn("shop_domain", F.when(F.col("known"), F.col("source")))
    return coverage.product_counts(purge.drop_orphans(owned))


@query(f"WITH {_SETTINGS_SQL} SELECT key FROM keys WHERE key <> 'shop_7_theme'")
def reset_setting(spark, sf_dir):
    """One settings key deleted, so that its defaults apply."""
    return purge.reset_setting(_settings_rows(spark, sf_dir), "shop_7_theme").select("key")


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS title, TRUE AS no_vector, CAST(2 + 10 AS BIGINT) AS columns FROM part"
)
def ensure_columns(spark, sf_dir):
    """Missing nullable columns added to an old table."""
    old = B.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("title"))
    wide = coverage.ensure_columns(old, schemas.PRODUCT_EMBEDDINGS)
    return wide.select("product_id", "title", F.col("embedding").isNull().alias("no_vector"), F.lit(len(wide.columns)).cast("bigint").alias("columns"))


@query(
    f"""WITH {sql.CAT} SELECT COUNT(*) AS total, COUNT(*) FILTER (embedding IS NULL) AS null_vectors,
       COUNT(*) FILTER (len(embedding) <> 64) AS wrong_length,
       COUNT(*) FILTER (embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero_vectors FROM cat"""
)
def vector_quality(spark, sf_dir):
    return coverage.vector_quality(B.catalog(spark, sf_dir), 64)


# ------------------------------------------------------------- comparison

_COMPARED = f"""WITH {sql.CAT}, {sql.INCOMING}, compared AS (
  SELECT i.shop_domain, i.product_id, i.ordinal, i.title, c.product_id IS NOT NULL AS known,
         c.product_id IS NOT NULL AND i.title IS DISTINCT FROM c.title AS title_changed,
         c.product_id IS NOT NULL AND COALESCE(i.description, '') IS DISTINCT FROM c.description AS description_changed,
         c.product_id IS NOT NULL AND COALESCE(i.price, 0) <> COALESCE(c.price, 0) AS price_changed
  FROM incoming i LEFT JOIN cat c ON c.shop_domain = i.shop_domain AND c.product_id = i.product_id
)"""


def _compared(spark, sf_dir):
    return diff.compare(B.incoming_catalog(spark, sf_dir), B.catalog(spark, sf_dir, vectors=False, descriptions=True))


@query(
    _COMPARED
    + """ SELECT shop_domain, product_id, ordinal, title, title_changed, description_changed, price_changed FROM compared
WHERE title_changed OR description_changed OR price_changed"""
)
def catalog_diff(spark, sf_dir):
    """Changed products of an incoming snapshot, field by field."""
    return diff.change_report(_compared(spark, sf_dir))


@query(
    _COMPARED
    + """ SELECT shop_domain, product_id, ordinal, title_changed, description_changed, price_changed,
  CASE WHEN NOT known THEN 'new' WHEN title_changed OR description_changed OR price_changed THEN 'updated' ELSE 'unchanged' END AS change_class
FROM compared"""
)
def catalog_diff_digest(spark, sf_dir):
    """The class of every incoming product, found by digests of key buckets."""
    stored = B.catalog(spark, sf_dir, vectors=False, descriptions=True)
    compared = diff.compare_by_digest(B.incoming_catalog(spark, sf_dir), stored)
    return compared.select("shop_domain", "product_id", "ordinal", "title_changed", "description_changed", "price_changed", "change_class")


@query(
    f"""WITH {sql.CAT} SELECT shop_domain, product_id, id % 97 = 0 AS title_changed, description IS NULL AS description_changed, id % 89 = 0 AS price_changed,
  CASE WHEN id % 97 = 0 OR id % 89 = 0 OR description IS NULL THEN 'updated' ELSE 'unchanged' END AS change_class FROM cat"""
)
def catalog_diff_sparse(spark, sf_dir):
    """A snapshot that differs in few products: only those of unequal buckets are compared."""
    stored = B.catalog(spark, sf_dir, vectors=False, descriptions=True)
    incoming = stored.withColumns(
        {
            "title": F.when(F.col("id") % 97 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")),
            "price": (F.col("price") + F.when(F.col("id") % 89 == 0, 1).otherwise(0)).cast("decimal(10,2)"),
            "ordinal": F.col("id"),
        }
    )
    compared = diff.compare_by_digest(incoming, stored)
    return compared.select("shop_domain", "product_id", "title_changed", "description_changed", "price_changed", "change_class")


@query(
    _COMPARED
    + """ SELECT shop_domain, CASE WHEN NOT known THEN 'new' WHEN title_changed OR description_changed OR price_changed THEN 'updated'
       ELSE 'unchanged' END AS change_class, COUNT(*) AS products FROM compared GROUP BY 1, 2"""
)
def catalog_diff_classes(spark, sf_dir):
    return diff.class_counts(_compared(spark, sf_dir))


@query(
    _COMPARED
    + f""", last AS (SELECT * FROM compared QUALIFY row_number() OVER (PARTITION BY shop_domain, product_id ORDER BY ordinal DESC) = 1)
SELECT shop_domain, product_id, title, title_changed OR description_changed OR price_changed AS needs_resync FROM last"""
)
def snapshot_resync_flags(spark, sf_dir):
    """An applied snapshot's resync flags, read back from the metadata."""
    stored = B.stored_catalog(spark, sf_dir)
    merged = diff.apply_snapshot(B.incoming_catalog(spark, sf_dir), stored, LATER)
    return merged.select("shop_domain", "product_id", "title", J.flag("metadata", "needs_resync").alias("needs_resync"))


@query(f"WITH {sql.CAT} SELECT shop_domain, product_id, 'missing' AS reason FROM cat WHERE embedding IS NULL UNION ALL SELECT shop_domain, product_id, 'flagged' FROM cat WHERE needs_resync")
def embed_worklist(spark, sf_dir):
    """Products to embed: without a vector, or flagged for it."""
    catalog = B.catalog(spark, sf_dir)
    missing = diff.missing_vectors(catalog).select("shop_domain", "product_id", F.lit("missing").alias("reason"))
    flagged = diff.flagged_for_resync(catalog).select("shop_domain", "product_id", F.lit("flagged").alias("reason"))
    return missing.unionByName(flagged)


@query(f"WITH {sql.CAT} SELECT shop_domain, product_id FROM cat WHERE embedding IS NULL ORDER BY product_id, shop_domain LIMIT 50")
def embed_worklist_first(spark, sf_dir):
    """The bounded worklist of one incremental run."""
    return diff.missing_vectors(B.catalog(spark, sf_dir), limit=50).select("shop_domain", "product_id")


# -------------------------------------------------------------- embedding


@query("SELECT lang, COUNT(*) AS total, COUNT(*) FILTER (length(trim(text)) > 0) AS success, COUNT(*) FILTER (length(trim(text)) = 0 OR text IS NULL) AS failures FROM documents GROUP BY 1")
def embed_outcome(spark, sf_dir):
    """Batch embedding of every document's whole text, outcomes per language."""
    rows = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    embedded = embedding.embed_rows(rows, "text", embedding.hashing_embedder(64))
    return embedding.outcome(embedded, "lang")


def millionths(vector):
    """A vector as whole numbers of millionths, comma-joined."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint").cast("string")), ",")


_CATEGORISED = """concat_ws(' ', title, NULLIF(description, ''), 'Category: ' || category, 'Tags: ' || array_to_string(tags, ', '))"""


@query(
    f"""WITH {sql.CAT}, {sql.embedded(f"SELECT shop_domain, product_id, {_CATEGORISED} AS text FROM cat", "shop_domain, product_id")}
SELECT shop_domain, product_id, 'ok' AS status, 64 AS dim, vector FROM vectors"""
)
def embed_batch(spark, sf_dir):
    """Catalogue texts embedded by the local embedder, vector by vector."""
    rows = B.catalog(spark, sf_dir, vectors=False, descriptions=True)
    c = F.col
    text = X.category_text(c("title"), c("description"), c("category"), c("tags"))
    embedded = embedding.embed_rows(rows.select("shop_domain", "product_id", text.alias("text")), "text", embedding.word_embedder(64))
    return embedded.select("shop_domain", "product_id", "status", F.size("embedding").alias("dim"), millionths("embedding").alias("vector"))


@query(
    """SELECT lang, model, text_count, average_length, text_count * CAST(ceil(average_length / 4.0) AS BIGINT) AS total_tokens,
       round(text_count * CAST(ceil(average_length / 4.0) AS BIGINT) * price / 1000000, 9) AS estimated_cost
FROM (SELECT lang, COUNT(*) AS text_count, CAST(floor(avg(length(text))) AS BIGINT) AS average_length FROM documents WHERE text IS NOT NULL GROUP BY 1),
     (VALUES """
    + ", ".join(f"('{model}', {price}::DOUBLE)" for model, price in seeds.MODEL_PRICES.items())
    + """) m(model, price)"""
)
def cost_planned(spark, sf_dir):
    """Planned embedding cost per language: texts times their average length."""
    sized = B.table(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy("lang").agg(
        F.count(F.lit(1)).alias("text_count"), F.floor(F.avg(F.length("text"))).cast("bigint").alias("average_length")
    )
    costs = embedding.planned_costs(sized)
    return costs.select("lang", "model", "text_count", "average_length", "total_tokens", F.round("estimated_cost", 9).alias("estimated_cost"))


@query(
    f"""WITH {sql.CAT} SELECT 'typed' AS source, shop_domain, COUNT(*) AS products, COUNT(embedding) AS vectors, COUNT(*) - COUNT(embedding) AS to_embed FROM cat GROUP BY 2
UNION ALL SELECT 'text', shop_domain, COUNT(*), 0, COUNT(*) FROM cat GROUP BY 2"""
)
def vector_repair(spark, sf_dir):
    """The vector column checked and, where it has the wrong type (here text), replaced by an empty one."""
    right = B.catalog(spark, sf_dir)
    wrong = right.withColumn("embedding", V.to_text(F.col("embedding")))
    out = None
    for source, table in (("typed", right), ("text", wrong)):
        fixed = coverage.repaired_vectors(table)
        counts = coverage.index_coverage(fixed, "shop_domain").select(
            F.lit(source).alias("source"), "shop_domain", F.col("total_products").alias("products"),
            F.col("indexed_products").alias("vectors"), F.col("missing_embeddings").alias("to_embed"),
        )
        out = counts if out is None else out.unionByName(counts)
    return out


def _cache(spark, sf_dir):
    """A cache holding the documents' texts, one day or two weeks old by their length."""
    age = F.when(F.col("n_chars") % 3 == 0, F.lit(14)).otherwise(F.lit(1))
    texts = B.table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "fr"))
    keyed = embedding.keyed(texts, "text").withColumn("cached_at", F.lit(B.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(days=age))
    newest = keyed.groupBy("cache_key").agg(F.max("cached_at").alias("cached_at"))
    return newest.withColumn("embedding", F.array(*[F.lit(0.5).cast("float")] * 4))


@query(
    """WITH cache AS (SELECT DISTINCT text FROM documents WHERE lang IN ('en', 'fr') AND n_chars % 3 <> 0)
SELECT sha256('embedding:text-embedding-3-small:' || text) AS cache_key, length(text) AS chars
FROM (SELECT DISTINCT text FROM documents WHERE length(trim(text)) > 0) WHERE text NOT IN (SELECT text FROM cache)"""
)
def embed_cache_misses(spark, sf_dir):
    """Distinct texts without a live cache entry."""
    misses = embedding.cache_misses(B.table(spark, sf_dir, "documents"), "text", _cache(spark, sf_dir), B.AS_OF)
    return misses.select("cache_key", F.length("text").cast("bigint").alias("chars"))


@query(
    """WITH cache AS (SELECT DISTINCT text FROM documents WHERE lang IN ('en', 'fr') AND n_chars % 3 <> 0)
SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN -1 WHEN text IN (SELECT text FROM cache) THEN 4 ELSE 64 END AS dim FROM documents"""
)
def embed_through_cache(spark, sf_dir):
    """Every document embedded through the cache; hits keep the cached vector."""
    documents = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = embedding.embed_through_cache(
        documents, "text", _cache(spark, sf_dir), embedding.hashing_embedder(64), B.AS_OF, spread=["doc_id"]
    )
    return found.select("doc_id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"))


@query(
    f"""WITH {sql.CAT} SELECT shop_domain, product_id, CASE WHEN needs_resync THEN 32 WHEN embedding IS NULL THEN -1 ELSE 64 END AS dim,
       CASE WHEN needs_resync THEN 6 ELSE 7 END AS keys FROM cat"""
)
def regenerate_flagged(spark, sf_dir):
    """Flagged products embedded again, their flag removed."""
    stored = B.stored_catalog(spark, sf_dir)
    c = F.col
    work = diff.flagged_for_resync(stored).withColumn(
        "text", X.flat_text(c("title"), c("description"), c("vendor"), c("category"), c("tags"))
    )
    snapshot, _ = embedding.regenerate(stored, work, "text", embedding.hashing_embedder(32), LATER, clear="remove")
    return snapshot.select("shop_domain", "product_id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"), F.size(F.json_object_keys("metadata")).alias("keys"))


@query(
    f"""WITH {sql.CAT}, {sql.SEARCHES} SELECT shop_domain, product_id, 32 AS dim FROM cat WHERE product_id IN (SELECT clicked_product_id FROM searches)"""
)
def reembed_listed(spark, sf_dir):
    """Products named by a list (those clicked in the log) embedded again."""
    stored = B.stored_catalog(spark, sf_dir)
    listed_ids = B.search_events(spark, sf_dir).filter("clicked_product_id IS NOT NULL").select(F.col("clicked_product_id").alias("product_id"))
    work = C.lookup_products(stored, listed_ids).withColumn("text", X.title_text(F.col("title"), F.col("description")))
    snapshot, _ = embedding.regenerate(stored, work, "text", embedding.hashing_embedder(32), LATER, clear="set_false")
    return snapshot.select("shop_domain", "product_id", F.size("embedding").alias("dim")).filter("dim = 32")


@query(
    """WITH sized AS (SELECT COUNT(*) AS text_count, CAST(SUM(ceil(length(text) / 4.0)) AS BIGINT) AS total_tokens FROM documents)
SELECT p.model, text_count, total_tokens, p.price AS price_per_million, total_tokens / 1000000.0::DOUBLE * p.price AS estimated_cost FROM sized,
(VALUES ('text-embedding-3-small', 0.02::DOUBLE), ('text-embedding-3-large', 0.13::DOUBLE), ('text-embedding-ada-002', 0.10::DOUBLE)) p(model, price)"""
)
def cost_estimate(spark, sf_dir):
    return embedding.cost_estimate(B.table(spark, sf_dir, "documents"), "text")


@query(
    f"""WITH {sql.SEARCHES}
SELECT 'search' AS event_type, query, original_query, results_count, store_id, keys FROM (
  SELECT lower(query) AS query, query AS original_query, COALESCE(results_count, 0) AS results_count, shop_domain AS store_id, CAST(3 AS BIGINT) AS keys FROM searches)"""
)
def search_event_rows(spark, sf_dir):
    """Answered requests as event rows, both query texts and the filters kept."""
    answered = B.search_events(spark, sf_dir).select(
        F.col("id").alias("query_id"), "query", F.lower("query").alias("corrected_query"), "shop_domain",
        F.coalesce("results_count", F.lit(0)).alias("results_count"), F.lit(None).cast("double").alias("max_price"),
        F.lit(10).alias("k"), F.lit(0.1).alias("min_similarity"),
    )
    events = merge.search_events(answered, B.AS_OF)
    return events.select("event_type", "query", "original_query", "results_count", "store_id", F.size(F.json_object_keys("filters")).cast("bigint").alias("keys"))
