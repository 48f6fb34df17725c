"""Registered queries: statistics, metering, text functions, signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine import sqlapi
from vitrine.functions import signing
from vitrine.functions import text as X
from vitrine.functions import numeric as N
from vitrine.operators import analytics, coverage, distinct, merge, metering, search, webhooks
from vitrine.plans import bindings as B
from vitrine.plans import sql
from vitrine.plans.registry import day, listed, moment, query
from vitrine.sources import seeds

DAYS = 14
_PERIOD = f"{sql.SEARCHES}, period AS (SELECT * FROM searches WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL {DAYS} DAY)"


def _period(spark, sf_dir):
    return analytics.in_period(B.search_events(spark, sf_dir), B.AS_OF, DAYS)


_DAILY = f"""COUNT(*) AS total_searches, COUNT(*) FILTER (results_count > 0) AS searches_with_results,
       COUNT(*) FILTER (results_count = 0) AS searches_no_results, {sql.average('results_count')} AS avg_results"""


@query(f"WITH {_PERIOD} SELECT {sql.day('CAST(created_at AS DATE)')} AS date, {_DAILY} FROM period GROUP BY 1")
def daily_stats(spark, sf_dir):
    return analytics.daily_stats(_period(spark, sf_dir)).withColumn("date", day("date"))


@query(f"WITH {_PERIOD} SELECT shop_domain, {sql.day('CAST(created_at AS DATE)')} AS date, {_DAILY} FROM period GROUP BY 1, 2")
def daily_stats_by_tenant(spark, sf_dir):
    return analytics.daily_stats(_period(spark, sf_dir), "shop_domain").withColumn("date", day("date"))


_TOP = f"COUNT(*) AS search_count, {sql.average('results_count')} AS avg_results, {sql.moment('MAX(created_at)')} AS last_searched"


@query(f"WITH {_PERIOD} SELECT query, {_TOP} FROM period GROUP BY query ORDER BY search_count DESC, query LIMIT 20")
def top_queries(spark, sf_dir):
    return analytics.top_queries(_period(spark, sf_dir)).withColumn("last_searched", moment("last_searched"))


@query(
    f"""WITH {_PERIOD}, counted AS (SELECT shop_domain, query, {_TOP} FROM period GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY shop_domain ORDER BY search_count DESC, query) AS rank FROM counted QUALIFY rank <= 20"""
)
def top_queries_by_tenant(spark, sf_dir):
    return analytics.top_queries(_period(spark, sf_dir), 20, "shop_domain").withColumn("last_searched", moment("last_searched"))


@query(
    f"""WITH {_PERIOD} SELECT id, query, COALESCE(results_count, 0) AS results_count, {sql.moment('created_at')} AS created_at
FROM period ORDER BY period.created_at DESC, id DESC LIMIT 50"""
)
def recent_searches(spark, sf_dir):
    return analytics.recent_searches(_period(spark, sf_dir)).withColumn("created_at", moment("created_at"))


_ZERO = "COUNT(*) FILTER (COALESCE(results_count, 0) = 0)"
_SUMMARY = f"""COUNT(*) AS total_searches, COUNT(DISTINCT query) AS unique_queries, {_ZERO} AS no_results_count,
       {sql.average('results_count')} AS avg_results, {sql.ratio(f'100 * {_ZERO}', 'COUNT(*)', 1)} AS no_results_percentage"""


@query(f"WITH {_PERIOD} SELECT {_SUMMARY} FROM period")
def search_summary(spark, sf_dir):
    return analytics.summary(_period(spark, sf_dir))


@query(f"WITH {_PERIOD} SELECT shop_domain, {_SUMMARY} FROM period GROUP BY 1")
def search_summary_by_tenant(spark, sf_dir):
    return analytics.summary(_period(spark, sf_dir), "shop_domain")


@query(
    f"""WITH {sql.SEARCHES}, dated AS (SELECT *, CAST(created_at AS DATE) AS date FROM searches),
measures AS (
  SELECT shop_domain, date, COUNT(*) AS total_searches, COUNT(DISTINCT session_id) AS unique_users,
         {sql.average('results_count')} AS avg_results_per_search,
         {sql.ratio(f'100 * {_ZERO}', 'COUNT(*)', 2)} AS zero_results_rate,
         {sql.ratio('100 * COUNT(clicked_product_id)', 'COUNT(*)', 2)} AS click_through_rate,
         CAST({sql.ratio('SUM(time_to_click_ms)', 'COUNT(time_to_click_ms)', 0)} AS INTEGER) AS avg_time_to_click_ms,
         {sql.ratio('SUM(clicked_position)', 'COUNT(clicked_position)')} AS avg_clicked_position
  FROM dated GROUP BY 1, 2),
ranked AS (
  SELECT shop_domain, date, query, n, row_number() OVER (PARTITION BY shop_domain, date ORDER BY n DESC, query) AS rank
  FROM (SELECT shop_domain, date, query, COUNT(*) AS n FROM dated GROUP BY 1, 2, 3) QUALIFY rank <= 5),
best AS (
  SELECT shop_domain, date, '[' || string_agg('{{"query":"' || query || '","count":' || CAST(n AS VARCHAR) || '}}', ',' ORDER BY rank) || ']' AS top_queries
  FROM ranked GROUP BY 1, 2)
SELECT m.* EXCLUDE (date), {sql.day('m.date')} AS date, b.top_queries FROM measures m JOIN best b ON m.shop_domain = b.shop_domain AND m.date = b.date"""
)
def daily_rollup(spark, sf_dir):
    """Rollup per tenant and day with its top queries."""
    return analytics.daily_rollup(B.search_events(spark, sf_dir), store="shop_domain").withColumn("date", day("date"))


_WINDOW = 7
_TRAILING = f"""WITH {sql.SEARCHES}, dated AS (SELECT *, CAST(created_at AS DATE) AS day FROM searches),
days AS (SELECT DISTINCT day FROM dated),
counted AS (
  SELECT s.shop_domain, d.day, COUNT(DISTINCT s.query) AS queries, COUNT(DISTINCT s.session_id) AS sessions
  FROM days d JOIN dated s ON s.day <= d.day AND s.day > d.day - {_WINDOW} GROUP BY 1, 2
)"""


@query(
    _TRAILING + f" SELECT shop_domain, {sql.day('day')} AS date, queries AS unique_queries, sessions AS unique_users FROM counted"
)
def trailing_uniques(spark, sf_dir):
    """Distinct queries and sessions of every trailing week, per tenant, from daily bitmaps."""
    events = B.search_events(spark, sf_dir)
    out = None
    for value, name in (("query", "unique_queries"), ("session_id", "unique_users")):
        state = distinct.daily_bitmaps(events, value, distinct.numbered(events, value), "created_at", "shop_domain")
        counted = distinct.trailing_distinct(state, _WINDOW, "shop_domain", name=name)
        out = counted if out is None else out.join(counted, ["shop_domain", "date"])
    return out.withColumn("date", day("date"))


@query(_TRAILING + f" SELECT shop_domain, {sql.day('day')} AS date, queries AS unique_queries, TRUE AS within_bound FROM counted")
def trailing_uniques_sketch(spark, sf_dir):
    """The same from daily sketches: every estimate is within four standard errors of the exact count."""
    events = B.search_events(spark, sf_dir)
    state = distinct.daily_bitmaps(events, "query", distinct.numbered(events, "query"), "created_at", "shop_domain")
    exact = distinct.trailing_distinct(state, _WINDOW, "shop_domain", name="unique_queries")
    sketches = distinct.daily_sketches(events, "query", "created_at", "shop_domain")
    estimated = distinct.trailing_estimate(sketches, _WINDOW, "shop_domain", name="estimate")
    close = distinct.within_error(F.col("estimate"), F.col("unique_queries")).alias("within_bound")
    return exact.join(estimated, ["shop_domain", "date"]).select("shop_domain", day("date").alias("date"), "unique_queries", close)


@query(
    f"""WITH {sql.CAT}, {sql.SEARCHES}, clicks AS (
  SELECT clicked_product_id AS product_id, COUNT(*) AS clicks, MIN(clicked_position) AS best_position FROM searches WHERE clicked_product_id IS NOT NULL GROUP BY 1
)
SELECT product_id, clicks, best_position, cat.title, cat.vendor FROM clicks LEFT JOIN cat USING (product_id)"""
)
def click_details(spark, sf_dir):
    """Clicked products with their catalogue fields."""
    products = B.catalog(spark, sf_dir, vectors=False).select("product_id", "title", "vendor")
    return analytics.click_details(B.search_events(spark, sf_dir), products)


_TENANTS = "tenants AS (SELECT DISTINCT 'shop_' || CAST(c_custkey AS VARCHAR) AS shop_domain FROM customer)"


def _tenants(spark, sf_dir):
    return B.subscriptions(spark, sf_dir).select("shop_domain")


@query(
    f"""WITH {sql.SEARCHES}, {_TENANTS}, recent AS (
  SELECT shop_domain, COUNT(*) AS n FROM searches WHERE created_at > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR GROUP BY 1
)
SELECT shop_domain, COALESCE(n, 0) AS recent_searches, n IS NOT NULL AS active, CASE WHEN n IS NULL THEN 'inactive' ELSE 'active' END AS status
FROM tenants LEFT JOIN recent USING (shop_domain)"""
)
def tenant_activity(spark, sf_dir):
    """Searches of the last day per subscribed tenant."""
    return analytics.tenant_activity(B.search_events(spark, sf_dir), _tenants(spark, sf_dir), B.AS_OF)


def _pings(spark, sf_dir):
    return B.table(spark, sf_dir, "events").filter("event_type = 'signup'").select(
        F.concat(F.lit("shop_"), F.col("user_id").cast("string")).alias("shop_domain"), F.col("ts").alias("pinged_at")
    )


@query(
    f"""WITH {_TENANTS}, seen AS (
  SELECT 'shop_' || CAST(user_id AS VARCHAR) AS shop_domain, MAX(ts) AS last_seen FROM events WHERE event_type = 'signup' GROUP BY 1
)
SELECT shop_domain, COALESCE({sql.moment('last_seen')}, 'never') AS last_seen,
       COALESCE(s.last_seen > TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR, FALSE) AS active,
       CASE WHEN s.last_seen IS NULL THEN 'never_activated' WHEN s.last_seen > TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR THEN 'active' ELSE 'inactive' END AS status
FROM tenants LEFT JOIN seen s USING (shop_domain)"""
)
def tenant_liveness(spark, sf_dir):
    """Liveness of each tenant from its last ping."""
    alive = analytics.tenant_liveness(_pings(spark, sf_dir), _tenants(spark, sf_dir), B.AS_OF)
    return alive.withColumn("last_seen", F.coalesce(moment("last_seen"), F.lit("never")))


# ---------------------------------------------------------------- coverage

_COVERAGE = "COUNT(*) AS total_products, COUNT(embedding) AS indexed_products, COUNT(*) FILTER (embedding IS NULL) AS missing_embeddings"


@query(f"WITH {sql.CAT} SELECT {_COVERAGE} FROM cat")
def index_coverage(spark, sf_dir):
    return coverage.index_coverage(B.catalog(spark, sf_dir))


@query(f"WITH {sql.CAT} SELECT shop_domain, {_COVERAGE} FROM cat GROUP BY 1")
def index_coverage_by_tenant(spark, sf_dir):
    return coverage.index_coverage(B.catalog(spark, sf_dir), "shop_domain")


@query(
    f"""WITH {sql.CAT}, first AS (
  SELECT shop_domain, title, row_number() OVER (PARTITION BY shop_domain ORDER BY title, product_id) AS n FROM cat WHERE embedding IS NULL QUALIFY n <= 3
), samples AS (SELECT shop_domain, string_agg(title, '|' ORDER BY n) AS sample_products FROM first GROUP BY 1),
counted AS (SELECT shop_domain, COUNT(*) AS total_products, COUNT(embedding) AS with_embeddings, COUNT(*) FILTER (embedding IS NULL) AS needs_sync FROM cat GROUP BY 1)
SELECT counted.*, needs_sync > 0 AS show_alert, CASE WHEN needs_sync > 0 THEN 'needs_sync' ELSE 'ready' END AS status,
       COALESCE(sample_products, '') AS sample_products FROM counted LEFT JOIN samples USING (shop_domain)"""
)
def sync_status(spark, sf_dir):
    status = coverage.sync_status(B.catalog(spark, sf_dir))
    return status.withColumn("sample_products", listed("sample_products"))


@query(f"WITH {sql.CAT} SELECT shop_domain, COUNT(*) AS products FROM cat GROUP BY 1")
def product_counts(spark, sf_dir):
    return coverage.product_counts(B.catalog(spark, sf_dir, vectors=False))


# ---------------------------------------------------------------- metering

_IDS = {s: [n for n, *_ in seeds.PLAN_ROWS].index(p) + 1 for s, p in B.SEGMENT_PLANS.items()}
_SUBS = sql.subscriptions(_IDS)
_DUE = "search_reset_date <= DATE '2024-01-31' - 30"

_LIMITS = f"""WITH {sql.CAT}, {sql.SEARCHES}, {sql.USAGE}, {sql.plans()}, {_SUBS},
current AS (SELECT shop_domain, plan_id, CASE WHEN {_DUE} THEN DATE '2024-01-31' ELSE search_reset_date END AS reset FROM subs),
products AS (SELECT shop_domain, COUNT(*) AS n FROM cat GROUP BY 1),
used AS (SELECT c.shop_domain, SUM(u.usage_count) AS n FROM current c JOIN usage u ON u.shop_domain = c.shop_domain AND u.usage_date >= c.reset GROUP BY 1),
joined AS (
  SELECT c.shop_domain AS shop, p.name AS plan, COALESCE(n.n, 0) AS current_products, p.max_products,
         CAST(COALESCE(u.n, 0) AS BIGINT) AS current_searches, p.max_searches
  FROM current c LEFT JOIN plans p ON p.id = c.plan_id LEFT JOIN products n USING (shop_domain) LEFT JOIN used u USING (shop_domain)
),
limits AS (
  SELECT *, max_products <> -1 AND current_products > max_products AS products_exceeded,
         max_searches <> -1 AND current_searches >= max_searches AS searches_exceeded FROM joined
)"""


def _limits(spark, sf_dir):
    events = B.search_events(spark, sf_dir)
    return metering.plan_limits(
        B.subscriptions(spark, sf_dir), seeds.plans(spark), B.catalog(spark, sf_dir, vectors=False),
        metering.usage_from_events(events), as_of=B.AS_OF_DATE,
    )


@query(_LIMITS + " SELECT *, products_exceeded OR searches_exceeded AS upgrade_required FROM limits")
def plan_limits(spark, sf_dir):
    """Usage against caps for every tenant, overdue cycles reset first."""
    return _limits(spark, sf_dir)


@query(
    f"""WITH {sql.CAT}, {sql.SEARCHES}, {sql.USAGE}, {sql.plans()}, {_SUBS},
shops AS (SELECT shop_domain FROM subs UNION SELECT shop_domain FROM cat),
current AS (
  SELECT shop_domain, plan_id, CASE WHEN {_DUE} THEN DATE '2024-01-31' ELSE search_reset_date END AS reset
  FROM subs WHERE CAST(replace(shop_domain, 'shop_', '') AS INTEGER) % 3 <> 0
  UNION ALL
  SELECT shop_domain, 1, DATE '2024-01-31' FROM shops
  WHERE shop_domain NOT IN (SELECT shop_domain FROM subs WHERE CAST(replace(shop_domain, 'shop_', '') AS INTEGER) % 3 <> 0)
),
products AS (SELECT shop_domain, COUNT(*) AS n FROM cat GROUP BY 1),
used AS (SELECT c.shop_domain, SUM(u.usage_count) AS n FROM current c JOIN usage u ON u.shop_domain = c.shop_domain AND u.usage_date >= c.reset GROUP BY 1)
SELECT c.shop_domain AS shop,
       CASE c.plan_id WHEN 1 THEN 'starter' WHEN 2 THEN 'launch' WHEN 3 THEN 'growth' WHEN 4 THEN 'scale' ELSE 'enterprise' END AS plan,
       CASE c.plan_id WHEN 1 THEN 300 WHEN 2 THEN 1000 WHEN 3 THEN 7500 WHEN 4 THEN 20000 ELSE -1 END AS max_searches,
       COALESCE(n.n, 0) AS current_products, CAST(COALESCE(u.n, 0) AS BIGINT) AS current_searches
FROM current c LEFT JOIN products n USING (shop_domain) LEFT JOIN used u USING (shop_domain)"""
)
def plan_limits_unsubscribed(spark, sf_dir):
    """Limits of all tenants, a third of whom have no subscription yet."""
    catalog = B.catalog(spark, sf_dir, vectors=False)
    subscribed = B.subscriptions(spark, sf_dir)
    tenants = subscribed.select("shop_domain").union(catalog.select("shop_domain"))
    some = subscribed.filter(F.regexp_extract("shop_domain", r"(\d+)", 1).cast("int") % 3 != 0)
    usage = metering.usage_from_events(B.search_events(spark, sf_dir))
    limits = metering.plan_limits(some, seeds.plans(spark), catalog, usage, as_of=B.AS_OF_DATE, tenants=tenants)
    return limits.select("shop", "plan", "max_searches", "current_products", "current_searches")


@query(
    f"""WITH {_SUBS} SELECT shop_domain, CASE plan_id
  WHEN 1 THEN 'starter: ai_search,semantic_search,typo_correction,basic_analytics,email_support'
  WHEN 2 THEN 'launch: ai_search,semantic_search,typo_correction,analytics,user_intent,email_support'
  WHEN 3 THEN 'growth: ai_search,semantic_search,typo_correction,advanced_analytics,user_intent,merchandising,email_support'
  WHEN 4 THEN 'scale: ai_search,semantic_search,typo_correction,advanced_analytics,user_intent,merchandising,api_access,priority_support'
  ELSE 'enterprise: ai_search,semantic_search,typo_correction,unlimited,user_intent,merchandising,dedicated_support,custom_integrations,api_access,priority_support'
END AS features FROM subs"""
)
def plan_features(spark, sf_dir):
    """The features that each tenant's plan offers."""
    offered = seeds.plans(spark).select(
        F.col("id").alias("plan_id"),
        F.concat_ws(": ", "name", F.array_join(F.json_object_keys("features"), ",")).alias("features"),
    )
    return B.subscriptions(spark, sf_dir).join(F.broadcast(offered), "plan_id").select("shop_domain", "features")


_PLAN_NAMES = "CASE c_mktsegment WHEN 'BUILDING' THEN 'growth' ELSE lower(c_mktsegment) END"


@query(
    f"""WITH incoming AS (
  SELECT {_PLAN_NAMES} AS name, COUNT(*) AS n FROM customer GROUP BY 1),
stored (id, name, price, products, searches) AS (VALUES (1, 'starter', 0.0, 50, 300), (2, 'launch', 9.0, 250, 1000),
  (3, 'growth', 19.0, 2500, 7500), (4, 'scale', 49.0, 5000, 20000), (5, 'enterprise', 149.0, -1, -1)),
fresh AS (SELECT row_number() OVER (ORDER BY name) + 5 AS id, name, n FROM incoming WHERE name NOT IN (SELECT name FROM stored))
SELECT CAST(s.id AS BIGINT) AS id, s.name, CAST(COALESCE(i.n, s.price) AS DOUBLE) AS price,
       CAST(COALESCE(i.n * 2, s.products) AS BIGINT) AS max_products, CAST(COALESCE(i.n * 3, s.searches) AS BIGINT) AS max_searches
FROM stored s LEFT JOIN incoming i USING (name)
UNION ALL SELECT CAST(id AS BIGINT), name, CAST(n AS DOUBLE), n * 2, n * 3 FROM fresh"""
)
def plan_upsert(spark, sf_dir):
    """Plans priced by the size of a customer segment: one known, the others new,
    each sent twice; read back as the active plans."""
    name = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("growth")).otherwise(F.lower("c_mktsegment"))
    counted = B.table(spark, sf_dir, "customer").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    incoming = counted.select(
        "name",
        F.col("n").cast("decimal(10,2)").alias("price"),
        (F.col("n") * 2).cast("int").alias("max_products"),
        (F.col("n") * 3).cast("int").alias("max_searches_per_month"),
        F.lit(2).alias("ordinal"),
    )
    older = incoming.withColumns({"price": F.lit(1).cast("decimal(10,2)"), "ordinal": F.lit(1)})
    plans = merge.active_plans(merge.upsert_plans(seeds.plans(spark), older.unionByName(incoming)))
    return plans.select(
        F.col("id").cast("bigint").alias("id"), "name", F.col("price").cast("double").alias("price"),
        F.col("max_products").cast("bigint").alias("max_products"),
        F.col("max_searches_per_month").cast("bigint").alias("max_searches"),
    )


@query(
    _LIMITS
    + """ SELECT shop, '{"shop":"' || shop || '","plan":"' || plan || '","current_products":' || current_products || ',"max_products":' || max_products ||
       ',"current_searches":' || current_searches || ',"max_searches":' || max_searches || ',"products_exceeded":' || products_exceeded ||
       ',"searches_exceeded":' || searches_exceeded || ',"upgrade_required":' || (products_exceeded OR searches_exceeded) || '}' AS limits FROM limits"""
)
def plan_limit_documents(spark, sf_dir):
    return metering.limits_document(_limits(spark, sf_dir))


@query(
    _LIMITS
    + """ SELECT *, products_exceeded OR searches_exceeded AS upgrade_required,
       '{"shop":"' || shop || '","plan":"' || plan || '","current_products":' || current_products || ',"max_products":' || max_products ||
       ',"current_searches":' || current_searches || ',"max_searches":' || max_searches || ',"products_exceeded":' || products_exceeded ||
       ',"searches_exceeded":' || searches_exceeded || ',"upgrade_required":' || (products_exceeded OR searches_exceeded) || '}' AS document FROM limits"""
)
def sql_check_plan_limits(spark, sf_dir):
    """Both limit functions, called for every subscription from SQL text."""
    sqlapi.register_limits(spark, _limits(spark, sf_dir))
    B.subscriptions(spark, sf_dir).createOrReplaceTempView("vitrine_subscriptions")
    return spark.sql(
        """SELECT s.shop_domain AS shop, c.*, plan_limits_document(s.shop_domain) AS document
FROM vitrine_subscriptions s, LATERAL check_plan_limits(s.shop_domain) c"""
    )


@query(
    f"""WITH {_SUBS} SELECT shop_domain, CASE WHEN {_DUE} THEN 0 ELSE searches_this_month END AS searches_this_month,
       {sql.day(f"CASE WHEN {_DUE} THEN DATE '2024-01-31' ELSE search_reset_date END")} AS search_reset_date,
       COALESCE({sql.day(f"CASE WHEN {_DUE} THEN DATE '2024-03-01' ELSE billing_cycle_end END")}, 'none') AS billing_cycle_end FROM subs"""
)
def cycle_reset(spark, sf_dir):
    """Billing cycles started anew where 30 days have passed."""
    rows = metering.reset_cycles(B.subscriptions(spark, sf_dir), B.AS_OF_DATE)
    return rows.select(
        "shop_domain", "searches_this_month", day("search_reset_date").alias("search_reset_date"),
        F.coalesce(day("billing_cycle_end"), F.lit("none")).alias("billing_cycle_end"),
    )


@query(
    f"""WITH {_SUBS} SELECT shop_domain, CASE WHEN {_DUE} THEN 0 ELSE searches_this_month END AS searches_this_month,
       COALESCE({sql.day('billing_cycle_end')}, 'none') AS billing_cycle_end FROM subs"""
)
def monthly_reset(spark, sf_dir):
    """Monthly counters reset, billing cycles left alone."""
    rows = metering.reset_counters(B.subscriptions(spark, sf_dir), B.AS_OF_DATE)
    return rows.select("shop_domain", "searches_this_month", F.coalesce(day("billing_cycle_end"), F.lit("none")).alias("billing_cycle_end"))


@query(
    f"""WITH {sql.SEARCHES}, {_SUBS}, n AS (SELECT shop_domain, COUNT(*) AS n FROM searches GROUP BY 1)
SELECT shop_domain, searches_this_month + COALESCE(n, 0) AS searches_this_month FROM subs LEFT JOIN n USING (shop_domain)"""
)
def search_counter(spark, sf_dir):
    """Monthly counters raised by the search log."""
    rows = metering.count_searches(B.subscriptions(spark, sf_dir), B.search_events(spark, sf_dir))
    return rows.select("shop_domain", "searches_this_month")


# The plan table before the renames: two old plans and one never used.
_OLD = [("free", "0.00", 10, 100), ("pro", "29.00", 500, 5000), ("basic", "5.00", 20, 200)]
_OLD_IDS = {"HOUSEHOLD": 6, "BUILDING": 7, "MACHINERY": 3, "AUTOMOBILE": 4, "FURNITURE": 5}
_MIGRATED = f"""moved AS (SELECT shop_domain, CASE plan_id WHEN 6 THEN 2 WHEN 7 THEN 3 ELSE plan_id END AS plan_id FROM subs)"""


def _old_subscriptions(spark, sf_dir):
    return B.subscriptions(spark, sf_dir, {B.SEGMENT_PLANS[s]: i for s, i in _OLD_IDS.items()})


@query(
    f"""WITH {sql.plans(_OLD)}, {sql.subscriptions(_OLD_IDS)}, {_MIGRATED}
SELECT p.name, CAST(p.price AS DOUBLE) AS price, COUNT(m.shop_domain) AS user_count FROM plans p LEFT JOIN moved m ON m.plan_id = p.id
WHERE p.name NOT IN ('free', 'basic', 'pro', 'business') GROUP BY 1, 2"""
)
def plan_distribution(spark, sf_dir):
    """Users per active plan after the renames and the deactivation of old plans."""
    plans = seeds.plans(spark, _OLD)
    moved = metering.migrate_plans(_old_subscriptions(spark, sf_dir), plans, seeds.plan_renames(spark))
    offered = merge.deactivate_plans(plans, [old for old, _ in seeds.PLAN_RENAMES])
    return metering.plan_distribution(offered, moved).withColumn("price", F.col("price").cast("double"))


@query(f"WITH {sql.subscriptions(_OLD_IDS)}, {_MIGRATED} SELECT shop_domain, plan_id FROM moved")
def plan_migration(spark, sf_dir):
    """Subscriptions after the plan renames."""
    moved = metering.migrate_plans(_old_subscriptions(spark, sf_dir), seeds.plans(spark, _OLD), seeds.plan_renames(spark))
    return moved.select("shop_domain", "plan_id")


@query(
    f"""WITH {sql.subscriptions(_OLD_IDS)}
SELECT * FROM (VALUES ('basic', 'launch', 'no_users', CAST(0 AS BIGINT)), ('business', 'scale', 'old_plan_missing', 0)) v(old_name, new_name, status, migrated_users)
UNION ALL SELECT 'free', 'launch', 'migrated', COUNT(*) FROM subs WHERE plan_id = 6
UNION ALL SELECT 'pro', 'growth', 'migrated', COUNT(*) FROM subs WHERE plan_id = 7"""
)
def plan_migration_report(spark, sf_dir):
    """Moved users per rename, or the reason nobody moved."""
    return metering.migration_report(_old_subscriptions(spark, sf_dir), seeds.plans(spark, _OLD), seeds.plan_renames(spark))


@query(
    f"""WITH {_SUBS} SELECT shop_domain, {sql.day("COALESCE(billing_cycle_end, DATE '2024-03-01')")} AS billing_cycle_end,
       (SELECT COUNT(*) FROM subs WHERE billing_cycle_end IS NULL) AS updated_rows FROM subs"""
)
def cycle_backfill(spark, sf_dir):
    """Missing cycle ends filled, with the number of rows filled."""
    rows = B.subscriptions(spark, sf_dir)
    filled = metering.backfill_cycle_end(rows, B.AS_OF_DATE)
    count = metering.backfill_count(rows).scalar()
    return filled.select("shop_domain", day("billing_cycle_end").alias("billing_cycle_end"), count.alias("updated_rows"))


# ---------------------------------------------------------------- text


@query(f"SELECT page_id, md5({sql.strip_html('html')}) AS text_md5, length({sql.strip_html('html')}) AS chars FROM pages")
def html_strip(spark, sf_dir):
    """Whole pages without their markup."""
    stripped = X.strip_html(F.col("html"))
    return B.table(spark, sf_dir, "pages").select("page_id", F.md5(stripped).alias("text_md5"), F.length(stripped).cast("bigint").alias("chars"))


_TITLE = "p_name || ': ' || p_brand || ' | ' || p_type || ' &  ' || CAST(p_size AS VARCHAR)"


@query(
    f"""SELECT p_partkey, regexp_replace(regexp_replace(trim(translate(replace(lower({_TITLE}), ' ', '-'), ':|', '')), '-+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS slug FROM part"""
)
def slug(spark, sf_dir):
    title = F.concat("p_name", F.lit(": "), "p_brand", F.lit(" | "), "p_type", F.lit(" &  "), F.col("p_size").cast("string"))
    return B.table(spark, sf_dir, "part").select("p_partkey", X.slug(title).alias("slug"))


@query(
    f"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ',')) END AS tags,
       md5(CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(string_split(text, ','), lambda t: regexp_replace(t, '^{sql.SPACE}+|{sql.SPACE}+$', '', 'g')), '|') END) AS tags_md5
FROM documents"""
)
def tag_parse(spark, sf_dir):
    """Comma lists to trimmed tags, over the documents' whole texts."""
    tags = X.parse_tags(F.col("text"))
    return B.table(spark, sf_dir, "documents").select("doc_id", F.size(tags).cast("bigint").alias("tags"), F.md5(listed(tags)).alias("tags_md5"))


@query("SELECT page_id, string_split(regexp_replace(url, 'https?://', '', 'g'), '/')[1] AS host FROM pages")
def tenant_host(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", X.tenant_host(F.col("url")).alias("host"))


@query(
    f"""WITH {sql.CAT}, banded AS (SELECT *, (price - 900) * 2 AS p FROM cat)
SELECT CASE WHEN p > 0 THEN CASE WHEN p < 50 THEN 'budget' WHEN p < 150 THEN 'mid' ELSE 'premium' END ELSE 'none' END AS band,
       COUNT(*) AS products, {sql.ratio('SUM(p)', 'COUNT(*)')} AS avg_price FROM banded GROUP BY 1"""
)
def price_band(spark, sf_dir):
    """Products per price band."""
    rows = B.catalog(spark, sf_dir, vectors=False).withColumn("p", ((F.col("price") - 900) * 2).cast("decimal(12,2)"))
    return rows.groupBy(F.coalesce(X.price_band(F.col("p")), F.lit("none")).alias("band")).agg(
        F.count(F.lit(1)).alias("products"), N.rounded_ratio(F.sum("p"), F.count(F.lit(1))).alias("avg_price")
    )


_D = "NULLIF(description, '')"
_TAGS = "array_to_string(tags, ', ')"
_WORDS = f"CASE WHEN price > 0 THEN CASE WHEN price < 50 THEN '{X.BUDGET_WORDS}' WHEN price < 150 THEN '{X.MIDDLE_WORDS}' ELSE '{X.PREMIUM_WORDS}' END END"
_TEMPLATES = {
    "multilingual": f"concat_ws(' ', title, {_D}, '| ' || upper(title), {_D}, 'Brand: ' || vendor, 'Category: ' || category, 'Tags: ' || {_TAGS})",
    "storefront": f"concat_ws(' | ', title, 'Category: ' || category, 'Brand: ' || vendor, CASE WHEN {_D} IS NOT NULL THEN {sql.strip_html('description')} END, 'Tags: ' || {_TAGS})",
    "bilingual": f"""concat_ws(' ', title, title, {_D}, 'Brand: ' || vendor, 'Marca: ' || vendor, 'Category: ' || category, 'Categoría: ' || category,
        'Type: ' || category, 'Tipo: ' || category, 'Tags: ' || {_TAGS}, 'Etiquetas: ' || {_TAGS}, {_WORDS}, 'Sizes: ' || CAST(size AS VARCHAR))""",
    "weighted": f"concat_ws(' ', title, title, {_D}, 'Brand: ' || vendor)",
    "categorised": f"concat_ws(' ', title, {_D}, 'Category: ' || category, 'Tags: ' || {_TAGS})",
    "spanish": f"concat_ws(' ', title, {_D}, 'Categoría: ' || category, 'Etiquetas: ' || {_TAGS})",
    "flat": f"concat_ws(' ', title, description, vendor, category, array_to_string(tags, ' '))",
    "titled": "title || '. ' || COALESCE(description, '')",
}


@query(
    f"WITH {sql.CAT} SELECT product_id, "
    + ", ".join(f"md5({text}) AS {name}" for name, text in _TEMPLATES.items())
    + " FROM cat"
)
def text_templates(spark, sf_dir):
    """Every embedding text of every product, over whole descriptions."""
    c = F.col
    rows = B.catalog(spark, sf_dir, vectors=False, descriptions=True)
    translations = F.array(F.struct(F.upper("title").alias("title"), c("description").alias("description")))
    size = F.get_json_object("metadata", "$.sizes[0]")
    made = {
        "multilingual": X.multilingual_text(c("title"), c("description"), translations, c("vendor"), c("category"), c("tags")),
        "storefront": X.storefront_text(c("title"), c("category"), c("vendor"), c("description"), c("tags")),
        "bilingual": X.bilingual_text(
            c("title"), c("description"), c("vendor"), c("category"), c("category"), c("tags"), c("price"), sizes=size
        ),
        "weighted": X.weighted_text(c("title"), c("description"), c("vendor")),
        "categorised": X.category_text(c("title"), c("description"), c("category"), c("tags")),
        "spanish": X.category_text(c("title"), c("description"), c("category"), c("tags"), "Categoría", "Etiquetas"),
        "flat": X.flat_text(c("title"), c("description"), c("vendor"), c("category"), c("tags")),
        "titled": X.title_text(c("title"), c("description"), ". "),
    }
    return rows.select("product_id", *[F.md5(text).alias(name) for name, text in made.items()])


@query(
    """SELECT doc_id, sha256('embedding:text-embedding-3-small:' || text) AS cache_key FROM documents"""
)
def embedding_cache_key(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", X.cache_key(seeds.DEFAULT_MODEL, F.col("text")).alias("cache_key"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 1000 WHEN k % 10 = 0 THEN 10 ELSE least(k, 10) END AS effective_limit,
       k / 100.0::DOUBLE AS threshold FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
)
def effective_limits(spark, sf_dir):
    """Effective result limit and threshold fraction per request."""
    k = F.get_json_object("props", "$.k").cast("int")
    configured = F.when(F.col("event_type") == "view", "unlimited").otherwise("10")
    requested = F.when(k % 10 != 0, k)
    return B.table(spark, sf_dir, "events").select(
        "event_id", search.effective_limit(configured, requested).alias("effective_limit"), search.threshold_fraction(k).alias("threshold")
    )


# ---------------------------------------------------------------- signatures

SECRET = "window display"


def signed_bodies(conversations, keep=()):
    """Conversation texts as signed bodies: every fifth turn unsigned, odd conversations
    signed with another secret."""
    right, wrong = signing.signature(SECRET, F.col("text")), signing.signature("not the " + SECRET, F.col("text"))
    signature = F.when(F.col("turn") % 5 == 4, F.lit(None)).when(F.col("conv_id") % 2 == 1, wrong).otherwise(right)
    return conversations.select("conv_id", "turn", F.col("text").alias("body"), signature.alias("signature"), *keep)


def _hmac(secret: str) -> str:
    inner, outer = signing._pads(secret)
    return f"base64(unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(text))))))"


@query(
    f"""SELECT conv_id, turn, {_hmac(SECRET)} AS expected,
       CASE WHEN turn % 5 = 4 THEN 'missing' WHEN conv_id % 2 = 1 THEN 'invalid' ELSE 'valid' END AS verdict FROM conversations"""
)
def webhook_verify(spark, sf_dir):
    """Signatures of whole texts checked: valid, invalid, missing."""
    verified = webhooks.verify(signed_bodies(B.table(spark, sf_dir, "conversations")), SECRET)
    return verified.select("conv_id", "turn", signing.signature(SECRET, F.col("body")).alias("expected"), "verdict")
