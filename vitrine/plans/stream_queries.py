"""Registered queries: streams drained over the given tables, equal to their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import schemas
from vitrine.functions import text as X
from vitrine.operators import analytics, buckets, embedding, merge
from vitrine.plans import analytics_queries as A
from vitrine.plans import bindings as B
from vitrine.plans import sql
from vitrine.plans.registry import day, moment, query
from vitrine.plans.table_queries import millionths
from vitrine.session import fresh_dir
from vitrine.streaming import jobs

# The given tables carry a month of events in no order of arrival.


def _stream(spark, sf_dir, name, schema):
    """A given table as a stream. It may be one file, which a stream only takes as a glob."""
    return jobs.read_files(spark, f"{sf_dir}/{name}.parque[t]", schema)


def _events(spark, sf_dir):
    return _stream(spark, sf_dir, "events", schemas.EVENTS)


def _searches(spark, sf_dir):
    return B.search_events_of(_events(spark, sf_dir))


@query(
    f"""WITH {sql.SEARCHES} SELECT shop_domain, 'search' AS usage_type, {sql.day('CAST(created_at AS DATE)')} AS usage_date, COUNT(*) AS usage_count
FROM searches GROUP BY 1, 2, 3"""
)
def stream_usage_counters(spark, sf_dir):
    """Usage metering as a stream."""
    stream = jobs.usage_counters(_searches(spark, sf_dir))
    final = jobs.drained_table(stream, ["shop_domain", "usage_type", "usage_date"], "usage")
    return final.withColumn("usage_date", day("usage_date"))


@query(f"WITH {sql.SEARCHES} SELECT {sql.day('CAST(created_at AS DATE)')} AS date, {A._DAILY} FROM searches GROUP BY 1")
def stream_daily_stats(spark, sf_dir):
    """Daily search statistics as a stream."""
    stream = jobs.daily_stats(_searches(spark, sf_dir))
    return jobs.drained_table(stream, ["date"], "daily").withColumn("date", day("date"))


_MIDDLE = "2024-01-16"


@query(
    f"""SELECT user_id, {sql.moment("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start,
  COUNT(*) FILTER (ts >= TIMESTAMP '{_MIDDLE}') AS accepted, COUNT(*) FILTER (ts < TIMESTAMP '{_MIDDLE}') AS late,
  COUNT(*) AS requests, COUNT(*) > 1 AS limited
FROM events GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts)"""
)
def stream_rate_limit(spark, sf_dir):
    """Requests per client and fixed window (here an hour and one request), with the default
    watermark. The second half of the month arrives first, so the first half is late."""
    events = B.table(spark, sf_dir, "events")
    path = fresh_dir(spark, "rate")
    for arrived in (events.filter(f"ts >= '{_MIDDLE}'"), events.filter(f"ts < '{_MIDDLE}'")):
        arrived.write.mode("append").parquet(f"{path}/in")
        stream = jobs.rate_limits(jobs.read_files(spark, f"{path}/in", schemas.EVENTS), "user_id", "ts", limit=1, window="1 hour")
        jobs.drain(stream, jobs.batch_log(f"{path}/log"), f"{path}/checkpoint")
    totals = jobs.rate_limit_totals(spark, f"{path}/log", stream, "user_id", limit=1)
    return totals.withColumn("window_start", moment("window_start"))


@query(
    f"""SELECT 'shop_' || CAST(user_id AS VARCHAR) AS shop_domain, {sql.moment('MAX(ts)')} AS last_seen FROM events WHERE event_type = 'signup' GROUP BY 1"""
)
def stream_liveness(spark, sf_dir):
    """Newest ping per tenant as a stream."""
    pings = _events(spark, sf_dir).filter("event_type = 'signup'").select(
        F.concat(F.lit("shop_"), F.col("user_id").cast("string")).alias("shop_domain"), F.col("ts").alias("pinged_at")
    )
    return jobs.drained_table(jobs.last_pings(pings), ["shop_domain"], "pings").withColumn("last_seen", moment("last_seen"))


@query(f"WITH {sql.SEARCHES} SELECT id, query, COALESCE(results_count, -1) AS results_count, shop_domain, {sql.moment('created_at')} AS created_at FROM searches")
def stream_event_append(spark, sf_dir):
    """Search events appended by a stream and read back."""
    events = _searches(spark, sf_dir)
    path = fresh_dir(spark, "appended")
    jobs.append_stream(events, f"{path}/table", f"{path}/checkpoint")
    back = spark.read.schema(events.schema).parquet(f"{path}/table")
    return back.select("id", "query", F.coalesce("results_count", F.lit(-1)).alias("results_count"), "shop_domain", moment("created_at").alias("created_at"))


@query(
    f"""WITH {sql.CAT}, {sql.embedded("SELECT shop_domain, product_id, concat_ws(' ', title, title, NULLIF(description, ''), 'Brand: ' || vendor) AS text FROM cat", "shop_domain, product_id")}
SELECT shop_domain, product_id, sha256(text) AS text_key, vector, id % 3 = 0 AS sent_twice, TRUE AS embedded_once
FROM vectors JOIN texts USING (shop_domain, product_id) JOIN cat USING (shop_domain, product_id)"""
)
def stream_embed_products(spark, sf_dir):
    """Products embedded as they arrive, into the catalogue: a third is sent first, then all of them."""
    fields = [*merge.PRODUCT_KEYS, "title", "description", "price", "vendor", "category", "tags", "metadata"]
    path = fresh_dir(spark, "intake")
    jobs.product_store(B.stored_catalog(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>")), path, 5000)
    # The products sent are those stored, read back from there: the descriptions are joined once.
    feed = buckets.current(spark, path).select(*fields, F.col("product_id").cast("bigint").alias("ordinal"))
    text = X.weighted_text(F.col("title"), F.col("description"), F.col("vendor"))
    write = jobs.product_intake(path, text, embedding.word_embedder(64), B.AS_OF)
    for arrived in (feed.filter("ordinal % 3 = 0"), feed):
        arrived.write.mode("append").option("compression", "zstd").parquet(f"{path}/feed")
        jobs.drain(jobs.read_files(spark, f"{path}/feed", feed.schema), write, f"{path}/checkpoint", mode="append")
    outcome = spark.read.schema("shop_domain string, product_id string, status string").parquet(f"{path}/outcome")
    times = outcome.groupBy(*merge.PRODUCT_KEYS).agg(F.count(F.lit(1)).alias("times"))
    done = buckets.current(spark, path).join(times, merge.PRODUCT_KEYS)
    return done.select(
        *merge.PRODUCT_KEYS, "text_key", millionths("embedding").alias("vector"),
        (F.col("product_id").cast("bigint") % 3 == 0).alias("sent_twice"), (F.col("times") == 1).alias("embedded_once"),
    )


@query(f"WITH {A._PERIOD} SELECT query, {A._TOP} FROM period GROUP BY query ORDER BY search_count DESC, query LIMIT 20")
def stream_top_queries(spark, sf_dir):
    """The most frequent queries of a log that grew in two deliveries, found by their summaries."""
    events = analytics.in_period(B.search_events(spark, sf_dir), B.AS_OF, A.DAYS)
    path = fresh_dir(spark, "top")
    for arrived in (events.filter("id % 2 = 0"), events.filter("id % 2 = 1")):
        arrived.write.mode("append").parquet(f"{path}/in")
        jobs.drain(jobs.read_files(spark, f"{path}/in", events.schema), jobs.query_log(path), f"{path}/checkpoint", mode="append")
    return jobs.live_top_queries(spark, path, events.schema).withColumn("last_searched", moment("last_searched"))


_CONVERSATIONS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'missing' WHEN conv_id % 2 = 1 THEN 'invalid' ELSE 'valid' END AS verdict FROM conversations"""
)
def stream_webhook_intake(spark, sf_dir):
    """Signed payloads checked as they arrive."""
    stream = _stream(spark, sf_dir, "conversations", _CONVERSATIONS)
    path = fresh_dir(spark, "webhooks")
    payloads = A.signed_bodies(stream).withColumn("topic", F.lit("conversation"))
    jobs.drain(payloads, jobs.webhook_intake(path, A.SECRET), f"{path}/checkpoint", mode="append")
    schema = T.StructType([*payloads.schema.fields, T.StructField("verdict", T.StringType())])
    return spark.read.schema(schema).parquet(f"{path}/payloads").select("conv_id", "turn", "verdict")


@query("SELECT DISTINCT 'shop_' || CAST(conv_id AS VARCHAR) AS shop_domain FROM conversations WHERE turn % 5 <> 4 AND conv_id % 2 = 0 AND role = 'user'")
def stream_erase_requests(spark, sf_dir):
    """Tenants named by valid erase payloads (those of user turns)."""
    return spark.read.schema("shop_domain string").parquet(f"{_erase_intake(spark, sf_dir)}/erase").select("shop_domain").distinct()


def _erase_intake(spark, sf_dir):
    stream = _stream(spark, sf_dir, "conversations", _CONVERSATIONS)
    path = fresh_dir(spark, "erase")
    body = F.to_json(F.struct(F.concat(F.lit("shop_"), F.col("conv_id").cast("string")).alias("shop_domain"), F.col("text").alias("note")))
    payloads = A.signed_bodies(stream.withColumn("text", body).withColumn("_role", F.col("role")), ["_role"])
    payloads = payloads.withColumn("topic", F.when(F.col("_role") == "user", "tenant/erase").otherwise("other")).drop("_role")
    jobs.drain(payloads, jobs.webhook_intake(path, A.SECRET), f"{path}/checkpoint", mode="append")
    return path


@query(
    f"""WITH {sql.CAT}, gone AS (SELECT DISTINCT 'shop_' || CAST(conv_id AS VARCHAR) AS shop_domain FROM conversations
  WHERE turn % 5 <> 4 AND conv_id % 2 = 0 AND role = 'user')
SELECT shop_domain, COUNT(*) AS products FROM cat WHERE shop_domain NOT IN (SELECT shop_domain FROM gone) GROUP BY 1"""
)
def stream_tenant_erase(spark, sf_dir):
    """Products per tenant after the erasures that arrived as payloads."""
    tables = {"products": B.catalog(spark, sf_dir, vectors=False)}
    kept = jobs.erase_arrived(spark, _erase_intake(spark, sf_dir), tables)["products"]
    return kept.groupBy("shop_domain").agg(F.count(F.lit(1)).alias("products"))
