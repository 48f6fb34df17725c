"""Structured Streaming forms of the request-at-a-time updates.

Each job is a streaming DataFrame plus a sink that is safe to replay: a
micro-batch writes under its own batch id and a repeated one overwrites
itself. No event is dropped: metering and statistics have no watermark unless
one is given, and the rate limiter counts late requests apart.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import numeric as N
from vitrine.functions import sizing
from vitrine.operators import analytics, buckets, heavy, merge, purge, webhooks
from vitrine.operators.embedding import Embedder, embed_rows
from vitrine.session import cut_lineage, fresh_dir
from vitrine.streaming import limiter

WATERMARK = "1 day"
_STORE = "spark.sql.streaming.stateStore.providerClass"
Write = Callable[[DataFrame, int], None]


def read_files(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder (or a glob) as a stream, ``max_files`` per trigger."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


# ------------------------------------------------------------- streaming plans


def _event_time(rows: DataFrame, column: str, watermark: str | None) -> DataFrame:
    """Watermarks need a zoned timestamp; the zone is the session's both ways. Without
    a watermark no event is ever too late, and the state keeps every window."""
    zoned = rows.withColumn(column, F.col(column).cast("timestamp"))
    return zoned if watermark is None else zoned.withWatermark(column, watermark)


def usage_counters(events: DataFrame, usage_type: str = "search", watermark: str | None = None) -> DataFrame:
    """Running daily usage per tenant; the state holds one row per tenant and day, and
    late events count as long as no ``watermark`` is given."""
    windowed = _event_time(events, "created_at", watermark).groupBy(
        "shop_domain", F.window("created_at", "1 day").alias("w")
    )
    return windowed.agg(F.count(F.lit(1)).alias("usage_count")).select(
        "shop_domain", F.lit(usage_type).alias("usage_type"), F.to_date("w.start").alias("usage_date"), "usage_count"
    )


def daily_stats(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Running search statistics per day; one row of state per day, late events
    included unless a ``watermark`` is given."""
    windowed = _event_time(events, "created_at", watermark).groupBy(F.window("created_at", "1 day").alias("w"))
    return windowed.agg(
        F.count(F.lit(1)).alias("total_searches"),
        F.count_if(F.col("results_count") > 0).alias("searches_with_results"),
        F.count_if(F.col("results_count") == 0).alias("searches_no_results"),
        N.rounded_average(F.col("results_count")).alias("avg_results"),
    ).select(
        F.to_date("w.start").alias("date"),
        "total_searches",
        "searches_with_results",
        "searches_no_results",
        "avg_results",
    )


def rate_limits(
    requests: DataFrame, client: str, moment: str, limit: int = 100, window: str = "60 seconds", watermark: str | None = WATERMARK
) -> DataFrame:
    """Requests per client and fixed window, flagged beyond the limit. A window closes when
    the watermark passes its end; requests for a closed window go to ``late`` instead.
    ``rate_limit_totals`` adds both up. Needs the RocksDB state store (see ``drain``)."""
    width = requests.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {window})").first()[0]
    counted = limiter.windows(requests, client, moment, width, watermark)
    return counted.withColumn("limited", F.col("requests") > limit)


def rate_limit_totals(spark: SparkSession, log: str, stream: DataFrame, client: str, limit: int = 100) -> DataFrame:
    """Every request that a drained ``rate_limits`` stream has logged, late ones included:
    per client and window ``accepted``, ``late``, ``requests`` and ``limited``."""
    return limiter.totals(spark.read.schema(stream.schema).parquet(log), client, limit)


def last_pings(pings: DataFrame) -> DataFrame:
    """Newest ping per tenant; the state holds one row per tenant."""
    return pings.groupBy("shop_domain").agg(F.max("pinged_at").alias("last_seen"))


# ---------------------------------------------------------------------- sinks


def batch_log(path: str) -> Write:
    """Sink that keeps each micro-batch's rows under its batch id."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_rows(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Newest version of each key in a batch log."""
    logged = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    others = [c for c in schema.names if c not in keys]
    newest = logged.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def drain(stream: DataFrame, write: Write, checkpoint: str, mode: str = "update") -> None:
    """Process what is available now and stop; a later call continues there.

    The state lies in RocksDB, on the executors' disks, as it may outgrow their memory
    and as timers need it; the setting is put back once the query has started."""
    conf = stream.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, limiter.ROCKSDB)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(_STORE, before)
    query.awaitTermination()


def drained_table(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Drain an updating stream into a batch log and read its final state."""
    spark = stream.sparkSession
    path = fresh_dir(spark, label)
    drain(stream, batch_log(f"{path}/log"), f"{path}/checkpoint")
    return latest_rows(spark, f"{path}/log", stream.schema, keys)


def append_stream(events: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream of search events to a table, exactly once per file."""
    query = (
        events.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# ---------------------------------------------------- jobs with their own sinks


def embed_new_products(table_path: str, text: str, embedder: Embedder) -> Write:
    """Micro-batch writer: embed products whose key and text are not stored yet.

    Rows: product keys plus the text column. The table keeps one log entry per
    batch id; the newest entry of a product wins on reading. A product sent
    again with the same text is not embedded again. Of rows of one product in a batch
    the one of greatest ``ordinal`` counts, or, without such a column, of greatest text.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        order = F.col("ordinal") if "ordinal" in rows.columns else F.struct(text)
        last = merge.keep_last(rows.select(*merge.PRODUCT_KEYS, text, order.alias("ordinal")), merge.PRODUCT_KEYS)
        keyed = last.select(*merge.PRODUCT_KEYS, text, F.sha2(text, 256).alias("text_key"))
        stored = _stored_before(spark, table_path, batch_id, keyed.select(*merge.PRODUCT_KEYS))
        todo = keyed if stored is None else keyed.join(stored, [*merge.PRODUCT_KEYS, "text_key"], "left_anti")
        embedded = embed_rows(todo, text, embedder)
        embedded.drop(text).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return write


_EMBEDDED = T.StructType(
    [
        T.StructField("shop_domain", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("text_key", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def _stored_before(spark: SparkSession, path: str, batch_id: int, wanted: DataFrame) -> DataFrame | None:
    """What earlier batches embedded of the wanted products: the newest entry of each, if
    it went well. Earlier entries of other products are only scanned, by key."""
    if batch_id == 0:
        return None
    schema = T.StructType([*_EMBEDDED.fields, T.StructField("batch", T.LongType())])
    earlier = spark.read.schema(schema).parquet(path).filter(F.col("batch") < batch_id)
    earlier = earlier.join(sizing.small_side(wanted), merge.PRODUCT_KEYS, "left_semi")
    newest = earlier.groupBy(*merge.PRODUCT_KEYS).agg(F.max_by(F.struct("text_key", "status"), "batch").alias("_last"))
    done = newest.filter(F.col("_last.status") == "ok")
    return done.select(*merge.PRODUCT_KEYS, F.col("_last.text_key").alias("text_key"))


def embedded_products(spark: SparkSession, path: str) -> DataFrame:
    return latest_rows(spark, path, _EMBEDDED, merge.PRODUCT_KEYS)


def product_store(catalog: DataFrame, path: str, rows_per_bucket: int = buckets.ROWS_PER_BUCKET) -> None:
    """A catalogue in key buckets that also keeps what each vector was made from (``text_key``)."""
    buckets.create(catalog.withColumn("text_key", F.lit(None).cast("string")), path, rows_per_bucket)


def product_intake(path: str, text: Column, embedder: Embedder, as_of: datetime) -> Write:
    """Micro-batch writer: products go into the catalogue at ``path``, and get a vector if their
    text is not the one that their stored vector was made from.

    Rows are product fields and an ``ordinal`` of the source, the greatest of which counts per
    product. Only the buckets that a batch falls into are read and rewritten; their
    ``text_key`` is the state. A batch that is repeated finds its own texts and embeds none.
    A product whose embedding fails keeps its old vector, and is tried again when next sent;
    outcomes lie under the batch id. Bound a batch by the source's ``max_files``.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        last = merge.keep_last(rows, merge.PRODUCT_KEYS)
        keyed = last.withColumn("_key", F.sha2(text, 256))

        def change(stored: DataFrame, batch: DataFrame) -> DataFrame:
            known = stored.filter("embedding IS NOT NULL").select(*merge.PRODUCT_KEYS, F.col("text_key").alias("_key"))
            # Keys and hashes meet first; the texts only if very many products are as they were.
            same, few = sizing.settle(batch.select(*merge.PRODUCT_KEYS, "_key").join(known, [*merge.PRODUCT_KEYS, "_key"], "left_semi"))
            todo = batch.join(F.broadcast(same) if few else same, [*merge.PRODUCT_KEYS, "_key"], "left_anti")
            texts = todo.select(*merge.PRODUCT_KEYS, text.alias("_text"), "_key")
            embedded = cut_lineage(embed_rows(texts, "_text", embedder).drop("_text"))
            outcome = embedded.select(*merge.PRODUCT_KEYS, F.col("_key").alias("text_key"), "status", "error")
            outcome.write.mode("overwrite").parquet(f"{path}/outcome/batch={batch_id}")
            vectors = embedded.filter("status = 'ok'").select(*merge.PRODUCT_KEYS, "embedding", F.col("_key").alias("text_key"))
            return merge.upsert_info_and_vectors(stored, batch.drop("_key"), vectors, as_of)

        buckets.apply(rows.sparkSession, path, keyed, change)

    return write


def query_log(path: str, item: str = "query") -> Write:
    """Micro-batch writer: the batch's events, and a summary of their most frequent items."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
        back = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/events/batch={batch_id}")
        heavy.summarise(back, item).write.mode("overwrite").parquet(f"{path}/summaries/batch={batch_id}")

    return write


def live_top_queries(spark: SparkSession, path: str, schema: T.StructType, limit: int = 20) -> DataFrame:
    """``analytics.top_queries`` over a ``query_log``: only queries that the summaries show to be
    frequent are counted."""
    events = spark.read.schema(schema).parquet(f"{path}/events")
    states = spark.read.parquet(f"{path}/summaries")
    return analytics.top_queries(heavy.top(events, states, "query", limit), limit)


def webhook_intake(path: str, secret: str) -> Write:
    """Micro-batch writer: verdict per payload, and the tenants to erase.

    Payload rows: ``body, signature, topic`` and any keys. Both outputs are
    written under the batch id.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        verified = webhooks.verify(rows, secret)
        verified.write.mode("overwrite").parquet(f"{path}/payloads/batch={batch_id}")
        erased = webhooks.erase_requests(verified)
        erased.write.mode("overwrite").parquet(f"{path}/erase/batch={batch_id}")

    return write


def erase_arrived(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the rows of all tenants that intake batches at ``path`` asked to erase."""
    return purge.erase_tenants(tables, spark.read.schema("shop_domain string").parquet(f"{path}/erase"))
