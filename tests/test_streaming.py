"""Streams: several files and triggers, restarts and replays, against the batch answer."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import schemas
from vitrine.functions import signing
from vitrine.operators import analytics, metering
from vitrine.session import fresh_dir
from vitrine.streaming import jobs


@pytest.fixture(scope="module")
def event_files(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, f"q{i % 5}", [3, 0, None][i % 3], None, "x", "hot" if i % 3 else f"s{i % 4}", start + timedelta(hours=i)) for i in range(240)]
    path = fresh_dir(spark, "stream-in")
    spark.createDataFrame(rows, schemas.SEARCH_ANALYTICS).repartitionByRange(4, "created_at").write.parquet(path)
    return path


def as_set(frame):
    return {tuple(r) for r in frame.collect()}


def test_usage_stream_equals_batch(spark, event_files):
    stream = jobs.usage_counters(jobs.read_files(spark, event_files, schemas.SEARCH_ANALYTICS, max_files=1), watermark="30 days")
    keys = ["shop_domain", "usage_type", "usage_date"]
    drained = jobs.drained_table(stream, keys, "usage-test")
    batch = metering.usage_from_events(spark.read.schema(schemas.SEARCH_ANALYTICS).parquet(event_files))
    columns = [*keys, "usage_count"]
    assert as_set(drained.select(*columns)) == as_set(batch.select(*columns))


def test_daily_stream_equals_batch(spark, event_files):
    stream = jobs.daily_stats(jobs.read_files(spark, event_files, schemas.SEARCH_ANALYTICS, max_files=2), watermark="30 days")
    drained = jobs.drained_table(stream, ["date"], "daily-test")
    batch = analytics.daily_stats(spark.read.schema(schemas.SEARCH_ANALYTICS).parquet(event_files))
    assert as_set(drained.select(*batch.columns)) == as_set(batch)


def test_restart_continues_without_double_counting(spark):
    path = fresh_dir(spark, "restart")
    one = spark.createDataFrame([(1, "q", 1, None, "x", "s", datetime(2024, 1, 1))], schemas.SEARCH_ANALYTICS)
    keys = ["shop_domain", "usage_type", "usage_date"]
    for wanted in (1, 2, 2):
        if wanted == 1 or jobs_count == 1:
            one.write.mode("append").parquet(f"{path}/in")
        stream = jobs.usage_counters(jobs.read_files(spark, f"{path}/in", schemas.SEARCH_ANALYTICS))
        jobs.drain(stream, jobs.batch_log(f"{path}/log"), f"{path}/checkpoint")
        jobs_count = jobs.latest_rows(spark, f"{path}/log", stream.schema, keys).first()["usage_count"]
        assert jobs_count == wanted


def test_replayed_batch_overwrites_itself(spark):
    path = fresh_dir(spark, "replay")
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    write = jobs.batch_log(path)
    write(rows, 0)
    write(rows, 0)
    assert spark.read.schema("k string, n int").parquet(path).count() == 1


def test_rate_limit_flags(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(seconds=i // 4)) for i in range(101)] + [("b", start + timedelta(seconds=i)) for i in range(100)]
    schema = T.StructType([T.StructField("client", T.StringType()), T.StructField("at", T.TimestampNTZType())])
    path = fresh_dir(spark, "rate-in")
    spark.createDataFrame(rows, schema).write.parquet(path)
    stream = jobs.rate_limits(jobs.read_files(spark, path, schema), "client", "at")
    drained = jobs.drained_table(stream, ["client", "window_start"], "rate-test")
    assert {(r["client"], r["requests"], r["limited"]) for r in drained.collect()} == {("a", 101, True), ("b", 60, False), ("b", 40, False)}


def test_late_requests_are_counted_apart(spark):
    """Three deliveries with restarts: windows close, late requests go to ``late``, nothing is lost."""
    start = datetime(2024, 1, 1)
    deliveries = [
        [("a", start), ("a", start + timedelta(seconds=59)), ("b", start + timedelta(days=3)), (None, start), ("c", None)],
        [("a", start + timedelta(seconds=5)), ("b", start + timedelta(days=3, seconds=30)), ("b", start + timedelta(days=2, hours=1))],
        [("a", start + timedelta(seconds=61)), ("b", start + timedelta(days=3, seconds=59)), ("c", start)],
    ]
    schema = T.StructType([T.StructField("client", T.StringType()), T.StructField("at", T.TimestampNTZType())])
    path = fresh_dir(spark, "late")
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = jobs.rate_limits(jobs.read_files(spark, f"{path}/in", schema), "client", "at", limit=2)
        jobs.drain(stream, jobs.batch_log(f"{path}/log"), f"{path}/checkpoint")
    got = jobs.rate_limit_totals(spark, f"{path}/log", stream, "client", limit=2)
    moment = F.date_format("window_start", "dd HH:mm")
    assert as_set(got.select("client", moment, "accepted", "late", "requests", "limited")) == {
        ("a", "01 00:00", 2, 1, 3, True),
        ("a", "01 00:01", 0, 1, 1, False),
        ("b", "04 00:00", 3, 0, 3, True),
        ("b", "03 01:00", 1, 0, 1, False),
        ("c", "01 00:00", 0, 1, 1, False),
    }
    closed = spark.read.schema(stream.schema).parquet(f"{path}/log").filter("closed AND late = 0")
    assert as_set(closed.select("client", moment, "requests")) == {("a", "01 00:00", 2)}


def test_no_watermark_counts_everything_as_accepted(spark):
    start = datetime(2024, 1, 1)
    schema = T.StructType([T.StructField("client", T.LongType()), T.StructField("at", T.TimestampNTZType())])
    path = fresh_dir(spark, "unclosed")
    for days in (9, 0):
        spark.createDataFrame([(7, start + timedelta(days=d)) for d in (days, 0)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.rate_limits(jobs.read_files(spark, path, schema, max_files=1), "client", "at", watermark=None)
    drained = jobs.drained_table(stream, ["client", "window_start"], "unclosed-test")
    assert {(r["window_start"].day, r["requests"]) for r in drained.collect()} == {(1, 3), (10, 1)}


def test_new_and_changed_products_are_embedded_once(spark):
    path = fresh_dir(spark, "embed-stream")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("shop_domain", "product_id", "text")])

    def embed(texts):
        if any("boom" in t for t in texts):
            raise ValueError("boom")
        return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    def send(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = jobs.read_files(spark, f"{path}/in", schema)
        jobs.drain(stream, jobs.embed_new_products(f"{path}/table", "text", embed), f"{path}/checkpoint", mode="append")

    def written():
        return spark.read.schema(jobs._EMBEDDED).parquet(f"{path}/table").count()

    send(("s", "1", "aa"), ("s", "2", "boom"))
    assert written() == 2
    send(("s", "1", "aa"), ("s", "2", "fine"), ("s", "3", "cccc"))
    assert written() == 4
    send(("s", "1", "aaa"))
    found = {r["product_id"]: (r["status"], r["embedding"]) for r in jobs.embedded_products(spark, f"{path}/table").collect()}
    assert found == {"1": ("ok", [3.0, 1.0]), "2": ("ok", [4.0, 1.0]), "3": ("ok", [4.0, 1.0])}


def test_webhook_intake(spark):
    path = fresh_dir(spark, "hooks")
    bodies = spark.createDataFrame([('{"shop_domain":"a"}', "tenant/erase"), ('{"shop_domain":"b"}', "tenant/erase"), ('{"shop_domain":"c"}', "other")], "body string, topic string")
    signed = bodies.withColumn("signature", F.when(F.col("body").contains('"b"'), "forged").otherwise(signing.signature("k", F.col("body"))))
    write = jobs.webhook_intake(path, "k")
    write(signed, 0)
    write(signed, 0)
    erased = spark.read.schema("shop_domain string").parquet(f"{path}/erase").select("shop_domain")
    assert as_set(erased) == {("a",)}


def test_intake_embeds_changed_texts_into_the_catalogue(spark):
    """Two products of one delivery, replays, a failure tried again, and buckets left alone."""
    from decimal import Decimal

    from vitrine.operators import buckets

    path = fresh_dir(spark, "intake-test")
    names = schemas.PRODUCT_EMBEDDINGS.names
    base = spark.range(400).selectExpr("concat('s', id % 4) AS shop_domain", "lpad(cast(id as string), 4, '0') AS product_id")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.PRODUCT_EMBEDDINGS.fields if f.name not in base.columns]
    jobs.product_store(base.select("*", *rest).select(*names), path, rows_per_bucket=20)
    schema = "shop_domain string, product_id string, title string, description string, price decimal(10,2), vendor string, category string, tags array<string>, metadata string, ordinal bigint"
    calls = []

    def embed(texts):
        if any("boom" in t for t in texts):
            raise ValueError("boom")
        return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    write = jobs.product_intake(path, F.col("title"), embed, datetime(2024, 5, 1))

    def send(batch, *rows):
        frame = spark.createDataFrame([(s, p, t, None, Decimal(1), "v", "c", [], None, o) for s, p, t, o in rows], schema)
        write(frame, batch)
        calls.append(frame)

    def stored():
        rows = buckets.current(spark, path).filter("title IS NOT NULL").collect()
        return {r["product_id"]: (r["title"], r["embedding"]) for r in rows}

    def outcomes(batch):
        return {(r["product_id"], r["status"]) for r in spark.read.parquet(f"{path}/outcome/batch={batch}").collect()}

    send(0, ("s1", "0001", "older", 1), ("s1", "0001", "aaa", 2), ("s2", "0002", "boom", 1), ("s1", "new", "bb", 1))
    assert stored() == {"0001": ("aaa", [3.0, 1.0]), "0002": ("boom", None), "new": ("bb", [2.0, 1.0])}
    assert outcomes(0) == {("0001", "ok"), ("0002", "error"), ("new", "ok")}
    commits = {e["bucket"]: e["commit"] for e in buckets._files(spark, path)}
    assert len(set(commits.values())) == 2 and len(commits) == 20
    write(calls[0], 0)  # a replay embeds nothing but the failure
    assert outcomes(0) == {("0002", "error")}
    send(1, ("s1", "0001", "aaa", 3), ("s2", "0002", "fine", 2), ("s1", "new", "cccc", 2))
    assert outcomes(1) == {("0002", "ok"), ("new", "ok")}
    assert stored() == {"0001": ("aaa", [3.0, 1.0]), "0002": ("fine", [4.0, 1.0]), "new": ("cccc", [4.0, 1.0])}
    assert buckets.current(spark, path).count() == 401


@pytest.mark.parametrize(("kinds", "all_read"), [(40, False), (5000, True)])
def test_live_top_queries_equal_the_batch(spark, kinds, all_read):
    """Frequent queries come from summaries; where none is frequent, all are counted."""
    from vitrine.operators import heavy

    start = datetime(2024, 1, 1)
    if all_read:
        rows = [(i, f"q{i % kinds}") for i in range(2 * kinds)] + [(1_000_000, "q77")]
    else:
        rows = [(i, f"q{int(i ** 0.5) % kinds}") for i in range(4000)] + [(100_000 + i, f"rare{i}") for i in range(800)]
    full = [(i, q, i % 3, None, "x", "s", start + timedelta(seconds=i % 1000)) for i, q in rows]
    events = spark.createDataFrame(full, schemas.SEARCH_ANALYTICS)
    path = fresh_dir(spark, "top-test")
    write = jobs.query_log(path)
    for batch, part in enumerate((events.filter("id % 2 = 0"), events.filter("id % 2 = 1"))):
        write(part, batch)
        write(part, batch)
    live = jobs.live_top_queries(spark, path, events.schema, 10)
    assert as_set(live) == as_set(analytics.top_queries(events, 10))
    read = heavy.top(events, spark.read.parquet(f"{path}/summaries"), "query", 10).count()
    assert (read == events.count()) == all_read


def test_word_embedder_matches_its_definition():
    import hashlib

    from vitrine.operators import embedding

    texts = ["Red shoe red", "  É 東京 shoe\t", "", "   ", "x"]
    found = embedding.word_embedder(16)(texts)
    for text, vector in zip(texts, found, strict=True):
        wanted = np.zeros(16)
        for word in text.lower().split():
            number = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
            wanted[number % 16] += 1 if number >> 31 else -1
        if not wanted.any():
            wanted[int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big") % 16] = 1
        assert np.array_equal(vector, (wanted / np.linalg.norm(wanted)).astype(np.float32))
