"""Inputs that once were cut, refused, multiplied or dropped."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.operators import embedding, merge, metering, search, settings, typos
from vitrine.session import fresh_dir
from vitrine.sources import seeds
from vitrine.streaming import jobs

NOW = datetime(2024, 2, 1)


def many_products(spark, count):
    vector = F.array(F.lit(1.0), (F.col("id") % 97 / 97).cast("double")).cast("array<float>")
    return spark.range(count).select(F.col("id").cast("string").alias("product_id"), F.lit("s").alias("shop_domain"), vector.alias("embedding"))


@pytest.mark.parametrize("k", [1500, None])
def test_no_hidden_cap_on_results(spark, k):
    asked = spark.createDataFrame([("q", [1.0, 0.5])], "query_id string, qvec array<double>")
    found = search.top_k(many_products(spark, 3000).repartition(13), asked, k=k)
    assert found.count() == (k or 3000)
    assert found.agg(F.max("rank")).first()[0] == (k or 3000)


def test_a_request_is_ranked_in_parts(spark):
    asked = spark.createDataFrame([("q", [1.0, 0.5])], "query_id string, qvec array<double>")
    plan = search.top_k(many_products(spark, 100), asked, k=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") >= 2 and "hashpartitioning(query_id" in plan


def test_limits_that_are_no_numbers(spark):
    rows = [("unlimited", 5), ("many", 5), ("many", None), ("7", 0), (None, 3)]
    frame = spark.createDataFrame(rows, "c string, r int")
    found = [r[0] for r in frame.select(search.effective_limit(F.col("c"), F.col("r"))).collect()]
    assert found == [1000, 5, 10, 7, 3]
    free = frame.select(search.effective_limit(F.col("c"), F.col("r"), unlimited=None)).first()[0]
    assert free == search.NO_LIMIT


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, start=1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


@pytest.mark.parametrize("threshold", [20, 60])
def test_low_thresholds_with_any_vocabulary(spark, threshold):
    rnd = random.Random(2)
    terms = ["".join(rnd.choices("abcdef", k=rnd.randint(1, 6))) for _ in range(300)] + ["xy" * 40]
    tokens = ["".join(rnd.choices("abcdefz", k=rnd.randint(3, 7))) for _ in range(60)] + ["xy" * 35, "zzz"]
    found = typos.best_matches(
        spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string"),
        spark.createDataFrame([(t,) for t in terms], "term string"),
        threshold,
    )
    wanted = {}
    for token in set(tokens):
        scored = [(-200 * lcs(token, t) / (len(token) + len(t)), t) for t in set(terms)]
        score, best = min(scored)
        if -score >= threshold:
            wanted[token] = best
    assert {r["token"]: r["best"] for r in found.collect()} == wanted


def test_configuration_of_known_unknown_and_partial_tenants(spark):
    tenants = spark.createDataFrame([("none",), ("some",)], "shop_domain string")
    stored = spark.createDataFrame([("some:ai_search", '{"results_limit": "4"}')], "key string, value string")
    config = settings.tenant_config(stored, tenants)
    found = {r["shop_domain"]: (r["results_limit"], r["similarity_threshold"], r["exclude_archived"]) for r in config.collect()}
    assert found == {"none": ("10", 70.0, False), "some": ("4", 10.0, True)}
    asked = spark.createDataFrame([(1, "some"), (2, "other")], "query_id int, shop_domain string")
    joined = {r["query_id"]: (r["results_limit"], r["ai_search_enabled"]) for r in settings.with_config(asked, config).collect()}
    assert joined == {1: ("4", True), 2: ("10", True)}


def stored_products(spark, *ids):
    row = ("s", "old", "d", Decimal(1), "v", "c", ["t"], [1.0], "{}", datetime(2024, 1, 1), datetime(2024, 1, 1))
    return spark.createDataFrame([(i, *row) for i in ids], schemas.PRODUCT_EMBEDDINGS)


def test_repeated_keys_never_multiply_rows(spark):
    fields = "shop_domain string, product_id string, title string, description string, price decimal(10,2), vendor string, category string, tags array<string>, metadata string, embedding array<float>, ordinal int"
    sent = [("s", pid, title, "d", Decimal(2), "v", "c", [], "{}", [2.0], i) for i, (pid, title) in enumerate([("1", "a"), ("9", "x"), ("1", "b"), ("9", "y")])]
    merged = merge.upsert_products(stored_products(spark, "1", "2"), spark.createDataFrame(sent, fields), NOW)
    assert sorted((r["product_id"], r["title"]) for r in merged.collect()) == [("1", "b"), ("2", "old"), ("9", "y")]
    vectors = spark.createDataFrame([("s", "1", [3.0]), ("s", "1", [4.0]), ("s", "7", [1.0]), ("s", "7", [2.0])], "shop_domain string, product_id string, embedding array<float>")
    snapshot, unknown = merge.write_back_embeddings(stored_products(spark, "1", "2"), vectors, NOW)
    assert sorted((r["product_id"], r["embedding"]) for r in snapshot.collect()) == [("1", [4.0]), ("2", [1.0])]
    assert unknown.count() == 1


def test_new_plans_get_ids(spark):
    sent = [("gold", Decimal(5), 1, 1), ("gold", Decimal(6), 1, 1), ("bronze", Decimal(2), 1, 1), ("launch", Decimal(8), 9, 9)]
    incoming = spark.createDataFrame(sent, "name string, price decimal(10,2), max_products int, max_searches_per_month int")
    plans = {r["name"]: (r["id"], r["price"]) for r in merge.upsert_plans(seeds.plans(spark), incoming).collect()}
    assert len(plans) == 7 and plans["bronze"][0] == 6 and plans["gold"] == (7, Decimal(6)) and plans["launch"] == (2, Decimal(8))


def test_repeated_cache_keys_return_one_row(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x")], "id int, text string")
    entries = spark.createDataFrame([("x", 5.0, datetime(2024, 1, 30)), ("x", 6.0, datetime(2024, 1, 31))], "text string, v double, cached_at timestamp_ntz")
    cache = embedding.keyed(entries, "text").select("cache_key", F.array(F.col("v").cast("float")).alias("embedding"), "cached_at")
    found, added = embedding.embed_through_cache(rows, "text", cache, embedding.hashing_embedder(4), NOW, spread=["id"])
    assert sorted((r["id"], r["embedding"]) for r in found.collect()) == [(1, [6.0]), (2, [6.0])]
    assert added.count() == 0


def test_tenants_without_a_subscription_have_starter_limits(spark):
    subs = spark.createDataFrame([("a", 2, "active", 0, date(2024, 1, 20), None, None)], schemas.USER_SUBSCRIPTIONS)
    usage = spark.createDataFrame([("b", "search", date(2024, 2, 1), 300), ("c", "search", date(2024, 1, 1), 900)], schemas.USAGE_TRACKING)
    tenants = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "shop_domain string")
    limits = metering.plan_limits(subs, seeds.plans(spark), stored_products(spark, "1"), usage, as_of=date(2024, 2, 1), tenants=tenants)
    found = {r["shop"]: (r["plan"], r["current_searches"], r["searches_exceeded"]) for r in limits.collect()}
    assert found == {"a": ("launch", 0, False), "b": ("starter", 300, True), "c": ("starter", 0, False)}


def test_late_events_are_counted(spark):
    path = fresh_dir(spark, "late")
    keys = ["shop_domain", "usage_type", "usage_date"]
    for day in (40, 1, 2):
        event = [(day, "q", 1, None, "x", "s", datetime(2024, 1 + day // 32, 1 + day % 28))]
        spark.createDataFrame(event, schemas.SEARCH_ANALYTICS).write.mode("append").parquet(f"{path}/in")
        stream = jobs.usage_counters(jobs.read_files(spark, f"{path}/in", schemas.SEARCH_ANALYTICS))
        jobs.drain(stream, jobs.batch_log(f"{path}/log"), f"{path}/checkpoint")
    found = jobs.latest_rows(spark, f"{path}/log", stream.schema, keys)
    batch = metering.usage_from_events(spark.read.schema(schemas.SEARCH_ANALYTICS).parquet(f"{path}/in"))
    columns = [*keys, "usage_count"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
