"""Merges, deletes, comparison, metering, analytics and embedding on small fixtures."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.functions import skew
from vitrine.operators import analytics, coverage, diff, embedding, merge, metering, purge
from vitrine.session import fresh_dir
from vitrine.sources import catalog as C
from vitrine.sources import seeds

OLD, NOW = datetime(2024, 1, 1), datetime(2024, 2, 1)


def product(pid, title="A", description="d", price=1, embedding=(1.0, 2.0), metadata="{}", shop="s"):
    money = None if price is None else Decimal(price)
    vector = None if embedding is None else list(embedding)
    return (pid, shop, title, description, money, "v", "c", ["t"], vector, metadata, OLD, OLD)


def catalog_of(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PRODUCT_EMBEDDINGS)


INCOMING = "shop_domain string, product_id string, title string, description string, price decimal(10,2), vendor string, category string, tags array<string>, metadata string, ordinal long"


def incoming_of(spark, *rows):
    shaped = [("s", pid, title, desc, None if price is None else Decimal(price), "w", "c", None, meta, i) for i, (pid, title, desc, price, meta) in enumerate(rows)]
    return spark.createDataFrame(shaped, INCOMING)


# ------------------------------------------------------------------ merges


def test_full_upsert_clears_the_vector(spark):
    stored = catalog_of(spark, product("1"), product("2"))
    incoming = incoming_of(spark, ("1", "B", None, 5, None), ("3", "N", "n", 1, '{"x":1}')).withColumn("embedding", F.lit(None).cast("array<float>"))
    found = {r["product_id"]: r for r in merge.upsert_products(stored, incoming, NOW).collect()}
    assert set(found) == {"1", "2", "3"}
    assert found["1"]["embedding"] is None and found["1"]["title"] == "B" and found["1"]["tags"] == [] and found["1"]["metadata"] == "{}"
    assert (found["1"]["created_at"], found["1"]["updated_at"]) == (OLD, NOW)
    assert found["2"]["embedding"] == [1.0, 2.0] and found["2"]["updated_at"] == OLD
    assert found["3"]["created_at"] == NOW


def test_info_upsert_keeps_vectors_and_is_idempotent(spark):
    stored = catalog_of(spark, product("1", metadata='{"in_stock":true}'), product("1", shop="other"))
    incoming = incoming_of(spark, ("1", "B", "x", 5, None), ("9", "N", "n", 1, None))
    once = merge.upsert_product_info(stored, incoming, NOW)
    twice = merge.upsert_product_info(once, incoming, NOW)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    found = {(r["shop_domain"], r["product_id"]): r for r in once.collect()}
    assert found["s", "1"]["embedding"] == [1.0, 2.0] and found["s", "1"]["metadata"] == "{}"
    assert found["other", "1"]["title"] == "A"
    assert found["s", "9"]["embedding"] is None


def test_write_back(spark):
    stored = catalog_of(spark, product("1", embedding=None, metadata='{"needs_resync":true,"k":"v"}'), product("2", metadata=None))
    vectors = spark.createDataFrame([("s", "1", [3.0, 4.0]), ("s", "x", [0.0, 1.0])], "shop_domain string, product_id string, embedding array<float>")
    snapshot, unknown = merge.write_back_embeddings(stored, vectors, NOW)
    found = {r["product_id"]: r for r in snapshot.collect()}
    assert found["1"]["embedding"] == [3.0, 4.0] and json.loads(found["1"]["metadata"]) == {"k": "v", "needs_resync": False}
    assert found["2"]["metadata"] is None
    assert [r["product_id"] for r in unknown.collect()] == ["x"]
    removed, _ = merge.write_back_embeddings(stored, vectors, NOW, clear="remove")
    assert json.loads({r["product_id"]: r for r in removed.collect()}["1"]["metadata"]) == {"k": "v"}


def test_keep_last(spark):
    rows = spark.createDataFrame([("a", i, None if i == 9 else i) for i in range(10)] + [("b", 3, 3)], "k string, ordinal int, v int")
    assert sorted(tuple(r) for r in merge.keep_last(rows, ["k"]).select("k", "ordinal", "v").collect()) == [("a", 9, None), ("b", 3, 3)]


def test_plans(spark):
    stored = seeds.plans(spark, [("free", "0.00", 1, 1)])
    incoming = spark.createDataFrame([("launch", Decimal("10.00"), 1, 2), ("fresh", Decimal("1.00"), 3, 4)], "name string, price decimal(10,2), max_products int, max_searches_per_month int")
    found = {r["name"]: r for r in merge.upsert_plans(stored, incoming).collect()}
    assert found["launch"]["price"] == Decimal("10.00") and found["launch"]["id"] == 2
    assert found["fresh"]["active"] is True and json.loads(found["fresh"]["features"])["ai_search"] is True
    shown = merge.active_plans(merge.deactivate_plans(stored, ["free"]))
    assert [r["name"] for r in shown.collect()] == [name for name, *_ in seeds.PLAN_ROWS]


def test_upgrade(spark):
    subs = spark.createDataFrame([("a", 1, "active", 5, OLD.date(), None, None)], schemas.USER_SUBSCRIPTIONS)
    asked = spark.createDataFrame([("a", "growth", 1), ("a", "scale", 2), ("a", "nope", 3), ("b", "launch", 4)], "shop_domain string, plan_name string, ordinal int")
    merged, errors = merge.upgrade_subscriptions(subs, asked, seeds.plans(spark), date(2024, 2, 1))
    found = {r["shop_domain"]: r for r in merged.collect()}
    assert found["a"]["plan_id"] == 4 and found["a"]["searches_this_month"] == 5 and found["a"]["billing_cycle_end"] == date(2024, 3, 2)
    assert found["b"]["plan_id"] == 2
    assert [r["plan_name"] for r in errors.collect()] == ["nope"]


def test_snapshot_write_and_tenant_overwrite(spark):
    path = fresh_dir(spark, "test-snapshot")
    merge.write_snapshot(catalog_of(spark, product("1"), product("2", shop="t")), path)
    merge.replace_tenants(catalog_of(spark, product("7", shop="t")), path)
    found = C.read_catalog(spark, path, ["shop_domain", "product_id"]).collect()
    assert sorted(map(tuple, found)) == [("s", "1"), ("t", "7")]


def test_products_without_vectors_are_not_embedded(spark):
    bare = catalog_of(spark, product("1"), product("2", shop="t")).withColumn("embedding", F.lit(None).cast("array<float>"))
    assert tuple(coverage.index_coverage(bare).first()) == (2, 0, 2)


# ------------------------------------------------------------------ deletes


def test_erase(spark):
    usage = spark.createDataFrame([("shop_1", 1), ("shop_1", 2), ("shop_12", 3)], "shop_domain string, n int")
    keys = ["shop_1", "shop_1:x", "shop_1_y", "shop_12", "shop_12:x", "other"]
    config = spark.createDataFrame([(k, "{}") for k in keys], "key string, value string")
    gone = spark.createDataFrame([("shop_1",), ("shop",)], "shop_domain string")
    counts = {r["shop_domain"]: (r["usage"], r["settings"]) for r in purge.erased_counts({"usage": usage, "settings": config}, gone).collect()}
    # Tenant "shop" owns every key that starts with its name and an underscore.
    assert counts == {"shop_1": (2, 3), "shop": (0, 5)}
    only = spark.createDataFrame([("shop_1",)], "shop_domain string")
    kept = purge.erase_tenants({"usage": usage, "settings": config}, only)
    assert [r["shop_domain"] for r in kept["usage"].collect()] == ["shop_12"]
    assert sorted(r["key"] for r in kept["settings"].collect()) == ["other", "shop_12", "shop_12:x"]


def test_small_deletes(spark):
    rows = spark.createDataFrame([("a", '{"test":true}'), (None, "{}"), ("b", "broken")], "shop_domain string, metadata string")
    assert purge.drop_orphans(rows).count() == 2
    assert purge.drop_flagged(rows).count() == 2
    config = spark.createDataFrame([("k", "1"), ("l", "2")], "key string, value string")
    assert [r["key"] for r in purge.reset_setting(config, "k").collect()] == ["l"]


def test_retention_touches_due_tenants_only(spark):
    usage = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 1, 2)), ("b", date(2024, 1, 1))], "shop_domain string, usage_date date")
    due = spark.createDataFrame([("a",)], "shop_domain string")
    kept = purge.retain_usage(usage, due, date(2024, 4, 1))
    assert sorted(map(tuple, kept.select("shop_domain", "usage_date").collect())) == [("a", date(2024, 1, 2)), ("b", date(2024, 1, 1))]


# ------------------------------------------------------------------ comparison


def test_compare_golden(spark):
    stored = catalog_of(spark, product("same"), product("price"), product("null", description=None, price=None))
    rows = incoming_of(spark, ("new", "A", "d", 1, None), ("same", "A", "d", 1, None), ("price", "A", "d", 2, None), ("null", "A", None, None, None))
    found = {r["product_id"]: r for r in diff.compare(rows, stored).collect()}
    assert {k: r["change_class"] for k, r in found.items()} == {"new": "new", "same": "unchanged", "price": "updated", "null": "updated"}
    assert found["price"]["price_changed"] and not found["price"]["title_changed"]
    assert found["null"]["description_changed"] and not found["null"]["price_changed"]


def test_apply_snapshot_flags_and_last_wins(spark):
    stored = catalog_of(spark, product("1"))
    rows = incoming_of(spark, ("1", "B", "d", 1, '{"handle":"h"}'), ("1", "A", "d", 1, '{"handle":"i"}'))
    assert diff.change_report(diff.compare(rows, stored)).count() == 1
    merged = diff.apply_snapshot(rows, stored, NOW).collect()
    assert len(merged) == 1 and json.loads(merged[0]["metadata"]) == {"handle": "i", "needs_resync": False}
    assert merged[0]["embedding"] == [1.0, 2.0]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how):
    left = spark.range(2000).select((F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)).alias("k"), F.col("id").alias("n"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    salted = skew.join(left, right, ["k"], how, spread=["n"], hot_rows=100)
    plain = left.join(right, ["k"], how)
    assert sorted(map(tuple, salted.select("k", "n", "v").collect()), key=str) == sorted(map(tuple, plain.select("k", "n", "v").collect()), key=str)


# ------------------------------------------------------------------ metering


def limits_of(spark, plan, products, searches):
    plans = seeds.plans(spark)
    number = [n for n, *_ in seeds.PLAN_ROWS].index(plan) + 1
    subs = spark.createDataFrame([("s", number, "active", 0, date(2024, 1, 10), None, None)], schemas.USER_SUBSCRIPTIONS)
    rows = spark.range(products).select(F.lit("s").alias("shop_domain"))
    usage = spark.createDataFrame([("s", "search", date(2024, 1, 9), 999), ("s", "search", date(2024, 1, 10), searches), ("s", "sync", date(2024, 1, 11), 9)], schemas.USAGE_TRACKING)
    row = metering.plan_limits(subs, plans, rows, usage, as_of=date(2024, 2, 8)).first()
    return row["products_exceeded"], row["searches_exceeded"], row["upgrade_required"]


@pytest.mark.parametrize(
    "plan, products, searches, wanted",
    [
        ("starter", 50, 299, (False, False, False)),
        ("starter", 51, 299, (True, False, True)),
        ("starter", 50, 300, (False, True, True)),
        ("enterprise", 1000, 1_000_000, (False, False, False)),
        ("launch", 0, 0, (False, False, False)),
    ],
)
def test_plan_limits_golden(spark, plan, products, searches, wanted):
    assert limits_of(spark, plan, products, searches) == wanted


def test_cycle_reset_boundary(spark):
    subs = spark.createDataFrame(
        [("a", 1, "active", 7, date(2024, 1, 2), None, None), ("b", 1, "active", 7, date(2024, 1, 3), None, None)], schemas.USER_SUBSCRIPTIONS
    )
    found = {r["shop_domain"]: r for r in metering.reset_cycles(subs, date(2024, 2, 1)).collect()}
    assert found["a"]["searches_this_month"] == 0 and found["a"]["billing_cycle_end"] == date(2024, 3, 2)
    assert found["b"]["searches_this_month"] == 7 and found["b"]["billing_cycle_end"] is None


# ------------------------------------------------------------------ analytics


def test_null_results_in_statistics(spark):
    events = spark.createDataFrame([(i, "q", r, None, "x", "s", NOW) for i, r in enumerate([3, 0, None])], schemas.SEARCH_ANALYTICS)
    day = analytics.daily_stats(events).first()
    assert (day["total_searches"], day["searches_with_results"], day["searches_no_results"], day["avg_results"]) == (3, 1, 1, 1.0)
    total = analytics.summary(events).first()
    assert (total["no_results_count"], total["no_results_percentage"], total["unique_queries"]) == (2, 66.7, 1)
    empty = analytics.summary(events.filter("false")).first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0.0)


def test_vector_quality_and_repair(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,)], "embedding array<float>")
    assert tuple(coverage.vector_quality(rows, 2).first()) == (4, 1, 1, 1)
    wrong = spark.createDataFrame([("[1,2]",)], "embedding string")
    assert coverage.repaired_vectors(wrong).schema["embedding"].dataType.simpleString() == "array<float>"
    assert coverage.repaired_vectors(rows) is rows


# ------------------------------------------------------------------ sources


def test_payload_file(spark, tmp_path):
    payload = {
        "shop": "demo",
        "products": [
            {"product_id": "1", "title": "T", "price": 9.5, "vendor": "V", "tags": "a, b", "variants": [{"id": "x", "title": "S", "price": "9.50"}, {"id": "y", "title": "M", "price": "bad"}], "images": []},
            {"product_id": "2", "title": "U", "description": "d", "price": 1, "tags": ""},
        ],
    }
    (tmp_path / "payload.json").write_text(json.dumps(payload, indent=2))
    first, second = C.read_payload(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert first["description"] == "" and first["tags"] == ["a", "b"] and first["price"] == Decimal("9.50")
    assert [v["price"] for v in first["variants"]] == [Decimal("9.50"), None]
    assert second["tags"] == [] and second["shop_domain"] == "demo"


def test_tenant_from_metadata(spark):
    rows = spark.createDataFrame([("a", '{"shop":"b"}'), (None, '{"shop":"b"}')], "shop_domain string, metadata string")
    assert [r["shop_domain"] for r in C.with_tenant(rows).collect()] == ["a", "b"]


# ------------------------------------------------------------------ embedding


@pytest.fixture
def failing():
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("cannot embed")
        return np.ones((len(texts), 2), dtype=np.float32)

    return embed


def test_one_failing_row_fails_alone(spark, failing):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "  "), (4, None), (5, "fine")], "id int, text string").coalesce(1)
    embedded = embedding.embed_rows(rows, "text", failing)
    found = {r["id"]: r for r in embedded.collect()}
    assert [found[i]["status"] for i in range(1, 6)] == ["ok", "error", "error", "error", "ok"]
    assert found[2]["error"] == "cannot embed" and found[1]["embedding"] == [1.0, 1.0]
    assert tuple(embedding.outcome(embedded).first()) == (5, 2, 3)


def test_cache_is_used_and_expires(spark, failing):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["x", "x", "y", "z", ""])], "id int, text string")
    cached = embedding.keyed(spark.createDataFrame([("x", datetime(2024, 1, 31)), ("y", datetime(2024, 1, 1))], "text string, cached_at timestamp_ntz"), "text")
    cache = cached.select("cache_key", F.array(F.lit(9.0).cast("float")).alias("embedding"), "cached_at")
    found, added = embedding.embed_through_cache(rows, "text", cache, failing, NOW, spread=["id"])
    vectors = {r["id"]: r["embedding"] for r in found.collect()}
    assert vectors == {0: [9.0], 1: [9.0], 2: [1.0, 1.0], 3: [1.0, 1.0], 4: None}
    assert added.count() == 2


def test_hashing_embedder():
    embed = embedding.hashing_embedder(16)
    vectors = embed(["Red shoe", "red  shoe", "hat"])
    assert np.allclose(vectors[0], vectors[1]) and np.allclose(np.linalg.norm(vectors, axis=1), 1.0)
