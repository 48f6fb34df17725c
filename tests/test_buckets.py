"""Catalogue in key buckets: the same rows as a merge of the whole, from few files."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.operators import buckets, merge
from vitrine.session import fresh_dir

NOW = datetime(2024, 3, 1)
COLUMNS = ["shop_domain", "product_id", "title", "price", "embedding", "metadata", "updated_at"]


@pytest.fixture(scope="module")
def stored(spark):
    """4,000 products, half of them of one tenant."""
    rows = spark.range(4000).selectExpr(
        "case when id % 2 = 0 then 'hot' else concat('s', id % 7) end AS shop_domain",
        "lpad(cast(id as string), 6, '0') AS product_id",
        "concat('title ', id) AS title",
        "cast(id % 50 as decimal(10,2)) AS price",
        "array(cast(id as float), 1f) AS embedding",
        "to_json(named_struct('needs_resync', true)) AS metadata",
        "timestamp_ntz '2024-01-01 00:00:00' AS updated_at",
    )
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.PRODUCT_EMBEDDINGS.fields if f.name not in rows.columns]
    return rows.select("*", *missing).select(*schemas.PRODUCT_EMBEDDINGS.names)


def incoming(rows):
    more = {c: F.lit(None).cast("string") for c in ("description", "vendor", "category", "metadata")}
    return rows.withColumns({**more, "tags": F.lit(None).cast("array<string>")}).select(
        *merge.PRODUCT_KEYS, "title", "price", *more, "tags"
    )


def as_set(frame):
    return {str(tuple(r)) for r in frame.select(*COLUMNS).collect()}


def test_clustered_merge_reads_few_files(spark, stored):
    path = fresh_dir(spark, "buckets-test")
    buckets.create(stored, path, rows_per_bucket=100)
    assert as_set(buckets.current(spark, path)) == as_set(stored)
    batch = incoming(stored.filter("shop_domain = 'hot' AND product_id BETWEEN '000100' AND '000106'").withColumn("title", F.lit("new")))
    again = incoming(spark.createDataFrame([("hot", "000101x", "added", Decimal(1))], "shop_domain string, product_id string, title string, price decimal(10,2)"))
    whole = merge.upsert_product_info(stored, batch.unionByName(again), NOW)
    done = buckets.upsert_product_info(spark, path, batch.unionByName(again), NOW)
    assert as_set(buckets.current(spark, path)) == as_set(whole)
    assert (done.version, done.buckets) == (1, 40) and done.touched <= 2
    entries = buckets._files(spark, path)
    assert len({e["commit"] for e in entries}) == 2
    assert sum(e["rows"] for e in entries) == 4001


def test_merges_follow_each_other_and_move_the_ends(spark, stored):
    path = fresh_dir(spark, "buckets-ends")
    buckets.create(stored, path, rows_per_bucket=500)
    table = stored
    for number, (shop, product) in enumerate([("a", "0"), ("zz", "9"), ("hot", "000000"), ("a", "0"), ("hot", "00000")], 1):
        one = incoming(spark.createDataFrame([(shop, product, f"t{number}", Decimal(number))], "shop_domain string, product_id string, title string, price decimal(10,2)"))
        table = merge.cut_lineage(merge.upsert_product_info(table, one, NOW))
        assert buckets.upsert_product_info(spark, path, one, NOW).touched == 1
    assert as_set(buckets.current(spark, path)) == as_set(table)
    assert buckets.current(spark, path).count() == 4003


def test_vectors_written_back_and_empty_batches(spark, stored):
    path = fresh_dir(spark, "buckets-vectors")
    buckets.create(stored, path, rows_per_bucket=300)
    vectors = stored.filter("shop_domain = 's3'").select(*merge.PRODUCT_KEYS, F.array(F.lit(7.0).cast("float"), F.lit(8.0).cast("float")).alias("embedding"))
    unknown = spark.createDataFrame([("s3", "none", [1.0, 2.0])], "shop_domain string, product_id string, embedding array<float>")
    whole, _ = merge.write_back_embeddings(stored, vectors, NOW)
    done = buckets.write_back_embeddings(spark, path, vectors.unionByName(unknown), NOW)
    assert as_set(buckets.current(spark, path)) == as_set(whole)
    assert 0 < done.touched < done.buckets / 2
    assert buckets.write_back_embeddings(spark, path, vectors.limit(0), NOW) == buckets.Merged(1, 0, done.buckets)


def test_unfinished_commits_are_not_seen_and_versions_are_written_once(spark, stored):
    path = fresh_dir(spark, "buckets-atomic")
    buckets.create(stored, path, rows_per_bucket=1000)
    stored.limit(10).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/data/commit=unfinished")
    assert as_set(buckets.current(spark, path)) == as_set(stored)
    with pytest.raises(Exception, match="(?i)already exists"):
        buckets._commit(spark, path, [(0, "x", "a", "b", 1)], 0)


def test_grown_buckets_are_split_and_still_found(spark, stored):
    path = fresh_dir(spark, "buckets-split")
    buckets.create(stored, path, rows_per_bucket=500)
    new = spark.range(1700).selectExpr("'hot' AS shop_domain", "concat('0002', lpad(cast(id as string), 5, '0')) AS product_id", "'n' AS title", "cast(1 as decimal(10,2)) AS price")
    table = merge.cut_lineage(merge.upsert_product_info(stored, incoming(new), NOW))
    buckets.upsert_product_info(spark, path, incoming(new), NOW)
    before = max(e["rows"] for e in buckets._files(spark, path))
    done = buckets.split(spark, path, most=700)
    entries = buckets._files(spark, path)
    assert before > 1700 and max(e["rows"] for e in entries) <= 700 and done.buckets == len(entries) == len({e["bucket"] for e in entries})
    assert as_set(buckets.current(spark, path)) == as_set(table)
    again = incoming(new.filter("product_id < '000200900'").withColumn("title", F.lit("later")))
    whole = merge.upsert_product_info(table, again, NOW)
    assert 0 < buckets.upsert_product_info(spark, path, again, NOW).touched < len(entries)
    assert as_set(buckets.current(spark, path)) == as_set(whole)
    assert buckets.split(spark, path, most=700).touched == 0
