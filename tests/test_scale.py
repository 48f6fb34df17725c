"""Plans: what is pushed down, pruned, broadcast and kept out of shuffles."""

from __future__ import annotations

import glob
import re

from pyspark.sql import functions as F

from vitrine.functions import sizing
from vitrine.operators import merge, search
from vitrine.plans import bindings as B
from vitrine.session import cut_lineage, fresh_dir, scratch
from vitrine.sources import catalog as C


def plan(frame) -> str:
    return frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def test_catalog_scan_is_pruned_and_filtered(spark, sf_dir):
    path = fresh_dir(spark, "scan")
    merge.write_snapshot(B.stored_catalog(spark, sf_dir), path)
    scan = C.read_catalog(spark, path).filter("shop_domain = 'shop_3' AND vendor = 'Brand#1'").select("product_id", "title")
    text = plan(scan)
    assert "PartitionFilters" in text and "shop_3" in text
    assert "EqualTo(vendor,Brand#1)" in text
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "embedding" not in schema and "description" not in schema


def test_scoring_reads_no_display_columns(spark, sf_dir):
    path = fresh_dir(spark, "score")
    merge.write_snapshot(B.stored_catalog(spark, sf_dir), path)
    products = search._products(C.read_catalog(spark, path))
    schema = re.search(r"ReadSchema: (.*)", plan(products)).group(1)
    assert "embedding" in schema and "title" not in schema and "description" not in schema and "metadata" not in schema


def test_small_merge_does_not_shuffle_the_catalogue(spark, sf_dir):
    path = fresh_dir(spark, "merge")
    merge.write_snapshot(B.stored_catalog(spark, sf_dir), path)
    stored = C.read_catalog(spark, path)
    incoming = merge.keep_last(B.incoming_catalog(spark, sf_dir), merge.PRODUCT_KEYS)
    text = plan(merge.upsert_product_info(stored, incoming, B.AS_OF))
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_partial_aggregation_precedes_every_shuffle_of_events(spark, sf_dir):
    from vitrine.operators import analytics

    text = plan(analytics.daily_rollup(B.search_events(spark, sf_dir), store="shop_domain"))
    assert "partial_" in text


def test_top_k_limits_before_the_shuffle(spark):
    partial = spark.range(5000).selectExpr("cast(id % 7 as string) AS query_id", "cast(id as int) AS k", "cast(id as string) AS product_id", "'s' AS shop_domain", "cast(id as double) AS similarity")
    assert "WindowGroupLimit" in plan(search.final_rank(partial, most=1000))


def test_size_check(spark):
    rows = spark.range(1000).select(F.expr("repeat('x', 1000)").alias("s"))
    assert sizing.is_small(rows, max_bytes=2_000_000)
    assert not sizing.is_small(rows, max_bytes=500_000)
    assert sizing.is_small(rows.filter("false"), max_bytes=0)


def test_lineage_is_cut_in_the_shared_folder_only():
    for path in glob.glob("/root/repo/vitrine/**/*.py", recursive=True):
        assert "local" + "Checkpoint" not in open(path).read()


def test_scratch_tables_are_deleted_and_earlier_ones_stay(spark):
    kept = cut_lineage(spark.range(5).toDF("n"))
    with scratch(spark):
        made = cut_lineage(kept.filter("n > 1"))
        assert made.count() == 3
        folder = made.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert glob.glob(f"{folder}/*")
    assert not glob.glob(f"{folder}/*") and kept.count() == 5
