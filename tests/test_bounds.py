"""What a task holds and what is moved follows from bounds, not from the size of the input."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.functions import sizing
from vitrine.functions import text as X
from vitrine.operators import buckets, embedding, merge, pq, search
from vitrine.session import fresh_dir
from vitrine.streaming import jobs

NOW = datetime(2024, 1, 31)


def test_quantised_search_hands_on_k_rows_per_task(spark, monkeypatch):
    random = np.random.default_rng(2)
    rows = [(f"p{i:03}", "s", [float(x) for x in random.normal(size=8)]) for i in range(400)]
    catalog = spark.createDataFrame(rows, "product_id string, shop_domain string, embedding array<float>").repartition(2).cache()
    asked = catalog.filter("substring(product_id, 3) = '00' OR substring(product_id, 3) = '50'").selectExpr("product_id AS query_id", "embedding AS qvec")
    index = pq.build(catalog, lists=4, parts=4, probes=4, shortlist=150)
    handed, rank = [], search.final_rank
    monkeypatch.setattr(search, "final_rank", lambda partial, most=None: handed.append(partial) or rank(partial, most))
    found = pq.top_k(index, asked, k=3)
    monkeypatch.undo()  # tasks take the module along
    assert len(handed) == 1
    tasks, requests = handed[0].rdd.getNumPartitions(), asked.count()
    assert handed[0].count() <= 3 * requests * tasks < 150 * requests
    assert pq.recall(found, search.top_k(catalog, asked, k=3)) >= 0.9
    # Gathering single vectors and multiplying all of them find the same.
    wanted = sorted(map(tuple, found.collect()))
    for dense in (1, 1 << 20):
        monkeypatch.setattr(pq, "DENSE", dense)
        assert sorted(map(tuple, pq.top_k(index, asked, k=3).collect())) == wanted


def test_embedder_gets_bounded_calls(spark):
    def sizes(texts):
        return np.array([[len(texts), sum(map(len, texts))]] * len(texts), float)

    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 != 3, F.repeat(F.lit("x"), F.lit(20) + (F.col("id") % 100 == 0).cast("int") * 300_000)).alias("text"))
    found = embedding.embed_rows(rows.coalesce(1), "text", sizes).collect()
    assert len(found) == 3000 and {r["status"] for r in found if r["id"] % 7 != 3} == {"ok"}
    assert all((r["status"] == "error") == (r["id"] % 7 == 3) for r in found)
    done = [r["embedding"] for r in found if r["status"] == "ok"]
    assert max(n for n, _ in done) <= 512 and max(size for _, size in done) <= 1 << 20


def _products(spark, rows):
    """Products of (shop, id, title, price)."""
    frame = spark.createDataFrame(rows, "shop_domain string, product_id string, title string, price int")
    kinds = {f.name: f.dataType for f in schemas.PRODUCT_EMBEDDINGS.fields}
    known = frame.withColumn("description", F.concat(F.lit("about "), "title"))
    return known.select(*[(F.col(c) if c in known.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in kinds])


def _all(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("few", [True, False])
def test_large_merge_gives_the_same_and_writes_down_no_texts(spark, monkeypatch, few):
    stored = _products(spark, [("s", str(i), f"t{i}", i) for i in range(30)] + [("s", "4", "twice", 1), (None, "5", "no shop", 1)])
    incoming = _products(spark, [("s", str(i), f"new{i}", 2 * i) for i in range(20, 40)] + [(None, "5", "also", 3), ("r", "1", "a", 1), ("r", "1", "b", 1)])
    wanted = _all(merge.upsert_product_info(stored, incoming, NOW))
    written, settle = [], sizing.settle

    def recorded(rows, *most):
        written.append(set(rows.columns))
        kept, small = settle(rows, *most)
        return kept, small and few

    monkeypatch.setattr(sizing, "settle", recorded)
    monkeypatch.setattr(merge, "MAX_KEY_BYTES", -1, raising=False)
    monkeypatch.setattr(sizing, "MAX_BROADCAST_BYTES", -1)
    assert _all(merge.upsert_product_info(stored, incoming, NOW)) == wanted
    assert not [c for c in written if "description" in c]


def test_last_rows_without_gathering_all(spark):
    rows = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 2, "m"), ("c", None, "w"), ("d", 5, None)],
        "key string, ordinal int, text string",
    )
    last = merge.keep_last(rows, ["key"])
    # A row that has no place is no last row, as before.
    assert _all(last) == sorted([("a", 2, "y"), ("b", 1, "z"), (None, 2, "m"), ("c", None, None), ("d", 5, None)], key=str)
    plan = merge.keep_last(rows.filter("key IN ('b', 'd')"), ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_intake_writes_texts_down_once_per_batch(spark, monkeypatch):
    path, kept, cut = fresh_dir(spark, "intake"), [], buckets.cut_lineage

    def recorded(frame):
        kept.append(set(frame.columns))
        return cut(frame)

    for module in (buckets, jobs, sizing):
        monkeypatch.setattr(module, "cut_lineage", recorded)
    jobs.product_store(_products(spark, [("s", str(i), f"t{i}", i) for i in range(30)]), path, 10)
    monkeypatch.setattr(merge, "MAX_KEY_BYTES", -1, raising=False)
    text = X.weighted_text(F.col("title"), F.col("description"), F.col("vendor"))
    write = jobs.product_intake(path, text, embedding.word_embedder(4), NOW)
    feed = _products(spark, [("s", str(i), f"t{i % 9}", 1) for i in range(20, 40)]).drop("embedding", "created_at", "updated_at")
    write(feed.withColumn("ordinal", F.lit(1)), 0)
    stored = buckets.current(spark, path)
    assert stored.count() == 40 and stored.filter("embedding IS NOT NULL AND text_key IS NOT NULL").count() == 20
    assert sum(bool({"description", "_text"} & c) for c in kept) <= 1
    flags = stored.filter("embedding IS NOT NULL").select(F.get_json_object("metadata", "$.needs_resync")).distinct()
    assert [r[0] for r in flags.collect()] == ["false"]
