"""Vector search: every path against brute force, and its properties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import ann, pq, quality, requests, rerank, search, settings, suffixes
from vitrine.session import build_session  # noqa: F401

DIM = 8
CATALOG = "product_id string, shop_domain string, embedding array<float>, price double, in_stock boolean, title string, metadata string"


@pytest.fixture(scope="module")
def data():
    """300 products, two thirds of them in one tenant, a third of them copies of one vector."""
    random = np.random.default_rng(3)
    products, twin = [], random.normal(size=DIM).astype(np.float32)
    for i in range(300):
        vector = twin if i % 3 == 0 else random.normal(size=DIM).astype(np.float32)
        shop = "hot" if i % 3 else ("a" if i % 2 else "b")
        shop = "hot" if i % 3 == 0 else shop
        vector = None if i % 41 == 5 else (np.zeros(DIM, np.float32) if i % 53 == 7 else vector)
        price = None if i % 29 == 3 else float(i)
        products.append((f"p{i}", shop, None if vector is None else [float(x) for x in vector], price, i % 4 != 0, f"t{i}", '{"archived": %s}' % str(i % 5 == 0).lower()))
    asked = []
    for j in range(12):
        vector = [float(x) for x in random.normal(size=DIM)]
        asked.append((f"q{j}", vector, ["hot", "a", "b"][j % 3], [3, 7, 400][j % 3], [None, 0.2][j % 2], [None, 150.0][j // 6], j % 4 == 0))
    return products, asked


@pytest.fixture(scope="module")
def frames(spark, data):
    products, asked = data
    return (
        spark.createDataFrame(products, CATALOG).repartition(7),
        spark.createDataFrame(asked, "query_id string, qvec array<double>, shop_domain string, k int, min_similarity double, max_price double, in_stock_only boolean"),
    )


def brute(data, by_tenant):
    products, asked = data
    found = set()
    for query, qvec, shop, k, floor, high, stock in asked:
        scored = []
        for pid, pshop, vector, price, in_stock, *_ in products:
            if vector is None or not any(vector) or (by_tenant and pshop != shop):
                continue
            if high is not None and (price is None or price > high):
                continue
            if stock and not in_stock:
                continue
            v, q = np.array(vector, dtype=np.float32).astype(float), np.array(qvec)
            similarity = round(float(v @ q / np.sqrt((v @ v) * (q @ q))), 6)
            if floor is not None and similarity < floor:
                continue
            scored.append((-similarity, pid, pshop))
        for rank, (negative, pid, pshop) in enumerate(sorted(scored)[:k], start=1):
            found.add((query, pid, pshop, -negative, rank))
    return found


def result(frame):
    return {tuple(r) for r in frame.select("query_id", "product_id", "shop_domain", "similarity", "rank").collect()}


@pytest.mark.parametrize("by_tenant", [True, False])
@pytest.mark.parametrize("max_broadcast", [search.MAX_BROADCAST_REQUESTS, 0])
def test_top_k_equals_brute_force(frames, data, by_tenant, max_broadcast):
    catalog, asked = frames
    assert result(search.top_k(catalog, asked, by_tenant=by_tenant, max_broadcast=max_broadcast)) == brute(data, by_tenant)


@pytest.mark.parametrize("max_broadcast", [search.MAX_BROADCAST_REQUESTS, 0])
def test_results_without_a_k(frames, data, monkeypatch, max_broadcast):
    """Some requests have a k and some none; the state is settled often, and ranks span many tasks."""
    monkeypatch.setattr(search, "GATHERED_ROWS", 20)
    products, asked = data
    asked = [(*a[:3], None if i % 3 else 4, *a[4:]) for i, a in enumerate(asked)]
    catalog, table = frames
    table = table.withColumn("k", F.when(F.substring("query_id", 2, 3).cast("int") % 3 == 0, 4))
    assert result(search.top_k(catalog, table, max_broadcast=max_broadcast)) == brute((products, asked), False)


def test_total_rank_numbers_across_tasks(spark):
    rows = [("hot", f"p{i % 90}", f"s{i // 90}", float(i % 7)) for i in range(900)] + [("b", "p", "s", 1.0), ("c", "p", None, 1.0), ("c", "p", "s", 1.0)]
    frame = spark.createDataFrame(rows, "query_id string, product_id string, shop_domain string, similarity double").repartition(5)
    found = {tuple(r) for r in search.total_rank(frame).collect()}
    wanted = set()
    for name in ("hot", "b", "c"):
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (-r[3], r[1], r[2] or ""))
        wanted |= {(*r, i + 1) for i, r in enumerate(own)}
    assert found == wanted
    assert search.total_rank(frame.limit(0)).count() == 0


def test_small_blocks_equal_brute_force(frames, data):
    """Cells cut into many blocks of products and requests."""
    catalog, asked = frames
    products = search._products(catalog).withColumn("cell", F.col("shop_domain"))
    wanted = search._requests(asked, None).withColumn("cell", F.col("shop_domain"))
    partial = search.blocked_partials(products, wanted, True, block_products=17, block_requests=2)
    assert result(search.final_rank(partial)) == brute(data, True)


def test_batch_equals_single_requests(frames):
    catalog, asked = frames
    whole = result(search.top_k(catalog, asked, by_tenant=True))
    for query in ("q0", "q4"):
        alone = result(search.top_k(catalog, asked.filter(F.col("query_id") == query), by_tenant=True))
        assert alone == {r for r in whole if r[0] == query}


def test_threshold_results_nest(frames):
    catalog, asked = frames
    plain = asked.withColumn("min_similarity", F.lit(None).cast("double")).withColumn("k", F.lit(300))
    strict = plain.withColumn("min_similarity", F.lit(0.3))
    everything, some = result(search.top_k(catalog, plain)), result(search.top_k(catalog, strict))
    assert some == {r for r in everything if r[3] >= 0.3} and some < everything


def test_wrong_dimension_is_an_error(spark, frames):
    catalog, _ = frames
    asked = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, qvec array<double>")
    with pytest.raises(Exception, match="embedding length differs"):
        search.top_k(catalog, asked, k=1).collect()


def test_exact_index_equals_brute_force(frames, data):
    catalog, asked = frames
    index = ann.build_index(catalog, lists=12)
    plain = asked.drop("shop_domain")
    for probes in (1, 12):
        assert result(ann.exact(index, plain, probes=probes)) == brute(data, False)
    # Probing every bucket is exact by itself.
    assert result(ann.probe(index, plain, probes=12)) == brute(data, False)
    few = result(ann.probe(index, plain, probes=3))
    assert {r[0] for r in few} <= {f"q{j}" for j in range(12)}


def test_quantised_search(frames, data, monkeypatch):
    """Exact while all lists are probed and the shortlist holds everything; filters and thresholds hold;
    requests may come in blocks."""
    catalog, asked = frames
    asked = asked.withColumn("k", F.least("k", F.lit(290)))
    index = pq.build(catalog, lists=9, parts=4, probes=9, shortlist=300)
    wanted = brute((data[0], [(*a[:3], min(a[3], 290), *a[4:]) for a in data[1]]), False)
    plain = asked.drop("shop_domain")
    assert result(pq.top_k(index, plain)) == wanted
    monkeypatch.setattr(search, "MAX_BROADCAST_REQUESTS", 5)
    assert result(pq.top_k(index, plain)) == wanted
    with pytest.raises(ValueError, match="shortlist holds 20"):
        pq.top_k(pq.replace(index, shortlist=20), plain)
    few = pq.replace(index, probes=2, shortlist=10)
    found = result(pq.top_k(few, plain.withColumn("k", F.lit(5))))
    assert {r[:4] for r in found} <= {r[:4] for r in result(search.top_k(catalog, plain.withColumn("k", F.lit(300))))}


def test_calibration_reaches_the_recall(spark):
    random = np.random.default_rng(4)
    centres = random.normal(size=(20, 16))
    rows = [(f"p{i}", "s", [float(x) for x in centres[i % 20] + 0.3 * random.normal(size=16)]) for i in range(2000)]
    catalog = spark.createDataFrame(rows, "product_id string, shop_domain string, embedding array<float>").repartition(4)
    index = pq.calibrated(pq.build(catalog, lists=20, parts=8), catalog, k=10, target=0.95)
    assert index.probes < 10 and index.shortlist < 400
    asked = catalog.filter("cast(substring(product_id, 2) as int) % 50 = 0").selectExpr("product_id AS query_id", "embedding AS qvec")
    assert pq.recall(pq.top_k(index, asked), search.top_k(catalog, asked, k=10)) >= 0.9


def test_similar_products_leave_out_the_anchor(spark):
    rows = [(f"p{i}", "s", [1.0, float(i // 2)], True) for i in range(8)] + [("p0", "other", [1.0, 0.0], True)]
    catalog = spark.createDataFrame(rows, "product_id string, shop_domain string, embedding array<float>, available boolean")
    anchors = spark.createDataFrame([("p0", "s", "s"), ("p0", "other", "s")], "anchor_id string, anchor_shop string, shop_domain string")
    found = search.similar_products(catalog, anchors, k=3).collect()
    own = sorted((r["rank"], r["product_id"]) for r in found if r["anchor_shop"] == "s")
    assert own == [(1, "p1"), (2, "p2"), (3, "p3")]
    # Searched from another tenant the product itself is a result.
    foreign = sorted((r["rank"], r["product_id"]) for r in found if r["anchor_shop"] == "other")
    assert foreign == [(1, "p0"), (2, "p1"), (3, "p2")]


def test_suggestions(spark):
    titles = [("s", "Red shoe", True)] * 3 + [("s", "Blue shoe", True)] * 3 + [("s", "Shoe box", True), ("s", "Hat", True), ("s", "Old shoe", False), ("z", "Red shoe", True)]
    catalog = spark.createDataFrame(titles, "shop_domain string, title string, available boolean")
    asked = spark.createDataFrame([("q", "s", "SHOE")], "query_id string, shop_domain string, partial string")
    found = search.suggestions(catalog, asked, limit=3).orderBy("rank").collect()
    assert [(r["title"], r["frequency"]) for r in found] == [("Blue shoe", 3), ("Red shoe", 3), ("Shoe box", 1)]


def test_suggestions_by_rarest_letters(spark):
    titles = [("s", f"{a} {b}", True) for a in ("Red", "blue", "GREEN", "greenish", "50%") for b in ("shoe", "Shoes", "hat", "s_x")] * 2
    catalog = spark.createDataFrame(titles + [("t", "red hat", True)], "shop_domain string, title string, available boolean")
    texts = ["red", "SHOE", "een", "hat", "e", "zzz", "50%", "s_o", "d sho", "greens"]
    asked = spark.createDataFrame([(f"{shop}{i}", shop, p) for i, p in enumerate(texts) for shop in ("s", "t")], "query_id string, shop_domain string, partial string")
    direct = search.suggestions(catalog, asked, limit=4)
    joined = search.suggestions(catalog, asked, limit=4, direct_per_tenant=0)
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in direct.collect()}
    assert direct.count() > 20


@pytest.mark.parametrize("block", [50_000, 3])
def test_suggestions_by_suffix_ranges(spark, monkeypatch, block):
    """Short partials, wildcards and escapes looked up by range equal the direct trial."""
    monkeypatch.setattr(suffixes, "ASKED_BLOCK", block)
    titles = [("s", f"{a} {b}", i % 5 > 0) for i, (a, b) in enumerate((a, b) for a in ("Red", "blue", "GREEN", "É", "50%", "aaa") for b in ("shoe", "Shoes", "hat", "s_x", "", "banana"))]
    titles += titles[::3] + [("t", "red hat", True), ("t", "", True), ("t", None, True), (None, "red", True)]
    catalog = spark.createDataFrame(titles, "shop_domain string, title string, available boolean").repartition(3)
    texts = ["", "a", "an", "é", "RED", "%", "_", "r%t", "%hat", "s_o", r"0\%", r"s\_x", "a_a", "zzz", "shoe%", "n%n", " ", "_e"]
    asked = spark.createDataFrame([(f"{shop}{i}", shop, p) for i, p in enumerate(texts) for shop in ("s", "t")], "query_id string, shop_domain string, partial string")
    direct, ranged = (search.suggestions(catalog, asked, limit=4, max_broadcast_bytes=most) for most in (1 << 20, -1))
    wanted = {tuple(r) for r in direct.collect()}
    assert {tuple(r) for r in ranged.collect()} == wanted and len(wanted) > 40
    assert search.suggestions(catalog.limit(0), asked, max_broadcast_bytes=-1).count() == 0


RESULTS = "query_id string, id string, price double, vendor string, inventory int, similarity double, rank int, tags array<string>"
SAMPLE = [
    ("q", "prod_001", 129.99, "Nike", 45, 0.92, 1, ["running"]),
    ("q", "prod_002", 189.99, "Adidas", 23, 0.89, 2, ["running"]),
    ("q", "prod_003", 149.99, "New Balance", 67, 0.87, 3, ["comfort", "running"]),
]


def test_assistant_rerank(spark):
    ranked = rerank.assistant_rerank(spark.createDataFrame(SAMPLE, RESULTS), price_range=(100, 150), vendors=["New Balance"])
    found = ranked.orderBy("final_rank").collect()
    assert [(r["id"], r["final_score"]) for r in found] == [("prod_003", 1.32066), ("prod_001", 1.2144), ("prod_002", 1.068)]


def test_business_filter_and_funnel(spark):
    rows = spark.createDataFrame(SAMPLE, RESULTS)
    rules = {"max_price": 150.0, "tags": ["comfort", "marathon"]}
    assert [r["id"] for r in rerank.business_filter(rows, **rules).collect()] == ["prod_003"]
    funnel = rerank.filter_funnel(rows, ["query_id"], **rules).first()
    assert (funnel["original_count"], funnel["after_max_price"], funnel["after_tags"], funnel["after_in_stock"]) == (3, 2, 1, 1)


def test_storefront_rerank_keeps_prior_order_on_ties(spark):
    rows = [("q", i + 1, 0.5, True, 3, 10.0, 20.0, None if i else 0) for i in range(4)]
    frame = spark.createDataFrame(rows, "query_id string, rank int, similarity double, available boolean, inventory_quantity int, price_min double, price_max double, popularity_score int")
    found = rerank.storefront_rerank(frame, preferred_range=(5.0, 25.0)).collect()
    assert all(r["final_rank"] == r["rank"] for r in found)
    assert found[0]["final_score"] == pytest.approx(0.5 * 1.1 * 1.05)


def test_quality_metrics(spark):
    results = spark.createDataFrame([("a", f"p{i}", "s") for i in range(5)], "query_id string, product_id string, shop_domain string")
    expected = spark.createDataFrame([("a", "p0", "s"), ("b", "p9", "s")], "query_id string, product_id string, shop_domain string")
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    found = {r["query_id"]: r for r in quality.quality_metrics(results, expected, queries).collect()}
    assert (found["a"]["precision"], found["a"]["recall"], found["a"]["grade"]) == (0.2, 1.0, "excellent")
    assert (found["b"]["recall"], found["b"]["grade"]) == (0.0, "improvable")
    assert (found["c"]["precision"], found["c"]["recall"]) == (0.0, 0.0)


def test_answers_gate_limit_and_archive(spark, frames):
    catalog = frames[0].withColumn("description", F.lit("d")).withColumn("vendor", F.lit("v")).withColumn("category", F.lit(None).cast("string"))
    asked = spark.createDataFrame(
        [("1", "hot", "Runing shoos", 5, None), ("2", "a", "shoes", 5, None), ("3", "b", "shoes", 5, None)],
        "query_id string, shop_domain string, query string, max_results int, max_price double",
    )
    stored = spark.createDataFrame(
        [("hot:ai_search", '{"exclude_archived": true, "similarity_threshold": -100}'), ("a:ai_search", '{"ai_search_enabled": false}')],
        "key string, value string",
    )
    config = settings.tenant_config(stored, asked)
    vocabulary = spark.createDataFrame([("running",), ("shoes",)], "term string")
    limits = spark.createDataFrame([("b", True), ("hot", False)], "shop string, searches_exceeded boolean")

    def embed(rows):
        return rows.withColumn("qvec", F.array(*[F.lit(float(i)) for i in range(DIM)]))

    post = requests.answer(asked, catalog, config, vocabulary, embed, limits)
    assert [r["query_id"] for r in post.limited.collect()] == ["3"]
    assert [r["query_id"] for r in post.disabled.collect()] == ["2"]
    counts = post.counts.collect()
    assert [(r["query_id"], r["corrected_query"], r["was_corrected"]) for r in counts] == [("1", "running shoes", True)]
    shown = post.results.collect()
    assert counts[0]["results_count"] == len(shown) <= 5
    pre = requests.answer(asked, catalog, config, vocabulary, embed, limits, archived_filter="pre")
    assert len(pre.results.collect()) == 5
    archived = {r["product_id"] for r in catalog.filter("metadata LIKE '%true%'").collect()}
    assert not archived & {r["id"] for r in shown}
    assert post.results.first()["category"] == ""
    documents = requests.response_documents(post.results).collect()
    assert len(documents) == len(shown) and '"handle":""' in documents[0]["document"]
