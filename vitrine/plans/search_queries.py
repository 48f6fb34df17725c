"""Registered queries: search, ranking, typo correction, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine import sqlapi
from vitrine.functions import predicates as P
from vitrine.functions import sizing
from vitrine.functions import vectors as V
from vitrine.operators import ann, pq, quality, requests, rerank, search, settings, typos
from vitrine.plans import bindings as B
from vitrine.plans import sql
from vitrine.plans.registry import query
from vitrine.session import cut_lineage
from vitrine.sources import seeds

RANKED = """row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, product_id, shop_domain)"""
COLUMNS = ["query_id", "product_id", "shop_domain", "similarity", "rank"]


@query(
    f"""WITH {sql.CAT}, {sql.LABELS}, scored AS (
  SELECT 'label_' || CAST(l.label AS VARCHAR) AS query_id, c.product_id || '_' || r.range AS product_id, c.shop_domain,
         round(list_cosine_similarity(c.embedding, l.qvec), 6) AS similarity
  FROM cat c, lab l, range(4) r WHERE c.embedding IS NOT NULL
)
SELECT *, {RANKED} AS rank FROM scored QUALIFY {RANKED} <= 1500"""
)
def vec_topk_deep(spark, sf_dir):
    """1,500 results per request, each product listed four times."""
    copies = F.explode(F.array(*(F.lit(str(i)) for i in range(4))))
    catalog = B.catalog(spark, sf_dir).filter("embedding IS NOT NULL").withColumn("_copy", copies)
    catalog = catalog.withColumn("product_id", F.concat_ws("_", "product_id", "_copy")).drop("_copy")
    return search.top_k(catalog, B.label_requests(spark, sf_dir), k=1500).select(*COLUMNS)


@query(
    f"""WITH {sql.CAT}, {sql.LABELS}, scored AS (
  SELECT 'label_' || CAST(l.label AS VARCHAR) AS query_id, c.product_id, c.shop_domain, c.title, c.vendor, c.price,
         round(list_cosine_similarity(c.embedding, l.qvec), 6) AS similarity
  FROM cat c, lab l WHERE c.embedding IS NOT NULL AND c.in_stock AND c.price <= 950
)
SELECT query_id, product_id, shop_domain, title, vendor, CAST(price AS DOUBLE) AS price, similarity, {RANKED} AS rank
FROM scored QUALIFY {RANKED} <= 10"""
)
def vec_topk_filtered(spark, sf_dir):
    """Filtered top-10 per label request over every tenant."""
    catalog = B.catalog(spark, sf_dir)
    asked = B.label_requests(spark, sf_dir)
    filtered = catalog.filter(P.all_of([P.price_between(high=950.0), P.in_stock_flag()]))
    found = search.top_k(filtered, asked, k=10)
    shown = search.with_products(found, B.catalog(spark, sf_dir, vectors=False), ["title", "vendor", "price"])
    return shown.select(
        "query_id", "product_id", "shop_domain", "title", "vendor", F.col("price").cast("double").alias("price"), "similarity", "rank"
    )


_BY_SHOP = f"""WITH {sql.CAT}, {sql.LABELS}, {sql.SHOP_LABELS}, scored AS (
  SELECT a.query_id, c.product_id, c.shop_domain,
         round(list_cosine_similarity(c.embedding, a.qvec), 6) AS similarity
  FROM asked a JOIN cat c USING (shop_domain)
  WHERE c.embedding IS NOT NULL {{condition}}
)
SELECT *, {RANKED} AS rank FROM scored WHERE similarity >= {{floor}} QUALIFY {RANKED} <= {{k}}"""


def _threshold(spark, sf_dir, max_broadcast):
    catalog = B.catalog(spark, sf_dir).filter("available")
    asked = B.shop_label_requests(spark, sf_dir).withColumn("min_similarity", F.lit(0.05))
    return search.top_k(catalog, asked, k=20, by_tenant=True, max_broadcast=max_broadcast).select(*COLUMNS)


@query(_BY_SHOP.format(condition="AND c.available", floor=0.05, k=20))
def vec_threshold_topk(spark, sf_dir):
    """Top-20 above a threshold within each request's tenant."""
    return _threshold(spark, sf_dir, search.MAX_BROADCAST_REQUESTS)


@query(_BY_SHOP.format(condition="", floor=0.05, k=20))
def sql_search_products(spark, sf_dir):
    """The table function, called for every request from SQL text."""
    sqlapi.register_search(spark, B.catalog(spark, sf_dir))
    B.shop_label_requests(spark, sf_dir).createOrReplaceTempView("vitrine_requests")
    return spark.sql(
        """SELECT r.query_id, s.product_id, s.shop_domain, s.similarity, s.rank
FROM vitrine_requests r, LATERAL search_products(r.qvec, r.shop_domain, 0.05D, 20) s"""
    )


@query(_BY_SHOP.format(condition="AND c.available", floor=0.05, k=20))
def vec_threshold_topk_blocked(spark, sf_dir):
    """The same through the block-wise path used for large request tables."""
    return _threshold(spark, sf_dir, 0)


@query(
    f"""WITH {sql.CAT}, {sql.LABELS}, scored AS (
  SELECT 'label_' || CAST(l.label AS VARCHAR) AS query_id, c.product_id, c.shop_domain,
         round(list_cosine_similarity(c.embedding, l.qvec), 6) AS similarity
  FROM cat c, lab l WHERE c.embedding IS NOT NULL
)
SELECT *, {RANKED} AS rank FROM scored WHERE similarity >= -0.1"""
)
def vec_threshold_unlimited(spark, sf_dir):
    """Every product above a threshold per label request, ranked, with no k."""
    asked = B.label_requests(spark, sf_dir).withColumn("min_similarity", F.lit(-0.1))
    return search.top_k(B.catalog(spark, sf_dir), asked).select(*COLUMNS)


@query(
    f"""WITH {sql.CAT}, center AS (
  SELECT list(m ORDER BY i) AS qvec FROM (
    SELECT i, avg(v) AS m FROM (SELECT unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i
                                FROM cat WHERE embedding IS NOT NULL) GROUP BY i)
)
SELECT c.product_id, c.shop_domain, c.title, round(list_cosine_similarity(c.embedding, center.qvec), 6) AS similarity
FROM cat c, center WHERE c.embedding IS NOT NULL
ORDER BY similarity DESC, c.product_id LIMIT 10"""
)
def vec_raw_scores(spark, sf_dir):
    """Diagnostic: raw top-10 for one vector (the catalogue's mean), any tenant, no threshold."""
    catalog = B.catalog(spark, sf_dir)
    one = V.mean_vectors(catalog.withColumn("query_id", F.lit("mean")), ["query_id"])
    found = search.top_k(catalog, one, k=10)
    shown = search.with_products(found, B.catalog(spark, sf_dir, vectors=False), ["title"])
    return shown.select("product_id", "shop_domain", "title", "similarity")


@query(
    f"""WITH {sql.CAT}, {sql.means("shop", "shop_domain")}
SELECT c.product_id, c.shop_domain, round(list_cosine_similarity(c.embedding, s.qvec), 6) AS similarity,
       round(1 - list_cosine_similarity(c.embedding, s.qvec), 6) AS distance,
       round(list_cosine_similarity(c.embedding, c.embedding), 6) AS self_similarity
FROM cat c JOIN shop s USING (shop_domain) WHERE c.embedding IS NOT NULL"""
)
def vec_pairwise(spark, sf_dir):
    """Row-wise cosine of each product with its tenant's mean vector."""
    catalog = B.catalog(spark, sf_dir).filter(P.has_embedding()).select("product_id", "shop_domain", "embedding")
    means = V.mean_vectors(catalog, ["shop_domain"])
    a, b = F.col("embedding"), F.col("qvec")
    return catalog.join(sizing.small_side(means), "shop_domain").select(
        "product_id",
        "shop_domain",
        V.rounded(V.cosine_similarity(a, b)).alias("similarity"),
        V.rounded(V.cosine_distance(a, b)).alias("distance"),
        V.rounded(V.cosine_similarity(a, a)).alias("self_similarity"),
    )


@query(
    f"""WITH {sql.CAT}, {sql.LABELS}, {sql.SHOP_LABELS}, scored AS (
  SELECT a.query_id, c.product_id, c.shop_domain, c.available, c.inventory_quantity, c.price_min, c.price_max, c.popularity_score,
         round(list_cosine_similarity(c.embedding, a.qvec), 6) AS similarity
  FROM asked a JOIN cat c USING (shop_domain)
  WHERE c.embedding IS NOT NULL AND c.available AND c.price_min >= 901 AND c.price_max <= 960 AND c.vendor ILIKE '%brand#1%'
    AND c.category ILIKE '%a%' AND list_has_any(c.tags, ['small', 'ring', 'hot', 'plate', 'blue', 'rod']) AND c.inventory_quantity > 0
),
top AS (SELECT *, {RANKED} AS rank FROM scored WHERE similarity >= -0.5 QUALIFY {RANKED} <= 20),
final AS (
  SELECT *, round(similarity * CASE WHEN available AND inventory_quantity > 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
         * CASE WHEN price_min >= 905 AND price_max <= 935 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END
         * (1 + popularity_score / 100), 12) AS final_score FROM top
)
SELECT query_id, product_id, similarity, rank, final_score, CAST(CAST(similarity AS DECIMAL(10,6)) AS DECIMAL(5,4))::DOUBLE AS shown_similarity,
       row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank) AS final_rank
FROM final"""
)
def vec_storefront_search(spark, sf_dir):
    """Storefront search: option filters, threshold, top-20, re-ranking."""
    catalog = B.catalog(spark, sf_dir)
    wanted = P.product_filters(
        price_min=901.0, price_max=960.0, vendor="brand#1", product_type="a",
        tags=["small", "ring", "hot", "plate", "blue", "rod"], in_stock=True,
    )
    asked = B.shop_label_requests(spark, sf_dir).withColumn("min_similarity", F.lit(-0.5))
    found = search.top_k(catalog.filter(F.col("available") & wanted), asked, k=20, by_tenant=True)
    fields = ["available", "inventory_quantity", "price_min", "price_max", "popularity_score"]
    shown = search.with_products(found, B.catalog(spark, sf_dir, vectors=False), fields)
    ranked = rerank.storefront_rerank(shown, preferred_range=(905.0, 935.0))
    return ranked.select(
        "query_id", "product_id", "similarity", "rank", "final_score",
        V.shown(F.col("similarity")).cast("double").alias("shown_similarity"), "final_rank",
    )


@query(
    f"""WITH {sql.CAT}, {sql.LABELS}, scored AS (
  SELECT 'label_' || CAST(l.label AS VARCHAR) AS query_id, c.product_id, c.shop_domain, c.vendor, c.price, c.stock_quantity AS inventory,
         round(list_cosine_similarity(c.embedding, l.qvec), 6) AS similarity
  FROM cat c, lab l WHERE c.embedding IS NOT NULL
),
top AS (SELECT *, {RANKED} AS rank FROM scored QUALIFY {RANKED} <= 50),
final AS (
  SELECT *, round(similarity * CASE WHEN inventory > 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END
         * CASE WHEN price BETWEEN 910 AND 930 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
         * CASE WHEN vendor IN ('Brand#2', 'Brand#17', 'Brand#23') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 12) AS final_score FROM top
)
SELECT query_id, product_id, similarity, rank, final_score,
       row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank) AS final_rank
FROM final"""
)
def vec_assistant_rerank(spark, sf_dir):
    """Top-50 per label re-ranked by stock, price range and vendors."""
    found = search.top_k(B.catalog(spark, sf_dir), B.label_requests(spark, sf_dir), k=50)
    shown = search.with_products(found, B.catalog(spark, sf_dir, vectors=False), ["price", "vendor", "inventory"])
    ranked = rerank.assistant_rerank(shown, price_range=(910.0, 930.0), vendors=["Brand#2", "Brand#17", "Brand#23"])
    return ranked.select("query_id", "product_id", "similarity", "rank", "final_score", "final_rank")


_STAGES = {
    "max_price": "price <= 960",
    "min_price": "price >= 905",
    "tags": "list_has_any(tags, ['red', 'new', 'gear', 'bolt'])",
    "vendors": "vendor IN ('Brand#2', 'Brand#4', 'Brand#8', 'Brand#17')",
    "in_stock": "stock_quantity > 0",
}


def _funnel_sql() -> str:
    columns, passed = ["COUNT(*) AS original_count"], []
    for name, test in _STAGES.items():
        passed.append(test)
        columns.append(f"COUNT(*) FILTER ({' AND '.join(passed)}) AS after_{name}")
    return f"WITH {sql.CAT} SELECT shop_domain, {', '.join(columns)} FROM cat GROUP BY shop_domain"


@query(_funnel_sql())
def business_filter_funnel(spark, sf_dir):
    """Rows left per business filter stage and tenant, in one pass."""
    return rerank.filter_funnel(
        B.catalog(spark, sf_dir, vectors=False),
        ["shop_domain"],
        max_price=960.0,
        min_price=905.0,
        tags=["red", "new", "gear", "bolt"],
        vendors=["Brand#2", "Brand#4", "Brand#8", "Brand#17"],
    )


@query(
    f"""WITH {sql.CAT}
SELECT product_id, shop_domain, CAST(price AS DOUBLE) AS price, vendor FROM cat WHERE {' AND '.join(_STAGES.values())}"""
)
def business_filter(spark, sf_dir):
    kept = rerank.business_filter(
        B.catalog(spark, sf_dir, vectors=False),
        max_price=960.0,
        min_price=905.0,
        tags=["red", "new", "gear", "bolt"],
        vendors=["Brand#2", "Brand#4", "Brand#8", "Brand#17"],
    )
    return kept.select("product_id", "shop_domain", F.col("price").cast("double").alias("price"), "vendor")


@query(
    f"""WITH {sql.CAT}, anchors AS (
  SELECT shop_domain AS anchor_shop, arg_max(product_id, updated_at) AS anchor_id
  FROM cat WHERE embedding IS NOT NULL GROUP BY shop_domain
), scored AS (
  SELECT a.anchor_id, a.anchor_shop, c.product_id, c.shop_domain,
         round(list_cosine_similarity(c.embedding, s.embedding), 6) AS similarity
  FROM anchors a JOIN cat s ON s.product_id = a.anchor_id AND s.shop_domain = a.anchor_shop
  JOIN cat c ON c.shop_domain = a.anchor_shop
  WHERE c.available AND c.embedding IS NOT NULL AND c.product_id <> a.anchor_id
)
SELECT *, row_number() OVER w AS rank FROM scored
WINDOW w AS (PARTITION BY anchor_id, anchor_shop, shop_domain ORDER BY similarity DESC, product_id)
QUALIFY row_number() OVER w <= 10"""
)
def vec_similar_products(spark, sf_dir):
    """Neighbours, in its own store, of each tenant's newest embedded product."""
    catalog = B.catalog(spark, sf_dir)
    newest = (
        catalog.filter(P.has_embedding())
        .groupBy("shop_domain")
        .agg(F.max_by("product_id", "updated_at").alias("anchor_id"))
    )
    anchors = newest.select("anchor_id", F.col("shop_domain").alias("anchor_shop"), "shop_domain")
    return search.similar_products(catalog, anchors, k=10).select(
        "anchor_id", "anchor_shop", "product_id", "shop_domain", "similarity", "rank"
    )


_PARTIAL = "substr(title, 1, 4)"


@query(
    f"""WITH {sql.CAT}, partials AS (
  SELECT DISTINCT shop_domain || '/' || {_PARTIAL} AS query_id, shop_domain, upper({_PARTIAL}) AS partial FROM cat
), counted AS (SELECT shop_domain, title, COUNT(*) AS frequency FROM cat WHERE available GROUP BY 1, 2)
SELECT p.query_id, p.shop_domain, c.title, c.frequency,
       row_number() OVER (PARTITION BY p.query_id ORDER BY c.frequency DESC, c.title) AS rank
FROM counted c JOIN partials p ON p.shop_domain = c.shop_domain AND c.title ILIKE '%' || p.partial || '%'
QUALIFY rank <= 5"""
)
def title_suggestions(spark, sf_dir):
    """Suggestions for each tenant's title beginnings."""
    catalog = B.catalog(spark, sf_dir, vectors=False)
    start = F.substring("title", 1, 4)
    partials = catalog.select(
        F.concat_ws("/", "shop_domain", start).alias("query_id"), "shop_domain", F.upper(start).alias("partial")
    ).distinct()
    return search.suggestions(catalog, partials)


@query(
    f"""WITH {sql.CAT}, partials AS (
  SELECT DISTINCT shop_domain || '/' || m.mask || substr(title, 1, 3) AS query_id, shop_domain,
         CASE m.mask WHEN 'short' THEN substr(title, 1, 2) ELSE substr(title, 1, 1) || '_' || substr(title, 3, 1) || '%e' END AS partial
  FROM cat, (VALUES ('short'), ('wild')) m(mask)
), counted AS (SELECT shop_domain, title, COUNT(*) AS frequency FROM cat WHERE available GROUP BY 1, 2)
SELECT p.query_id, p.shop_domain, c.title, c.frequency,
       row_number() OVER (PARTITION BY p.query_id ORDER BY c.frequency DESC, c.title) AS rank
FROM counted c JOIN partials p ON p.shop_domain = c.shop_domain AND c.title ILIKE '%' || p.partial || '%'
QUALIFY rank <= 5"""
)
def title_suggestions_ranged(spark, sf_dir):
    """Two-letter and wildcard partials looked up in the sorted table of suffixes."""
    catalog = B.catalog(spark, sf_dir, vectors=False)
    letter = lambda i, n=1: F.substring("title", i, n)
    masks = F.explode(F.array(F.lit("short"), F.lit("wild")))
    wild = F.concat(letter(1), F.lit("_"), letter(3), F.lit("%e"))
    made = catalog.select("shop_domain", "title", masks.alias("mask")).select(
        F.concat("shop_domain", F.lit("/"), "mask", letter(1, 3)).alias("query_id"),
        "shop_domain",
        F.when(F.col("mask") == "short", letter(1, 2)).otherwise(wild).alias("partial"),
    )
    return search.suggestions(catalog, made.distinct(), max_broadcast_bytes=-1)


def _typed_terms() -> str:
    fixed = ", ".join(f"('{t}')" for t in seeds.SEARCH_TERMS)
    return f"SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part UNION SELECT * FROM (VALUES {fixed}) v(term)"


def _vocabulary(spark, sf_dir):
    fixed = spark.createDataFrame([(t,) for t in seeds.SEARCH_TERMS], "term string")
    return typos.vocabulary_from_titles(B.catalog(spark, sf_dir, vectors=False)).union(fixed).distinct()


_TYPO_SQL = f"""WITH RECURSIVE typed AS (SELECT conv_id, turn, text, {sql.words('text')} AS ws FROM conversations),
{sql.fuzzy('SELECT DISTINCT unnest(ws) AS token FROM typed', _typed_terms())},
placed AS (SELECT conv_id, turn, unnest(ws) AS token, unnest(range(1, len(ws) + 1)) AS pos FROM typed),
fixed AS (SELECT p.conv_id, p.turn, p.pos, COALESCE(f.best, p.token) AS word, COALESCE(f.best <> p.token, FALSE) AS changed
          FROM placed p LEFT JOIN fixes f USING (token)),
joined AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY pos) AS corrected, bool_or(changed) AS changed FROM fixed GROUP BY 1, 2)
SELECT t.conv_id, t.turn, md5(COALESCE(j.corrected, '')) AS corrected_md5, length(COALESCE(j.corrected, '')) AS corrected_length,
       COALESCE(j.changed, FALSE) AS was_corrected
FROM typed t LEFT JOIN joined j USING (conv_id, turn)"""


def _typo(spark, sf_dir, corrected):
    return corrected.select(
        "conv_id",
        "turn",
        F.md5("corrected_query").alias("corrected_md5"),
        F.length("corrected_query").alias("corrected_length"),
        "was_corrected",
    )


@query(_TYPO_SQL)
def typo_correct(spark, sf_dir):
    """Typo correction of every conversation text against titles and fixed terms."""
    texts = B.table(spark, sf_dir, "conversations").withColumn("query_id", F.concat_ws("/", "conv_id", "turn"))
    return _typo(spark, sf_dir, typos.correct_queries(texts, _vocabulary(spark, sf_dir), text="text"))


@query(
    f"""WITH RECURSIVE typed AS (SELECT {sql.words('text')} AS ws FROM conversations),
{sql.fuzzy('SELECT DISTINCT unnest(ws) AS token FROM typed', _typed_terms())}
SELECT token, best FROM fixes"""
)
def typo_matches_joined(spark, sf_dir):
    """Best term per distinct word through the join used for large vocabularies."""
    texts = B.table(spark, sf_dir, "conversations")
    tokens = texts.select(F.explode(typos.words(F.lower("text"))).alias("token")).filter(F.length("token") > 2).distinct()
    return typos.joined_matches(tokens, _vocabulary(spark, sf_dir))


# Configuration per tenant as bound in ``bindings.settings``.
_CONFIG_SQL = """
config AS (
  SELECT shop_domain, n,
         CASE WHEN n % 7 <> 6 THEN n % 10 <> 9 ELSE TRUE END AS ai_search_enabled,
         CASE WHEN n % 7 <> 6 THEN CASE WHEN n % 5 = 1 THEN 'unlimited' ELSE '8' END ELSE '10' END AS results_limit,
         CASE WHEN n % 7 <> 6 THEN 5.0::DOUBLE ELSE 70.0::DOUBLE END AS similarity_threshold,
         CASE WHEN n % 7 <> 6 THEN n % 2 = 0 ELSE FALSE END AS exclude_out_of_stock,
         CASE WHEN n % 7 <> 6 THEN n % 3 = 0 ELSE FALSE END AS exclude_archived
  FROM (SELECT DISTINCT shop_domain, CAST(replace(shop_domain, 'shop_', '') AS INTEGER) AS n FROM cat)
)"""

_REQUEST_SQL = f"""WITH {sql.CAT}, {sql.means("tit", "title")}, {_CONFIG_SQL},
sold AS (SELECT DISTINCT shop_domain, title FROM cat WHERE embedding IS NOT NULL),
asked AS (
  SELECT s.shop_domain || '/' || s.title AS query_id, s.shop_domain, s.title, tit.qvec, c.*EXCLUDE (shop_domain),
         CASE WHEN n % 3 <> 0 THEN 5 END AS max_results, CASE WHEN n % 4 = 0 THEN 915.0 END AS max_price,
         CASE WHEN results_limit = 'unlimited' THEN 1000
              WHEN n % 3 <> 0 THEN least(5, CAST(results_limit AS INTEGER)) ELSE CAST(results_limit AS INTEGER) END AS k
  FROM sold s JOIN tit USING (title) JOIN config c USING (shop_domain) WHERE ai_search_enabled
),
scored AS (
  SELECT a.query_id, a.title AS corrected_query, a.k, a.exclude_archived, c.product_id, c.shop_domain, c.title, c.price, c.vendor, c.category,
         c.handle, c.archived, md5(COALESCE(c.description, '-')) AS description_md5,
         round(list_cosine_similarity(c.embedding, a.qvec), 6) AS similarity, a.similarity_threshold
  FROM asked a JOIN cat c USING (shop_domain)
  WHERE c.embedding IS NOT NULL AND (a.max_price IS NULL OR c.price <= a.max_price) AND (NOT a.exclude_out_of_stock OR c.in_stock)
),
top AS (
  SELECT *, {RANKED} AS rank FROM scored WHERE similarity >= similarity_threshold / 100.0 QUALIFY {RANKED} <= k
),
shown AS (SELECT * FROM top WHERE NOT (exclude_archived AND archived))"""


def _answers(spark, sf_dir, archived_filter="post", descriptions=False, limits=None):
    catalog = B.catalog(spark, sf_dir, descriptions=descriptions)
    config = settings.tenant_config(B.settings(spark, sf_dir), catalog.select("shop_domain"))
    vectors = B.title_vectors(spark, sf_dir).withColumnRenamed("title", "corrected_query")
    return requests.answer(
        B.search_requests(spark, sf_dir),
        catalog,
        config,
        typos.vocabulary_from_titles(B.catalog(spark, sf_dir, vectors=False)),
        lambda rows: rows.join(vectors, "corrected_query"),
        limits=limits,
        archived_filter=archived_filter,
    )


_SHOWN_COLUMNS = """ SELECT query_id, shop_domain, corrected_query, rank, product_id AS id, title, CAST(price AS DOUBLE) AS price,
       vendor, category, handle, description_md5, similarity AS similarity_score FROM shown"""


def _shown(results):
    return results.withColumn("description_md5", F.md5(F.coalesce("description", F.lit("-")))).drop("description")


@query(_REQUEST_SQL + _SHOWN_COLUMNS)
def search_requests(spark, sf_dir):
    """Misspelt requests answered end to end under each tenant's configuration."""
    return _shown(_answers(spark, sf_dir, descriptions=True).results)


@query(
    _REQUEST_SQL.replace("WHERE similarity >= similarity_threshold / 100.0", "WHERE similarity >= similarity_threshold / 100.0 AND NOT (exclude_archived AND archived)")
    + _SHOWN_COLUMNS
)
def search_requests_pre(spark, sf_dir):
    """The same requests with archived products left out before the top-k."""
    return _shown(_answers(spark, sf_dir, archived_filter="pre", descriptions=True).results)


@query(
    f"""WITH {sql.CAT}, sold AS (SELECT DISTINCT shop_domain, title FROM cat WHERE embedding IS NOT NULL)
SELECT shop_domain || '/' || title AS query_id, shop_domain FROM sold WHERE CAST(replace(shop_domain, 'shop_', '') AS INTEGER) % 4 = 1"""
)
def search_limited(spark, sf_dir):
    """Requests turned away by their tenant's plan."""
    number = F.regexp_extract("shop_domain", r"(\d+)", 1).cast("int")
    shops = B.catalog(spark, sf_dir, vectors=False).select("shop_domain").distinct()
    limits = shops.select(F.col("shop_domain").alias("shop"), (number % 4 == 1).alias("searches_exceeded"))
    return _answers(spark, sf_dir, limits=limits).limited.select("query_id", "shop_domain")


@query(
    _REQUEST_SQL
    + """ SELECT a.query_id, a.shop_domain, a.title AS corrected_query, COALESCE(r.n, 0) AS results_count, a.k
FROM asked a LEFT JOIN (SELECT query_id, COUNT(*) AS n FROM shown GROUP BY 1) r USING (query_id)"""
)
def search_request_counts(spark, sf_dir):
    """Result counts per answered request, the input of the search event log."""
    counts = _answers(spark, sf_dir).counts
    return counts.select("query_id", "shop_domain", "corrected_query", F.col("results_count").cast("bigint").alias("results_count"), "k")


_QUALITY_SQL = f"""WITH {sql.CAT}, {sql.LABELS}, {sql.SHOP_LABELS}, scored AS (
  SELECT a.query_id, a.label AS wanted, c.product_id, c.shop_domain, c.label,
         round(list_cosine_similarity(c.embedding, a.qvec), 6) AS similarity
  FROM asked a JOIN cat c USING (shop_domain) WHERE c.embedding IS NOT NULL
),
top AS (SELECT * FROM scored QUALIFY {RANKED} <= 5),
returned AS (SELECT query_id, COUNT(*) AS returned, COUNT(*) FILTER (label = wanted) AS hits FROM top GROUP BY 1),
wanted AS (SELECT query_id, COUNT(*) AS expected FROM scored WHERE label = wanted GROUP BY 1),
metrics AS (
  SELECT query_id, returned, hits, expected, {sql.ratio('hits', 'returned', 4)} AS precision, {sql.ratio('hits', 'expected', 4)} AS recall
  FROM returned JOIN wanted USING (query_id)
)"""


def _quality(spark, sf_dir):
    catalog = B.catalog(spark, sf_dir)
    asked = B.shop_label_requests(spark, sf_dir)
    found = search.top_k(catalog, asked, k=5, by_tenant=True)
    expected = catalog.filter("label IS NOT NULL").select(
        F.concat_ws("/", "shop_domain", F.col("label").cast("string")).alias("query_id"), "product_id", "shop_domain"
    )
    return quality.quality_metrics(found, expected, asked)


@query(
    _QUALITY_SQL
    + """ SELECT *, CASE WHEN recall >= 0.8 THEN 'excellent' WHEN recall >= 0.5 THEN 'acceptable' ELSE 'improvable' END AS grade FROM metrics"""
)
def quality_metrics(spark, sf_dir):
    """Precision and recall at 5; a request expects the products of its label and tenant."""
    return _quality(spark, sf_dir)


@query(
    _QUALITY_SQL
    + f""" SELECT COUNT(*) AS queries, {sql.ratio('SUM(precision)', 'COUNT(*)', 4)} AS mean_precision,
       {sql.ratio('SUM(recall)', 'COUNT(*)', 4)} AS mean_recall FROM metrics"""
)
def quality_summary(spark, sf_dir):
    return quality.quality_summary(_quality(spark, sf_dir))


_IVF_SQL = f"""WITH {sql.CAT}, {sql.LABELS}, scored AS (
  SELECT 'label_' || CAST(l.label AS VARCHAR) AS query_id, c.product_id, c.shop_domain,
         round(list_cosine_similarity(c.embedding, l.qvec), 6) AS similarity
  FROM cat c, lab l WHERE c.embedding IS NOT NULL
)
SELECT *, {RANKED} AS rank FROM scored QUALIFY {RANKED} <= 10"""


@query(_IVF_SQL)
def ivf_exact_topk(spark, sf_dir):
    """Inverted-file search that also visits every bucket which could still matter."""
    index = ann.build_index(B.catalog(spark, sf_dir), lists=16)
    return ann.exact(index, B.label_requests(spark, sf_dir), k=10, probes=2).select(*COLUMNS)


@query(_IVF_SQL)
def ivf_probe_all(spark, sf_dir):
    """The approximate search with every bucket probed is the exact one."""
    index = ann.build_index(B.catalog(spark, sf_dir), lists=16)
    return ann.probe(index, B.label_requests(spark, sf_dir), k=10, probes=16).select(*COLUMNS)


@query()
def ivf_probe(spark, sf_dir):
    """Approximate inverted-file search in the nearest buckets."""
    index = ann.build_index(B.catalog(spark, sf_dir), lists=16)
    return ann.probe(index, B.label_requests(spark, sf_dir), k=10, probes=4).select(*COLUMNS)


def _every_fiftieth(spark, sf_dir):
    chosen = B.catalog(spark, sf_dir).filter("id % 50 = 0 AND embedding IS NOT NULL")
    return chosen.select(F.col("product_id").alias("query_id"), F.col("embedding").alias("qvec"))


_FIFTIETH = f"""WITH {sql.CAT}, scored AS (
  SELECT q.product_id AS query_id, c.product_id, c.shop_domain, round(list_cosine_similarity(c.embedding, q.embedding), 6) AS similarity
  FROM cat c, cat q WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL AND q.id % 50 = 0
), top AS (SELECT *, {RANKED} AS rank FROM scored QUALIFY {RANKED} <= 10)"""


@query(_FIFTIETH + " SELECT * FROM top")
def vec_topk_fiftieth(spark, sf_dir):
    """Exact neighbours of every fiftieth product."""
    return search.top_k(B.catalog(spark, sf_dir), _every_fiftieth(spark, sf_dir), k=10).select(*COLUMNS)


@query(_FIFTIETH + " SELECT * FROM top")
def pq_topk_all(spark, sf_dir):
    """The quantised search with all lists probed; as long as the shortlist holds all products it is the exact one."""
    index = pq.build(B.catalog(spark, sf_dir), lists=16, probes=16, shortlist=search.WINDOW_ROWS)
    return pq.top_k(index, _every_fiftieth(spark, sf_dir), k=10).select(*COLUMNS)


@query(_FIFTIETH + " SELECT COUNT(DISTINCT query_id) AS requests, COUNT(*) AS results, TRUE AS recall_reached FROM top")
def pq_recall(spark, sf_dir):
    """Every fiftieth product searched in a calibrated index: at least 90 % of the exact neighbours are found."""
    catalog = B.catalog(spark, sf_dir)
    index = pq.calibrated(pq.build(catalog), catalog)
    asked = _every_fiftieth(spark, sf_dir)
    found, exact = cut_lineage(pq.top_k(index, asked, k=10)), search.top_k(catalog, asked, k=10)
    reached = pq.recall(found, exact) >= 0.9
    counts = found.agg(F.countDistinct("query_id").alias("requests"), F.count(F.lit(1)).alias("results"))
    return counts.withColumn("recall_reached", F.lit(reached))


_TORN = "CASE WHEN id % 10 = 3 THEN list_slice(embedding, 1, 60) WHEN id % 10 = 7 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE embedding END"


def _torn(spark, sf_dir):
    """The catalogue with every tenth vector cut short and every tenth one zero."""
    torn = F.when(F.col("id") % 10 == 3, F.slice("embedding", 1, 60)).when(
        F.col("id") % 10 == 7, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    )
    return B.catalog(spark, sf_dir).withColumn("embedding", F.coalesce(torn, F.col("embedding")))


@query(
    f"""WITH {sql.CAT}, {sql.LABELS}, scored AS (
  SELECT 'label_' || CAST(l.label AS VARCHAR) AS query_id, c.product_id, c.shop_domain,
         round(list_cosine_similarity(c.embedding, l.qvec), 6) AS similarity
  FROM cat c, lab l WHERE c.embedding IS NOT NULL AND c.id % 10 NOT IN (3, 7)
)
SELECT *, {RANKED} AS rank FROM scored QUALIFY {RANKED} <= 15"""
)
def vec_topk_torn(spark, sf_dir):
    """A search that goes on past vectors of the wrong length and zero vectors."""
    return search.top_k(_torn(spark, sf_dir), B.label_requests(spark, sf_dir), k=15, dimension=64).select(*COLUMNS)


@query(
    f"""WITH {sql.CAT} SELECT product_id, shop_domain, len({_TORN}) AS length,
       CASE WHEN embedding IS NULL THEN 'missing' WHEN id % 10 = 3 THEN 'wrong_length' ELSE 'zero_vector' END AS reason
FROM cat WHERE embedding IS NULL OR id % 10 IN (3, 7)"""
)
def vec_misfits(spark, sf_dir):
    """The products that no search can find."""
    return search.misfits(_torn(spark, sf_dir), 64)


@query(_FIFTIETH + " SELECT COUNT(DISTINCT query_id) AS requests, COUNT(*) AS results, TRUE AS recall_reached FROM top")
def ivf_recall(spark, sf_dir):
    """Every fiftieth product searched in 14 of 16 buckets: at least 90 % of the exact neighbours are found."""
    catalog, asked = B.catalog(spark, sf_dir), _every_fiftieth(spark, sf_dir)
    found = cut_lineage(ann.probe(ann.build_index(catalog, lists=16), asked, k=10, probes=14))
    reached = pq.recall(found, search.top_k(catalog, asked, k=10)) >= 0.9
    counts = found.agg(F.countDistinct("query_id").alias("requests"), F.count(F.lit(1)).alias("results"))
    return counts.withColumn("recall_reached", F.lit(reached))
