"""SQL fragments shared by the oracles: the bound tables as common table expressions."""

from __future__ import annotations

from vitrine.sources import seeds


def ratio(total: str, count: str, places: int = 2) -> str:
    quotient = f"CAST({total} AS DOUBLE) / NULLIF(CAST({count} AS DOUBLE), 0)"
    return f"COALESCE(CAST(CAST(CAST({quotient} AS DECIMAL(28,10)) AS DECIMAL(20,{places})) AS DOUBLE), 0.0)"


def average(value: str, places: int = 2) -> str:
    return ratio(f"SUM(COALESCE({value}, 0))", "COUNT(*)", places)


def moment(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S.%f')"


def day(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d')"


CAT = """
cat AS (
  SELECT CAST(p.p_partkey AS VARCHAR) AS product_id,
         'shop_' || CAST(p.p_partkey % 20 AS VARCHAR) AS shop_domain,
         p.p_name AS title, d.text AS description,
         CAST(p.p_retailprice AS DECIMAL(10,2)) AS price,
         p.p_brand AS vendor, p.p_type AS category, string_split(p.p_name, ' ') AS tags,
         CAST(e.embedding AS DOUBLE[]) AS embedding, e.label,
         p.p_size > 10 AS in_stock, greatest(p.p_size - 10, 0) AS stock_quantity,
         p.p_size BETWEEN 20 AND 23 AS archived, p.p_size >= 45 AS needs_resync,
         lower(replace(p.p_name, ' ', '-')) AS handle,
         TIMESTAMP '2024-01-01' AS created_at,
         TIMESTAMP '2024-01-01' + to_seconds(p.p_partkey) AS updated_at,
         p.p_partkey AS id,
         CAST(CAST(p.p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS price_min,
         CAST(CAST(p.p_retailprice AS DECIMAL(10,2)) AS DOUBLE) + p.p_size AS price_max,
         p.p_size % 10 <> 0 AS available,
         greatest(p.p_size - 10, 0) AS inventory_quantity,
         CAST(p.p_size % 7 AS DOUBLE) AS popularity_score,
         p.p_size AS size
  FROM part p
  LEFT JOIN embeddings e ON e.vec_id = p.p_partkey
  LEFT JOIN documents d ON d.doc_id = p.p_partkey
)"""


def means(name: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT {key}, list(m ORDER BY i) AS qvec
  FROM (SELECT {key}, i, avg(v) AS m
        FROM (SELECT {key}, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i
              FROM cat WHERE embedding IS NOT NULL)
        GROUP BY 1, 2)
  GROUP BY 1
)"""


LABELS = means("lab", "label")

SHOP_LABELS = """
asked AS (
  SELECT s.shop_domain || '/' || CAST(s.label AS VARCHAR) AS query_id, s.shop_domain, s.label, lab.qvec
  FROM (SELECT DISTINCT shop_domain, label FROM cat WHERE label IS NOT NULL) s JOIN lab USING (label)
)"""

SEARCHES = """
searches AS (
  SELECT event_id AS id, event_type || ' ' || CAST(k AS VARCHAR) AS query,
         CASE WHEN k % 10 <> 0 THEN k % 7 END AS results_count,
         CASE WHEN event_type = 'click' THEN CAST(k AS VARCHAR) END AS clicked_product_id,
         CASE WHEN event_type = 'click' THEN k % 10 + 1 END AS clicked_position,
         CASE WHEN event_type = 'click' THEN CAST(floor(value * 100) AS BIGINT) END AS time_to_click_ms,
         CAST(user_id AS VARCHAR) AS session_id,
         'shop_' || CAST(user_id % 20 AS VARCHAR) AS shop_domain, ts AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def _plan_rows(extra: list[tuple]) -> str:
    rows = [
        f"({i}, '{name}', CAST({price} AS DECIMAL(10,2)), {products}, {searches}, TRUE)"
        for i, (name, price, products, searches) in enumerate(seeds.PLAN_ROWS + extra, start=1)
    ]
    return ", ".join(rows)


def plans(extra: list[tuple] | None = None) -> str:
    columns = "id, name, price, max_products, max_searches, active"
    return f"plans AS (SELECT * FROM (VALUES {_plan_rows(extra or [])}) v({columns}))"


def subscriptions(plan_of_segment: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{segment}' THEN {number}" for segment, number in plan_of_segment.items())
    return f"""
subs AS (
  SELECT 'shop_' || CAST(c_custkey AS VARCHAR) AS shop_domain,
         CASE c_mktsegment {cases} END AS plan_id,
         c_custkey % 400 AS searches_this_month,
         DATE '2024-01-01' + CAST(c_custkey % 45 - 15 AS INTEGER) AS search_reset_date,
         DATE '2024-01-01' + CAST(c_custkey % 45 - 15 AS INTEGER) AS billing_cycle_start,
         CASE WHEN c_custkey % 6 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 45 + 15 AS INTEGER) END AS billing_cycle_end
  FROM customer
)"""


USAGE = """
usage AS (
  SELECT shop_domain, 'search' AS usage_type, CAST(created_at AS DATE) AS usage_date, COUNT(*) AS usage_count
  FROM searches GROUP BY 1, 2, 3
)"""

INCOMING = """
base AS (
  SELECT shop_domain, product_id,
         CASE WHEN id % 11 = 0 THEN upper(title) ELSE title END AS title, description,
         price + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS price,
         vendor, category, tags, inventory_quantity AS qty, id AS ordinal
  FROM cat
),
incoming AS (
  SELECT * FROM base
  UNION ALL
  SELECT shop_domain, 'new_' || product_id, title, description, price, vendor, category, tags, qty, ordinal + 1000000000
  FROM base WHERE qty = 0
  UNION ALL
  SELECT shop_domain, product_id, title, description, price + 2, vendor, category, tags, qty, ordinal + 2000000000
  FROM base WHERE qty = 5
),
latest AS (
  SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY shop_domain, product_id ORDER BY ordinal DESC) = 1
)"""

# Word splitting and trimming classes: the white space found in the texts.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_html(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '<[^>]*>', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')"


def fuzzy(tokens: str, terms: str) -> str:
    """Expressions ``fixes(token, best)`` from a token and a term query, threshold 75.

    The longest common subsequence is the textbook table, a row per step.
    """
    return f"""
tok AS ({tokens}),
voc AS ({terms}),
pairs AS (
  SELECT token, term FROM tok, voc
  WHERE length(token) > 2 AND 200 * least(length(token), length(term)) >= 75 * (length(token) + length(term))
),
dp(token, term, pos, r) AS (
  SELECT token, term, 0, list_transform(range(0, length(term) + 1), lambda i: 0) FROM pairs
  UNION ALL
  SELECT token, term, pos + 1,
         list_prepend(0, list_transform(range(1, length(term) + 1), lambda j:
           list_max(list_transform(range(1, j + 1), lambda i:
             greatest(r[i + 1], r[i] + CASE WHEN substr(term, i, 1) = substr(token, pos + 1, 1) THEN 1 ELSE 0 END)))))
  FROM dp WHERE pos < length(token)
),
fixes AS (
  SELECT token, term AS best
  FROM (SELECT token, term, 200 * r[length(term) + 1] AS hits, length(token) + length(term) AS total
        FROM dp WHERE pos = length(token))
  WHERE hits >= 75 * total
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY CAST(hits AS DOUBLE) / total DESC, term) = 1
)"""


def words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{SPACE}+'), lambda w: w <> '')"


def embedded(texts: str, keys: str, dim: int = 64) -> str:
    """Expressions ``vectors(keys, vector)`` from a query of keys and ``text``: each word counts, by the
    sign of its hash, in the dimension of its hash; lengths are one; entries are millionths."""
    number = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
    return f"""
texts AS ({texts}),
hashed AS (
  SELECT {keys}, {number.format('w')} AS h FROM (SELECT {keys}, unnest({words('text')}) AS w FROM texts)),
sums AS (
  SELECT {keys}, h % {dim} AS d, SUM(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS s FROM hashed GROUP BY ALL),
norms AS (
  SELECT {keys}, sqrt(CAST(SUM(s * s) AS DOUBLE)) AS norm, list(d ORDER BY d) AS ds, list(CAST(s AS DOUBLE) ORDER BY d) AS ss FROM sums GROUP BY {keys}),
vectors AS (
  SELECT {keys}, array_to_string(list_transform(range({dim}), lambda i: CAST(round(CAST(CAST(
    CASE WHEN norm > 0 THEN COALESCE(ss[list_position(ds, i)], 0) / norm
         ELSE CASE WHEN {number.format('text')} % {dim} = i THEN 1.0 ELSE 0.0 END END AS FLOAT) AS DOUBLE) * 1000000) AS BIGINT)), ',') AS vector
  FROM texts LEFT JOIN norms USING ({keys}) WHERE norm IS NOT NULL)"""
