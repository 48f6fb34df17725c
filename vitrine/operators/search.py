"""Exact cosine top-k for a table of search requests.

The scoring never emits (request, product) pairs: each task multiplies blocks
of vectors and keeps only the best rows per request; a window over these
partial results gives the answer. Requests small enough to be checked and
broadcast go to the catalogue as it lies; more requests than that are scored
cell by cell, where a cell is a block of one tenant's (or bucket's) products
and a block of its requests, so no group outgrows a task.

Contract: a similarity is rounded to six decimals before it is compared or
ranked; equal similarities are ordered by product id, then tenant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import sizing, skew
from vitrine.functions.vectors import SIMILARITY_PLACES
from vitrine.operators import suffixes
from vitrine.sources import seeds
from vitrine.session import cut_lineage

MAX_BROADCAST_REQUESTS = 16384
MAX_BROADCAST_BYTES = 64 << 20
NO_LIMIT = (1 << 31) - 1
UNLIMITED_RESULTS = 1000
RANK_PARTS = 64
BLOCK_PRODUCTS = 16384
# A product's vector is sent once per block of requests, so blocks are as large as a task can hold.
BLOCK_REQUEST_BYTES = 64 << 20
# Scores computed at once in a task (32 MB of doubles).
SCORES_AT_ONCE = 4 << 20
# Rows that a task gathers before it cuts them to the best ones; the largest k ranked by a window.
GATHERED_ROWS = 1 << 18
WINDOW_ROWS = 10_000
MAX_PUSHED_TENANTS = 1000
MAX_DIRECT_PARTIALS = 1000

_OPTIONAL = {
    "shop_domain": "string",
    "k": "int",
    "min_similarity": "double",
    "min_price": "double",
    "max_price": "double",
    "in_stock_only": "boolean",
}
_PRODUCT_FIELDS = {"product_id": "string", "shop_domain": "string", "price": "double", "in_stock": "boolean"}


def effective_limit(config_limit: Column, requested: Column, unlimited: int | None = UNLIMITED_RESULTS) -> Column:
    """``unlimited`` means 1000 whatever was requested (None: no limit at all); else the
    smaller of both; a request of NULL or 0 takes the configured limit. A configured
    limit that is no number counts as the default one."""
    configured = F.coalesce(config_limit.try_cast("int"), F.lit(int(seeds.DEFAULT_CONFIG["results_limit"])))
    return (
        F.when(config_limit == "unlimited", F.lit(NO_LIMIT if unlimited is None else unlimited))
        .when(F.coalesce(requested, F.lit(0)) == 0, configured)
        .otherwise(F.least(requested, configured))
        .cast("int")
    )


def threshold_fraction(percent: Column) -> Column:
    return percent.cast("double") / F.lit(100.0)


class _Requests:
    """Requests of one block as arrays; absent bounds are NaN."""

    def __init__(self, table: pa.Table, group: str | None):
        columns = {name: table.column(name) for name in table.column_names}
        self.ids = columns["query_id"].to_pylist()
        vectors = columns["qvec"].combine_chunks()
        dim = len(vectors[0]) if len(vectors) else 0
        self.vectors = _unit(_matrix(vectors, dim))
        self.groups = columns[group].to_pylist() if group else []
        self.k = np.array([NO_LIMIT if v is None else v for v in columns["k"].to_pylist()], dtype=np.int64)
        self.floor = _floats(columns["min_similarity"])
        self.low = _floats(columns["min_price"])
        self.high = _floats(columns["max_price"])
        self.stock = np.array([bool(v) for v in columns["in_stock_only"].to_pylist()], dtype=bool)


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in column.to_pylist()], dtype=np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN and never matches."""
    if vectors.size == 0:
        return vectors
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if not len(lengths):
        return np.empty((0, dim))
    if not (lengths == dim).all():
        raise ValueError(f"embedding length differs from the request vectors' {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


class _BestRows:
    """Running best rows per request while batches of products pass by. With a
    ``group`` column a request meets only the products of its own group.

    Rows are columns throughout: what a batch adds is appended, and sorted in and cut
    to each request's k whenever enough has gathered. Rows of requests without a k are
    handed on at once, so the state never holds all passing products."""

    def __init__(self, requests: _Requests, group: str | None, schema: pa.Schema):
        self.requests, self.schema = requests, schema
        self.cut = np.full(len(requests.ids), -np.inf)
        groups = np.array(requests.groups, dtype=object)
        self.members = {name: np.flatnonzero(groups == name) for name in set(requests.groups)}
        self.group = group
        self.unlimited = requests.k >= NO_LIMIT
        self.names = pa.array(requests.ids, schema.field("query_id").type)
        self.kept, self.added, self.gathered = None, [], 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows == 0 or not self.requests.ids:
            return
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        vectors = _unit(_matrix(column["embedding"], self.requests.vectors.shape[1]))
        price = column["price"].to_numpy(zero_copy_only=False).astype(np.float64)
        stock = np.array(column["in_stock"].to_numpy(zero_copy_only=False), dtype=bool)

        def score(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
            return np.round(vectors[rows] @ self.requests.vectors[asked].T, SIMILARITY_PLACES)

        if self.group is None:
            yield from self._score_in_parts(column, score, price, stock, np.arange(batch.num_rows), np.arange(len(self.cut)))
            return
        codes = column[self.group].dictionary_encode()
        names = codes.dictionary.to_pylist()
        index = codes.indices.to_numpy(zero_copy_only=False)
        for code, name in enumerate(names):
            asked = self.members.get(name)
            if asked is not None:
                yield from self._score_in_parts(column, score, price, stock, np.flatnonzero(index == code), asked)

    def _score_in_parts(self, column, score, price, stock, rows, asked) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES_AT_ONCE // max(1, len(asked)))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            with np.errstate(invalid="ignore"):
                self._keep(column, score(part, asked), price, stock, part, asked)
            if self.gathered >= GATHERED_ROWS:
                yield from self._settle()

    def _allowed(self, price, stock, rows, asked) -> np.ndarray:
        """Which rows (down) are in the price range and stock that requests (across) ask for."""
        want, cost = self.requests, price[rows][:, None]
        with np.errstate(invalid="ignore"):
            allowed = (np.isnan(want.high[asked]) | (cost <= want.high[asked])) & (
                np.isnan(want.low[asked]) | (cost >= want.low[asked])
            )
        allowed &= stock[rows][:, None] | ~want.stock[asked]
        return allowed

    def _keep(self, column, scores, price, stock, rows, asked) -> None:
        with np.errstate(invalid="ignore"):
            floor = self.requests.floor[asked]
            allowed = self._allowed(price, stock, rows, asked)
            allowed &= ~np.isnan(scores) & (np.isnan(floor) | (scores >= floor))
        scores[~allowed] = -np.inf
        most = int(self.requests.k[asked].max())
        if most < 1:
            return
        bar = self.cut[asked]
        if len(rows) > most:
            bar = np.maximum(bar, np.partition(scores, len(rows) - most, axis=0)[len(rows) - most])
        at, request = np.nonzero((scores >= bar) & (scores > -np.inf))
        if len(at):
            picked = pa.array(rows[at])
            self._append(asked[request], scores[at, request], column["product_id"].take(picked), column["shop_domain"].take(picked))

    def _append(self, request: np.ndarray, scores: np.ndarray, ids: pa.Array, shops: pa.Array) -> None:
        columns = [pa.array(request, pa.int64()), pa.array(scores, pa.float64()), ids.cast(pa.string()), shops.cast(pa.string())]
        self.added.append(pa.Table.from_arrays(columns, _STATE))
        self.gathered += len(request)

    def _settle(self) -> Iterator[pa.RecordBatch]:
        """Cut the state to the best rows; hand on those of requests without a k."""
        if not self.added:
            return
        rows = pa.concat_tables([self.kept, *self.added] if self.kept is not None else self.added)
        self.added, self.gathered = [], 0
        free = self.unlimited[rows["request"].to_numpy()]
        if free.any():
            yield from self._named(rows.filter(pa.array(free)))
            rows = rows.filter(pa.array(~free))
        order = [("request", "ascending"), ("similarity", "descending"), ("product_id", "ascending"), ("shop_domain", "ascending")]
        rows = rows.take(pc.sort_indices(rows, order, null_placement="at_start")).combine_chunks()
        request = rows["request"].to_numpy()
        place = np.arange(len(request)) - np.searchsorted(request, request)
        k = self.requests.k[request]
        full = place == k - 1
        self.cut[request[full]] = rows["similarity"].to_numpy()[full]
        self.kept = rows.filter(pa.array(place < k))

    def _named(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        request = rows["request"].to_numpy()
        columns = [self.names.take(pa.array(request)), pa.array(self.requests.k[request].astype(np.int32))]
        columns += [rows["product_id"], rows["shop_domain"], rows["similarity"]]
        yield from pa.Table.from_arrays(columns, schema=self.schema).to_batches()

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self._settle()
        if self.kept is not None:
            yield from self._named(self.kept)


_STATE = ["request", "similarity", "product_id", "shop_domain"]


def _products(catalog: DataFrame) -> DataFrame:
    """Only what scoring needs; absent price and stock columns count as NULL and true."""
    present = set(catalog.columns)
    defaults = {"price": F.lit(None).cast("double"), "in_stock": F.lit(True)}
    chosen = [
        (F.col(name) if name in present else defaults[name]).cast(kind).alias(name)
        for name, kind in _PRODUCT_FIELDS.items()
    ]
    extra = [F.col(name) for name in ("cell",) if name in present]
    rows = catalog.filter(F.col("embedding").isNotNull())
    return rows.select(*chosen, *extra, "embedding").withColumn("in_stock", F.coalesce("in_stock", F.lit(False)))


def _requests(queries: DataFrame, k: int | None) -> DataFrame:
    present = set(queries.columns)
    columns = [F.col("query_id")]
    for name, kind in _OPTIONAL.items():
        source = F.col(name) if name in present else F.lit(k if name == "k" else None)
        columns.append(source.cast(kind).alias(name))
    columns += [F.col(name) for name in ("cell",) if name in present]
    return queries.filter(F.col("qvec").isNotNull()).select(*columns, F.col("qvec").cast("array<double>").alias("qvec"))


def _result_schema(queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("k", T.IntegerType()),
            T.StructField("product_id", T.StringType()),
            T.StructField("shop_domain", T.StringType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _order() -> list[Column]:
    return [F.desc("similarity"), F.col("product_id"), F.asc_nulls_first("shop_domain")]


def final_rank(partial: DataFrame, most: int | None = None) -> DataFrame:
    """Best ``k`` rows per request out of partial results; adds ``rank``. ``most`` is the
    largest k, if known; a small one is applied before the shuffle, and where it is
    large, or there is none, requests are ranked without a window (``total_rank``).

    Each task of the scan hands in up to k rows per request, so a request's rows
    are ranked in parts first and only ``RANK_PARTS`` times k of them meet."""
    if most is not None and most > WINDOW_ROWS:
        return total_rank(partial).filter("rank <= k").drop("k")
    most = NO_LIMIT if most is None else most
    part = F.pmod(F.xxhash64("product_id", "shop_domain"), F.lit(RANK_PARTS))
    within = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*_order()))
    short = partial.withColumn("part", part).withColumn("rank", within).filter(f"rank <= k AND rank <= {most}").drop("rank", "part")
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order())))
    return ranked.filter(f"rank <= k AND rank <= {most}").drop("k")


def total_rank(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` per request, however many rows a request has."""
    return ranked_within(rows, ["query_id"], _order(), "rank").withColumn("rank", F.col("rank").cast("int"))


def ranked_within(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds each row's place, from 1, within its group, of which no task needs to hold all.

    Rows are sorted by range of group and order, so a group may lie in many
    tasks. Each numbers its own rows; a group's numbers start, in every task, after
    the rows that the tasks before hold of it. Only these counts meet per group.
    """
    fields = [*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField(name, T.LongType())]
    at = [rows.columns.index(c) for c in group]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            new = np.zeros(size, bool)
            for column in (batch.column(i) for i in at):
                same = pc.fill_null(pc.equal(column.slice(1), column.slice(0, size - 1)), False)
                nulls = column.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= ~(same.to_numpy(zero_copy_only=False) | (nulls[1:] & nulls[:-1]))
            first = [batch.column(i)[0].as_py() for i in at]
            new[0] = True
            begin = np.flatnonzero(new)
            starts = np.repeat(begin, np.diff(np.append(begin, size)))
            places = np.arange(size) - starts + 1
            if first == last:
                places[: begin[1] if len(begin) > 1 else size] += carried
            last, carried = [batch.column(i)[size - 1].as_py() for i in at], int(places[-1])
            columns = [*batch.columns, pa.array(np.full(size, part, np.int32)), pa.array(places)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", name])

    ordered = [*(F.col(c) for c in group), *order]
    placed = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    numbered = cut_lineage(placed.mapInArrow(number, T.StructType(fields)))
    counts = numbered.groupBy(*group, "_part").agg(F.max(name).alias("rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"))
    # NULL groups have a place too.
    left, right = numbered.alias("l"), sizing.small_side(offsets).alias("r")
    same_group = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in [*group, "_part"]]
    ranked = left.join(right, same_group)
    return ranked.select(*[F.col(f"l.`{c}`") for c in rows.columns], (F.col(f"l.`{name}`") + F.col("r._before")).alias(name))


def _group(by_tenant: bool) -> str | None:
    return "shop_domain" if by_tenant else None


def small_block(requests: DataFrame, most: int = MAX_BROADCAST_REQUESTS) -> tuple[pa.Table | None, int]:
    """The requests, if they are few and small enough to be sent to all tasks, and the largest k."""
    width, largest = F.size("qvec") * 8 + 128, F.max(F.coalesce("k", F.lit(NO_LIMIT)))
    facts = requests.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"), largest.alias("k")).first()
    small = facts["rows"] <= most and facts["bytes"] <= MAX_BROADCAST_BYTES
    return (requests.toArrow() if small else None), facts["k"] or 0


def broadcast_partials(products: DataFrame, requests: DataFrame, block: pa.Table, group: str | None) -> DataFrame:
    schema = _result_schema(requests)
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])
    shared = products.sparkSession.sparkContext.broadcast(block)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _BestRows(_Requests(shared.value, group), group, arrow_schema)
        for batch in batches:
            yield from kept.add(batch)
        yield from kept.finish()

    if group == "shop_domain":
        shops = sorted({s for s in block.column("shop_domain").to_pylist() if s is not None})
        if len(shops) <= MAX_PUSHED_TENANTS:
            products = products.filter(F.col("shop_domain").isin(shops))
    return products.mapInArrow(best, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {
        T.StringType(): pa.string(),
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
    }[kind]


def blocked_partials(
    products: DataFrame,
    requests: DataFrame,
    by_tenant: bool,
    block_products: int = BLOCK_PRODUCTS,
    block_requests: int | None = None,
) -> DataFrame:
    """Partial results cell by cell, for any number of products and requests.

    Rows of a cell are dealt to blocks by hash, the number of blocks following
    from the cell's size; a hot tenant or bucket thus becomes many groups. Blocks of
    requests hold about ``BLOCK_REQUEST_BYTES`` of vectors unless their size is given.
    """
    if block_requests is None:
        width = requests.agg(F.coalesce(F.max(F.size("qvec")), F.lit(1)).alias("width")).first()["width"]
        block_requests = max(1, BLOCK_REQUEST_BYTES // (8 * max(1, width)))

    def blocks(block: int) -> Column:
        return F.ceil(F.col("count") / F.lit(block)).cast("bigint")

    product_counts = products.groupBy("cell").count()
    request_counts = requests.groupBy("cell").count()
    sizes, small = sizing.settle(
        product_counts.select("cell", blocks(block_products).alias("p_blocks")).join(
            request_counts.select("cell", blocks(block_requests).alias("q_blocks")), "cell"
        )
    )

    def deal(rows: DataFrame, spread: list[str], counts: DataFrame) -> DataFrame:
        if small:
            return rows.join(F.broadcast(sizes), "cell")
        return skew.join(rows, sizes, ["cell"], "inner", spread=spread, counts=counts)

    schema, group = _result_schema(requests), _group(by_tenant)
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])
    zero = F.lit(0).cast("bigint")
    dealt_products = (
        deal(products, ["product_id", "shop_domain"], product_counts)
        .withColumn("p_block", F.pmod(F.xxhash64("product_id", "shop_domain"), F.col("p_blocks")))
        .withColumn("q_block", F.explode(F.sequence(zero, F.col("q_blocks") - 1)))
    )
    dealt_requests = (
        deal(requests, ["query_id"], request_counts)
        .withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")))
        .withColumn("p_block", F.explode(F.sequence(zero, F.col("p_blocks") - 1)))
    )

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = _BestRows(_Requests(right, group), group, arrow_schema)
        found = [rows for batch in left.to_batches() for rows in kept.add(batch)]
        return pa.Table.from_batches([*found, *kept.finish()], arrow_schema)

    keys = ["cell", "p_block", "q_block"]
    grouped = dealt_products.drop("p_blocks", "q_blocks").groupBy(*keys)
    asked = dealt_requests.drop("p_blocks", "q_blocks").groupBy(*keys)
    return grouped.cogroup(asked).applyInArrow(best, schema)


def top_k(
    catalog: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    by_tenant: bool = False,
    max_broadcast: int = MAX_BROADCAST_REQUESTS,
    dimension: int | None = None,
) -> DataFrame:
    """Best products per request: ``query_id, product_id, shop_domain, similarity, rank``.

    ``catalog`` has ``product_id, shop_domain, embedding`` and optionally
    ``price, in_stock``. ``queries`` has ``query_id, qvec`` and optionally
    ``shop_domain, k, min_similarity, min_price, max_price, in_stock_only``.
    With ``by_tenant`` a request sees only its own tenant's products. Without a
    ``k`` a request gets every product that passes. A product whose vector has another
    length than the requests' ends the search, unless ``dimension`` says how long vectors
    are: then such products are left out (``misfits`` lists them).
    """
    products = _products(catalog)
    if dimension is not None:
        products = products.filter(F.size("embedding") == dimension)
    requests = _requests(queries, k)
    requests = cut_lineage(requests)
    head, largest = small_block(requests, max_broadcast)
    if head is not None:
        partial = broadcast_partials(products, requests, head, _group(by_tenant))
    else:
        cell = F.col("shop_domain") if by_tenant else F.lit("all")
        partial = blocked_partials(products.withColumn("cell", cell), requests.withColumn("cell", cell), by_tenant)
    return final_rank(partial, largest)


def misfits(catalog: DataFrame, dimension: int) -> DataFrame:
    """Products that no search can find, and why: ``product_id, shop_domain, length, reason``."""
    length = F.size("embedding")
    zero = ~F.exists("embedding", lambda x: x != 0)
    reason = F.when(F.col("embedding").isNull(), "missing").when(length != dimension, "wrong_length").when(zero, "zero_vector")
    found = catalog.select("product_id", "shop_domain", F.when(F.col("embedding").isNotNull(), length).alias("length"), reason.alias("reason"))
    return found.filter("reason IS NOT NULL")


def with_products(results: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Attach display columns after the ranking, so scoring reads none of them.

    The results are computed first and, small as they usually are, broadcast to
    the catalogue's display columns.
    """
    keys = ["product_id", "shop_domain"]
    shown = catalog.select(*keys, *[c for c in columns if c not in keys])
    return shown.join(sizing.small_side(results), keys)


def similar_products(catalog: DataFrame, anchors: DataFrame, k: int = 10) -> DataFrame:
    """Nearest available products of a store for each anchor, the anchor left out.

    ``anchors`` has ``anchor_id, anchor_shop, shop_domain``: the product, its
    tenant, and the tenant searched. One row more than asked is kept because
    the anchor may be among its own neighbours. Products without a vector are
    not neighbours.
    """
    source = catalog.select(
        F.col("product_id").alias("anchor_id"), F.col("shop_domain").alias("anchor_shop"), F.col("embedding").alias("qvec")
    )
    asked = source.join(sizing.small_side(anchors), ["anchor_id", "anchor_shop"])
    asked = asked.withColumn("query_id", F.concat_ws("\u0001", "anchor_id", "anchor_shop", "shop_domain"))
    shown = catalog.filter("available")
    found = top_k(shown, asked, k=k + 1, by_tenant=True)
    parts = F.split("query_id", "\u0001")
    named = found.select(
        parts[0].alias("anchor_id"), parts[1].alias("anchor_shop"), "product_id", "shop_domain", "similarity"
    )
    other = ~((F.col("product_id") == F.col("anchor_id")) & (F.col("shop_domain") == F.col("anchor_shop")))
    order = Window.partitionBy("anchor_id", "anchor_shop", "shop_domain").orderBy(F.desc("similarity"), "product_id")
    return named.filter(other).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def suggestions(
    catalog: DataFrame,
    partials: DataFrame,
    limit: int = 5,
    direct_per_tenant: int = MAX_DIRECT_PARTIALS,
    max_broadcast_bytes: int = sizing.MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Titles containing a partial query, most frequent first, per request.

    ``partials`` has ``query_id, shop_domain, partial``; ``%`` and ``_`` in a
    partial are wildcards. Titles are counted per tenant before they meet the
    requests. Where a tenant has more than ``direct_per_tenant`` partials, its
    titles are not tried one by one: a title can only contain a partial if it
    contains the partial's rarest three letters, and those are joined on.
    Partials too short for that, or with wildcards, are sent to the titles, which stay where
    they lie, or, if they are too many, look their ranges up in a table of suffixes.
    """
    counted = catalog.filter("available").groupBy("shop_domain", "title").agg(F.count(F.lit(1)).alias("frequency"))
    asked = partials.select("query_id", "shop_domain", "partial")
    busy = sizing.small_side(
        asked.groupBy("shop_domain").count().filter(F.col("count") > direct_per_tenant).select("shop_domain")
    )
    plain = (F.length("partial") >= 3) & ~F.col("partial").rlike(r"[%_\\]")
    many = asked.join(busy, "shop_domain", "left_semi").filter(plain)
    few, small = sizing.settle(asked.join(many.select("query_id"), "query_id", "left_anti"), max_broadcast_bytes)
    contains = F.ilike("title", F.concat(F.lit("%"), F.col("partial"), F.lit("%")))
    columns = ["query_id", "shop_domain", "title", "frequency"]
    if small:
        matched = counted.join(F.broadcast(few), "shop_domain").filter(contains).select(*columns)
    else:
        matched = suffixes.best_titles(counted, few, limit).select(*columns)
    if not many.isEmpty():
        matched = matched.unionByName(_by_rarest_letters(counted, many).filter(contains).select(*columns))
    order = Window.partitionBy("query_id").orderBy(F.desc("frequency"), "title")
    ranked = matched.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select(*columns, "rank")


def _by_rarest_letters(counted: DataFrame, partials: DataFrame) -> DataFrame:
    """Pairs of title and partial that share the partial's rarest three letters."""

    def letters(text: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), 1))

    keys = ["shop_domain", "letters"]
    titles = counted.withColumn("letters", F.explode(letters("title")))
    counts = titles.groupBy(*keys).count()
    candidates = partials.withColumn("letters", F.explode(letters("partial"))).join(counts, keys)
    rarest = candidates.groupBy("query_id", "shop_domain", "partial").agg(F.min_by("letters", "count").alias("letters"))
    return skew.join(titles, rarest, keys, "inner", spread=["title"], counts=counts)
