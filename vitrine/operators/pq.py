"""Approximate search by product quantisation of residuals in inverted lists.

A product's unit vector is kept as the list of its nearest centroid and one byte
per sub-space: the nearest entry of a codebook for what the centroid leaves over.
A product is estimated as the sum of both. Each request reads its nearest lists,
keeps a shortlist by its inner products with the estimates, and has the shortlist
scored exactly. (Summing table entries per request and byte gives the same
estimates, but in numpy takes some eight times as long as multiplying the
estimated vectors, which a list's requests share.) The search reads the lists
twice: tasks first count estimates by bins, which gives the least estimate on each
request's shortlist, then score what reaches it, keeping k rows per request. So no
task holds a shortlist, and none is shuffled.

Centroids and codebooks are trained on a bounded sample; every product is
encoded. How many lists and how long a shortlist reach a wanted recall is
measured (``calibrated``) against the exact search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import sizing
from vitrine.functions.vectors import SIMILARITY_PLACES
from vitrine.operators import search
from vitrine.session import cut_lineage, fresh_dir

# Vectors that centroids and codebooks are trained on, and requests that the recall is measured with, at most.
TRAIN_ROWS, MEASURE_ROWS = 16384, 256
CODES = 256
ROUNDS = 12
KEYS = ["product_id", "shop_domain"]
# Requests searched at once, and bins that their estimates, between -REACH and REACH, are counted in.
BLOCK_REQUESTS, BINS, REACH = 4096, 1024, 1.25
# Numbers of vectors gathered at once; where more than one pair in DENSE is shortlisted, all are multiplied.
GATHERED_AT_ONCE, DENSE = 1 << 21, 16


@dataclass(frozen=True)
class Quantised:
    """Encoded products (``cell``, keys, price, in_stock, ``code``, ``embedding``), what encodes them,
    and how many lists and shortlisted products a request gets."""

    codes: DataFrame
    centroids: np.ndarray
    books: np.ndarray
    probes: int
    shortlist: int


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


def _means(rows: np.ndarray, count: int, random: np.random.Generator) -> np.ndarray:
    """k-means; a centre that loses its rows takes the row furthest from its own centre."""
    centres = rows[random.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(rows, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            far = ((rows - centres[own]) ** 2).sum(axis=1).argsort()[::-1][: len(empty)]
            centres[empty[: len(far)]] = rows[far]
    return centres


def train(catalog: DataFrame, lists: int, parts: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (lists x dimension) and codebooks (parts x codes x dimension / parts) from up to
    ``TRAIN_ROWS`` products of smallest key hash. The dimension must be a multiple of ``parts``."""
    rows = catalog.filter(F.exists("embedding", lambda x: x != 0))
    sample = rows.orderBy(F.xxhash64(*KEYS), *KEYS).limit(TRAIN_ROWS).select("embedding").toArrow()
    if not sample.num_rows:
        raise ValueError("no vectors to train on")
    column = sample["embedding"].combine_chunks()
    unit = search._unit(search._matrix(column, len(column[0])))
    if unit.shape[1] % parts:
        raise ValueError(f"{unit.shape[1]} dimensions are no multiple of {parts} parts")
    random = np.random.default_rng(seed)
    centroids = _means(unit, lists, random)
    left = (unit - centroids[_nearest(unit, centroids)]).reshape(len(unit), parts, -1)
    books = [_means(left[:, m], CODES, random) for m in range(parts)]
    padded = [np.concatenate([b, np.repeat(b[:1], CODES - len(b), axis=0)]) for b in books]
    return centroids, np.stack(padded)


def _encoded(products: DataFrame, centroids: np.ndarray, books: np.ndarray) -> DataFrame:
    schema = T.StructType([*products.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())])
    shared = products.sparkSession.sparkContext.broadcast((centroids, books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, tables = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            unit = search._unit(search._matrix(batch.column(at), centres.shape[1]))
            good = np.flatnonzero(~np.isnan(unit).any(axis=1)) if len(unit) else np.zeros(0, np.int64)
            unit, kept = unit[good], batch.take(pa.array(good))
            cells = _nearest(unit, centres) if len(unit) else np.zeros(0, np.int64)
            left = (unit - centres[cells]).reshape(len(unit), len(tables), -1)
            codes = np.zeros((len(unit), len(tables)), np.uint8)
            for m, book in enumerate(tables):
                codes[:, m] = _nearest(left[:, m], book) if len(unit) else 0
            columns = list(kept.columns)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(tables)), len(codes), [None, pa.py_buffer(codes.tobytes())])
            columns += [pa.array(cells.astype(np.int32)), packed.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return products.mapInArrow(encode, schema)


def build(
    catalog: DataFrame, lists: int = 64, parts: int = 16, probes: int = 8, shortlist: int = 200, path: str | None = None
) -> Quantised:
    """Train, encode every product, and write codes beside vectors, sorted by list, below ``path``
    (a new folder in the shared one by default). A list's rows span several files if they are many."""
    centroids, books = train(catalog, lists, parts)
    path = path or fresh_dir(catalog.sparkSession, "quantised")
    products = cut_lineage(search._products(catalog))
    encoded = _encoded(products, centroids, books)
    spread = F.xxhash64(*KEYS)
    encoded.repartitionByRange("cell", spread).sortWithinPartitions("cell").write.parquet(f"{path}/codes")
    codes = catalog.sparkSession.read.schema(encoded.schema).parquet(f"{path}/codes")
    return Quantised(codes, centroids, books, probes, shortlist)


class _Estimated(search._BestRows):
    """Best rows by estimate: a request meets the products of the lists it probes."""

    def __init__(self, requests: search._Requests, schema: pa.Schema, index: tuple[np.ndarray, np.ndarray], probes: int):
        super().__init__(requests, None, schema)
        centroids, books = index
        near = requests.vectors @ centroids.T
        order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        probed = np.zeros(near.shape, bool)
        np.put_along_axis(probed, order, True, axis=1)
        self.asking = [np.flatnonzero(probed[:, cell]) for cell in range(len(centroids))]
        self.centroids, self.books = centroids.astype(np.float32), books.astype(np.float32)
        self.single = requests.vectors.astype(np.float32)

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows == 0 or not self.requests.ids:
            return
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        price = column["price"].to_numpy(zero_copy_only=False).astype(np.float64)
        stock = np.array(column["in_stock"].to_numpy(zero_copy_only=False), dtype=bool)
        packed, width = column["code"].cast(pa.large_binary()), len(self.books)
        begin = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset]
        codes = np.frombuffer(packed.buffers()[2], np.uint8)[begin : begin + batch.num_rows * width].reshape(-1, width)
        cells = column["cell"].to_numpy()
        scored = self._scorer(column)
        for cell in np.unique(cells).tolist():
            asked = self.asking[cell]
            if len(asked):

                def score(rows: np.ndarray, asked: np.ndarray, cell: int = cell) -> np.ndarray:
                    left = np.concatenate([book[codes[rows, m]] for m, book in enumerate(self.books)], axis=1)
                    return scored((self.centroids[cell] + left) @ self.single[asked].T, rows, asked)

                yield from self._score_in_parts(column, score, price, stock, np.flatnonzero(cells == cell), asked)

    def _scorer(self, column: dict[str, pa.Array]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """What the estimates of rows (down) for requests (across) become; here they stay."""
        return lambda estimates, rows, asked: estimates.astype(np.float64)


class _Counted(_Estimated):
    """Counts estimates by bins instead: what a request's shortlist may hold, best bins first."""

    def __init__(self, requests: search._Requests, schema: pa.Schema, index: tuple[np.ndarray, np.ndarray], probes: int, shortlist: int):
        super().__init__(requests, schema, index, probes)
        self.shortlist, self.counts = shortlist, np.zeros((len(requests.ids), BINS), np.int64)

    def _keep(self, column, scores, price, stock, rows, asked) -> None:
        at, request = np.nonzero(self._allowed(price, stock, rows, asked) & ~np.isnan(scores))
        place = np.clip((scores[at, request] + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)
        self.counts[asked] += np.bincount(request * BINS + place, minlength=len(asked) * BINS).reshape(-1, BINS)

    def finish(self) -> Iterator[pa.RecordBatch]:
        better = self.counts[:, ::-1].cumsum(axis=1)[:, ::-1] - self.counts
        request, place = np.nonzero((self.counts > 0) & (better < self.shortlist))
        columns = [pa.array(request.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(self.counts[request, place])]
        yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)


class _Shortlisted(_Estimated):
    """Best rows by exact similarity among those whose estimate reaches a request's ``least``."""

    def __init__(self, requests: search._Requests, schema: pa.Schema, index: tuple[np.ndarray, np.ndarray], probes: int, least: np.ndarray):
        super().__init__(requests, schema, index, probes)
        self.least = least

    def _scorer(self, column: dict[str, pa.Array]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        vectors = search._unit(search._matrix(column["embedding"], self.requests.vectors.shape[1]))

        def exact(estimates: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
            listed = estimates >= self.least[asked]
            if np.count_nonzero(listed) * DENSE > listed.size:
                scores = vectors[rows] @ self.requests.vectors[asked].T
                scores[~listed] = -np.inf
                return np.round(scores, SIMILARITY_PLACES)
            scores = np.full(estimates.shape, -np.inf)
            at, request = np.nonzero(listed)
            step = max(1, GATHERED_AT_ONCE // vectors.shape[1])
            for low in range(0, len(at), step):
                i, j = at[low : low + step], request[low : low + step]
                found = np.einsum("ij,ij->i", vectors[rows[i]], self.requests.vectors[asked[j]])
                scores[i, j] = np.round(found, SIMILARITY_PLACES)
            return scores

        return exact


_COUNTS = pa.schema([("request", pa.int32()), ("bin", pa.int32()), ("rows", pa.int64())])


def _probed(index: Quantised, block: pa.Table, probes: int) -> DataFrame:
    """The encoded products of the lists that any request probes."""
    vectors = search._unit(search._matrix(block.column("qvec").combine_chunks(), index.centroids.shape[1]))
    order = np.argsort(-(vectors @ index.centroids.T), axis=1, kind="stable")[:, :probes]
    return index.codes.filter(F.col("cell").isin(np.unique(order).tolist()))


def _least(index: Quantised, block: pa.Table, shared: Broadcast, schema: pa.Schema) -> np.ndarray:
    """Per request an estimate that its best ``shortlist`` products reach, and few others."""
    probes, shortlist = index.probes, index.shortlist

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, centroids, books = shared.value
        kept = _Counted(search._Requests(asked, None), schema, (centroids, books), probes, shortlist)
        for batch in batches:
            yield from kept.add(batch)
        yield from kept.finish()

    counted = _probed(index, block, probes).drop("embedding").mapInArrow(count, "request int, bin int, rows bigint")
    bins = counted.groupBy("request", "bin").agg(F.sum("rows").alias("rows"))
    so_far = F.sum("rows").over(Window.partitionBy("request").orderBy(F.desc("bin")))
    full = bins.withColumn("so_far", so_far).filter(F.col("so_far") >= shortlist).groupBy("request").agg(F.max("bin").alias("bin"))
    least = np.full(block.num_rows, -np.inf)
    for row in full.collect():
        if row["bin"]:  # the lowest bin has no lower end; estimates may differ in their last digits
            least[row["request"]] = row["bin"] * (2 * REACH / BINS) - REACH - 1e-4
    return least


def _shortlists(index: Quantised, requests: DataFrame, block: pa.Table, probes: int, shortlist: int) -> DataFrame:
    """(query_id, keys, similarity by estimate, rank) of each request's best ``shortlist`` products."""
    schema = search._result_schema(requests)
    arrow_schema = pa.schema([pa.field(f.name, search._arrow_type(f.dataType)) for f in schema.fields])
    size = pa.array(np.full(block.num_rows, shortlist, np.int32))
    bare = block.set_column(block.column_names.index("k"), "k", size)
    bare = bare.set_column(bare.column_names.index("min_similarity"), "min_similarity", pa.nulls(block.num_rows, pa.float64()))
    shared = index.codes.sparkSession.sparkContext.broadcast((bare, index.centroids, index.books))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, centroids, books = shared.value
        kept = _Estimated(search._Requests(asked, None), arrow_schema, (centroids, books), probes)
        for batch in batches:
            yield from kept.add(batch)
        yield from kept.finish()

    return search.final_rank(_probed(index, block, probes).drop("embedding").mapInArrow(best, schema), shortlist)


def _scored(index: Quantised, requests: DataFrame, block: pa.Table, whole: bool) -> DataFrame:
    """Partial results: each task's best rows by exact similarity of what is on the shortlists."""
    context = index.codes.sparkSession.sparkContext
    shared = context.broadcast((block, index.centroids, index.books))
    probes, schema = index.probes, search._result_schema(requests)
    arrow_schema = pa.schema([pa.field(f.name, search._arrow_type(f.dataType)) for f in schema.fields])
    bars = context.broadcast(np.full(block.num_rows, -np.inf) if whole else _least(index, block, shared, arrow_schema))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, centroids, books = shared.value
        kept = _Shortlisted(search._Requests(asked, None), arrow_schema, (centroids, books), probes, bars.value)
        for batch in batches:
            yield from kept.add(batch)
        yield from kept.finish()

    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in KEYS])
    return _probed(index, block, probes).filter(named).mapInArrow(best, schema)


def _repeated(index: Quantised, found: DataFrame) -> DataFrame:
    """Products that repeat a key: each is found as often as the key is there."""
    several, few = sizing.settle(index.codes.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("_times")).filter("_times > 1"))
    if several.isEmpty():
        return found
    times = found.join(F.broadcast(several) if few else several, KEYS, "left")
    copies = F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1))))
    return times.withColumn("_copy", copies).select(*found.columns)


def top_k(index: Quantised, queries: DataFrame, k: int = 10) -> DataFrame:
    """Approximate best ``k`` products per request, as ``search.top_k`` returns them, with exact
    similarities. A request's own ``k`` may not exceed the index's shortlist, which holds at least so
    many products: all that share the bin of the last one's estimate. Requests are sent to the lists
    in blocks."""
    requests = cut_lineage(search._requests(queries, k))
    facts = requests.agg(F.count("*").alias("rows"), F.max(F.coalesce("k", F.lit(search.NO_LIMIT))).alias("k")).first()
    if (facts["k"] or 0) > index.shortlist:
        raise ValueError(f"a request asks for {facts['k']} products, the shortlist holds {index.shortlist}")
    blocks = max(1, -(-facts["rows"] // min(BLOCK_REQUESTS, search.MAX_BROADCAST_REQUESTS)))
    whole = index.codes.count() <= index.shortlist
    partial = None
    for number in range(blocks):
        own = requests if blocks == 1 else requests.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        scored = _scored(index, requests, own.toArrow(), whole)
        partial = scored if partial is None else partial.unionByName(scored)
    return search.final_rank(_repeated(index, partial), facts["k"] or 0)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results that were found."""
    keys = ["query_id", *KEYS]
    hits = exact.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left")
    facts = hits.agg(F.count(F.lit(1)).alias("all"), F.count("hit").alias("hits")).first()
    return facts["hits"] / facts["all"] if facts["all"] else 1.0


def calibrated(index: Quantised, catalog: DataFrame, k: int = 10, target: float = 0.95) -> Quantised:
    """The index with the fewest lists and the shortest shortlist with which the exact neighbours of
    up to ``MEASURE_ROWS`` products (of greatest key hash, so that few were trained on) are reached
    at the rate ``target``: half of what may be missed is granted to the lists, half to the shortlist."""
    measured = catalog.filter(F.exists("embedding", lambda x: x != 0)).orderBy(F.desc(F.xxhash64(*KEYS)), *KEYS).limit(MEASURE_ROWS)
    asked = cut_lineage(measured.select(F.concat_ws("\u0001", *KEYS).alias("query_id"), F.col("embedding").alias("qvec")))
    exact = cut_lineage(search.top_k(catalog, asked, k=k))
    block = search._requests(asked, k).toArrow()
    vectors = search._unit(search._matrix(block.column("qvec").combine_chunks(), index.centroids.shape[1]))
    order = np.argsort(-(vectors @ index.centroids.T), axis=1, kind="stable")
    turn = np.argsort(order, axis=1)
    number = {name: i for i, name in enumerate(block.column("query_id").to_pylist())}
    neighbours = index.codes.join(F.broadcast(exact.select("query_id", *KEYS)), KEYS).select("query_id", "cell").collect()
    turns = np.sort([turn[number[r["query_id"]], r["cell"]] for r in neighbours])
    share = 1 - (1 - target) / 2
    probes = int(turns[min(len(turns) - 1, int(np.ceil(share * len(turns))) - 1)]) + 1
    longest = max(k, min(search.WINDOW_ROWS, 100 * k))
    listed = _shortlists(index, search._requests(asked, k), block, probes, longest)
    keys = ["query_id", *KEYS]
    places = exact.select(*keys).join(listed.select(*keys, F.col("rank").alias("place")), keys).select("place").collect()
    ranks = np.sort([r["place"] for r in places])
    shortlist = int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)])
    return replace(index, probes=probes, shortlist=max(k, shortlist))
