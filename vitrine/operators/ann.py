"""Inverted-file vector search: products in buckets around trained centroids.

``probe`` looks into a request's nearest buckets only and is approximate, as
an inverted-file index is. ``exact`` also visits every bucket that could still
hold a better product, judged by the bucket's radius, and equals the full scan.
Scoring is done cell by cell with the cell being a bucket, so a bucket holding
much of the catalogue is split over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators import search
from vitrine.session import cut_lineage, fresh_dir

LISTS = 100
# Slack for the rounding of similarities and angles; it only adds buckets.
ANGLE_SLACK = 1e-5


def train_centroids(catalog: DataFrame, lists: int = LISTS, seed: int = 7, max_iter: int = 10) -> np.ndarray:
    """Unit centroids from k-means over all vectors; ``lists`` rows at most."""
    # Zero vectors have no direction to cluster by, and are nobody's neighbour.
    vectors = catalog.select("embedding").filter(F.exists("embedding", lambda x: x != 0))
    total = vectors.count()
    if total == 0:
        raise ValueError("no vectors to train on")
    features = vectors.select(array_to_vector(F.col("embedding")).alias("features"))
    model = KMeans(k=min(lists, total), seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(features)
    centers = np.array(model.clusterCenters(), dtype=np.float64)
    norms = np.linalg.norm(centers, axis=1, keepdims=True)
    return centers[norms[:, 0] > 0] / norms[norms[:, 0] > 0]


@dataclass
class BucketIndex:
    """Bucketed products, the centroids, and each bucket's largest angle."""

    products: DataFrame
    centroids: np.ndarray
    radii: DataFrame


def assign(catalog: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Products with the bucket of their nearest centroid and the angle to it."""
    products = search._products(catalog)
    schema = T.StructType(
        [*products.schema.fields, T.StructField("cell", T.StringType()), T.StructField("angle", T.DoubleType())]
    )
    shared = products.sparkSession.sparkContext.broadcast(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            vectors = search._unit(search._matrix(batch.column(batch.schema.get_field_index("embedding")), centers.shape[1]))
            cosines = np.clip(np.nan_to_num(vectors) @ centers.T, -1.0, 1.0)
            best = cosines.argmax(axis=1) if len(cosines) else np.array([], dtype=int)
            angles = np.arccos(cosines[np.arange(len(best)), best])
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns += [pa.array([str(b) for b in best], pa.string()), pa.array(angles, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cell", "angle"])

    return products.mapInArrow(nearest, schema)


def build_index(catalog: DataFrame, lists: int = LISTS, seed: int = 7, path: str | None = None) -> BucketIndex:
    """Train, assign, and write the buckets as partitions of a table at ``path``
    (a new folder in the shared one by default). The rebalance hint splits a hot
    bucket over several files."""
    centroids = train_centroids(catalog, lists, seed)
    assigned = assign(catalog, centroids)
    path = path or fresh_dir(catalog.sparkSession, "buckets")
    assigned.hint("rebalance", "cell").write.mode("errorifexists").partitionBy("cell").parquet(path)
    schema = assigned.schema
    stored = assigned.sparkSession.read.schema(schema).parquet(path).select(*schema.names)
    radii = cut_lineage(stored.groupBy("cell").agg(F.max("angle").alias("radius")))
    return BucketIndex(stored, centroids, radii)


def _bucket_angles(requests: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per request and bucket: the angle to the centroid and its rank by nearness."""
    shared = requests.sparkSession.sparkContext.broadcast(centroids)
    found = T.ArrayType(
        T.StructType(
            [
                T.StructField("cell", T.StringType()),
                T.StructField("theta", T.DoubleType()),
                T.StructField("nearness", T.IntegerType()),
            ]
        )
    )

    @F.pandas_udf(found)
    def angles(vectors: pd.Series) -> pd.Series:
        centers = shared.value
        matrix = search._unit(np.array(vectors.tolist(), dtype=np.float64).reshape(-1, centers.shape[1]))
        theta = np.arccos(np.clip(np.nan_to_num(matrix) @ centers.T, -1.0, 1.0))
        order = np.argsort(np.argsort(theta, axis=1, kind="stable"), axis=1)
        return pd.Series(
            [
                [{"cell": str(c), "theta": float(t), "nearness": int(o) + 1} for c, (t, o) in enumerate(zip(ts, os))]
                for ts, os in zip(theta, order)
            ]
        )

    return requests.select("query_id", F.inline(angles(F.col("qvec"))))


def _score(index: BucketIndex, requests: DataFrame, visits: DataFrame) -> DataFrame:
    """Partial results of the requests in the buckets they visit.

    The visited buckets, at most one per centroid, become a partition filter. Requests
    that are few go to the buckets as they lie; many are dealt to blocks with them.
    """
    asked = cut_lineage(requests.join(visits.select("query_id", "cell"), "query_id"))
    cells = sorted(row["cell"] for row in asked.select("cell").distinct().collect())
    products = index.products.drop("angle").filter(F.col("cell").isin(cells))
    block, _ = search.small_block(asked)
    if block is not None:
        return search.broadcast_partials(products, asked, block, "cell")
    return search.blocked_partials(products, asked, by_tenant=False)


def probe(index: BucketIndex, queries: DataFrame, k: int = 10, probes: int = 10) -> DataFrame:
    """Approximate top-k from each request's ``probes`` nearest buckets."""
    requests = cut_lineage(search._requests(queries, k))
    visits = _bucket_angles(requests, index.centroids).filter(F.col("nearness") <= probes)
    return search.final_rank(_score(index, requests, visits))


def exact(index: BucketIndex, queries: DataFrame, k: int = 10, probes: int = 10) -> DataFrame:
    """Exact top-k: probe, then visit the other buckets that may still matter.

    No member of a bucket is nearer to a request than the angle to the centroid
    minus the bucket's radius. A bucket is skipped only if even that could not
    reach the k-th best similarity found by the probe, or the request's own
    threshold.
    """
    requests = cut_lineage(search._requests(queries, k))
    angles = _bucket_angles(requests, index.centroids)
    first = cut_lineage(_score(index, requests, angles.filter(F.col("nearness") <= probes)))
    reached = search.final_rank(first)
    floors = (
        reached.groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("kth"))
        .join(requests.select("query_id", "k", "min_similarity"), "query_id", "right")
        .select(
            "query_id",
            F.greatest(
                F.when(F.col("n") >= F.col("k"), F.col("kth")).otherwise(F.lit(-1.0)),
                F.coalesce("min_similarity", F.lit(-1.0)),
            ).alias("floor"),
        )
    )
    closest = F.greatest(F.lit(0.0), F.col("theta") - F.col("radius") - F.lit(ANGLE_SLACK))
    rest = (
        angles.filter(F.col("nearness") > probes)
        .join(index.radii, "cell")
        .join(floors, "query_id")
        .filter(F.cos(closest) + F.lit(ANGLE_SLACK) >= F.col("floor"))
    )
    return search.final_rank(first.unionByName(_score(index, requests, rest)))
