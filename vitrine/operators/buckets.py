"""A catalogue kept in key buckets, of which a merge rewrites only those it touches.

Rows lie in ranges of their key: one folder per bucket below the folder of the
commit that wrote it. A manifest names, for every bucket, its commit, the least
key that belongs to it and its rows. A merge reads the buckets its batch falls
into, writes their next rows under a new commit, and then writes the next
manifest, one file that appears at once: until then nobody sees the commit, and
who read the manifest before keeps reading the older folders. Two merges that
start from one manifest cannot both succeed, as a manifest is written once.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators import merge
from vitrine.operators.search import ranked_within
from vitrine.session import cut_lineage

KEYS = merge.PRODUCT_KEYS
ROWS_PER_BUCKET = 1_000_000
_MANIFEST = "bucket int, commit string, low_shop string, low_product string, rows bigint"
Apply = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Merged:
    """What a merge did: the manifest it wrote, buckets and files it read, of how many."""

    version: int
    touched: int
    buckets: int


def _files(spark: SparkSession, path: str) -> list[Row]:
    """The newest manifest, bucket by bucket in key order; it has a row per bucket, so it is small."""
    kept = spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{path}/manifest")
    newest = kept.filter(F.col("version") == kept.agg(F.max("version")).scalar())
    return sorted(newest.collect(), key=lambda r: (r["low_shop"], r["low_product"]))


def _folder(path: str, entry: Row) -> str:
    return f"{path}/data/commit={entry['commit']}/bucket={entry['bucket']}"


def _read(spark: SparkSession, path: str, entries: list[Row]) -> DataFrame:
    schema = spark.read.parquet(_folder(path, entries[0])).schema
    return spark.read.schema(schema).parquet(*[_folder(path, e) for e in entries])


def _bucket(entries: list[Row]) -> Column:
    """The bucket whose range holds a row's key; keys before the first range belong to the first."""
    lows = [(e["low_shop"], e["low_product"]) for e in entries]
    numbers = [e["bucket"] for e in entries]

    @F.pandas_udf(T.IntegerType())
    def find(shop: pd.Series, product: pd.Series) -> pd.Series:
        found = (max(0, bisect_right(lows, key) - 1) for key in zip(shop, product, strict=True))
        return pd.Series([numbers[i] for i in found], dtype="int32")

    return find(*KEYS)


def _write(rows: DataFrame, path: str, commit: str) -> None:
    kept = rows.write.mode("errorifexists").option("compression", "zstd")
    kept.partitionBy("bucket").parquet(f"{path}/data/commit={commit}")


def _written(spark: SparkSession, path: str, commit: str, kinds: T.StructType) -> list[tuple]:
    """Per bucket of a commit: its number, least key and rows."""
    back = spark.read.schema(T.StructType([*kinds.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/data/commit={commit}")
    facts = back.groupBy("bucket").agg(F.min(F.struct(*KEYS)).alias("low"), F.count(F.lit(1)).alias("rows"))
    return [(r["bucket"], commit, *r["low"], r["rows"]) for r in facts.collect()]


def _commit(spark: SparkSession, path: str, entries: list[tuple], version: int) -> None:
    manifest = spark.createDataFrame(entries, _MANIFEST)
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version}")


def create(table: DataFrame, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Lay a catalogue out in buckets of about so many rows at a new ``path``. A tenant with many
    products has many buckets; several small tenants may share one. It must have rows."""
    spark, commit = table.sparkSession, uuid.uuid4().hex
    count = max(1, -(-table.count() // rows_per_bucket))
    placed = table.repartitionByRange(count, *KEYS).sortWithinPartitions(*KEYS).withColumn("bucket", F.spark_partition_id())
    _write(placed, path, commit)
    _commit(spark, path, _written(spark, path, commit, table.schema), 0)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as of the newest manifest."""
    return _read(spark, path, _files(spark, path))


def apply(spark: SparkSession, path: str, incoming: DataFrame, change: Apply) -> Merged:
    """Rewrite the buckets that the keys of ``incoming`` fall into. ``change`` takes their stored rows
    and the batch and returns all their next rows. ``incoming`` is read once."""
    entries = _files(spark, path)
    batch = cut_lineage(incoming.withColumn("_bucket", _bucket(entries)))
    wanted = {r["_bucket"] for r in batch.select("_bucket").distinct().collect()}
    touched = [e for e in entries if e["bucket"] in wanted]
    version = _version(spark, path) + 1
    if not touched:
        return Merged(version - 1, 0, len(entries))
    stored, commit = _read(spark, path, touched), uuid.uuid4().hex
    following = change(stored, batch.drop("_bucket")).withColumn("bucket", _bucket(entries))
    _write(following.hint("rebalance", "bucket"), path, commit)
    lows = {e["bucket"]: (e["low_shop"], e["low_product"]) for e in entries}
    # A bucket keeps its range: new rows before its least key lower it only in the first bucket.
    rewritten = [(b, c, *min(lows[b], (shop, product)), n) for b, c, shop, product, n in _written(spark, path, commit, stored.schema)]
    untouched = [tuple(e[c] for c in ("bucket", "commit", "low_shop", "low_product", "rows")) for e in entries if e["bucket"] not in wanted]
    _commit(spark, path, untouched + rewritten, version)
    return Merged(version, len(touched), len(entries))


def split(spark: SparkSession, path: str, most: int = 2 * ROWS_PER_BUCKET) -> Merged:
    """Cut buckets that have grown beyond ``most`` rows into ranges of about equal size, each within
    the range of its bucket; the others are not read."""
    entries, version = _files(spark, path), _version(spark, path)
    large = [e for e in entries if e["rows"] > most]
    if not large:
        return Merged(version, 0, len(entries))
    # A row's place in its bucket says which part it goes to; the first part keeps the bucket's number.
    following, parts, first = max(e["bucket"] for e in entries) + 1, {}, {}
    for e in large:
        parts[e["bucket"]], first[e["bucket"]] = -(-e["rows"] // most), following - 1
        following += parts[e["bucket"]] - 1
    table = [(e["bucket"], parts[e["bucket"]], e["rows"], first[e["bucket"]]) for e in large]
    facts = F.broadcast(spark.createDataFrame(table, "_bucket int, _parts int, _rows bigint, _first int"))
    schema = _read(spark, path, large).schema
    old = _read(spark, path, large).withColumn("_bucket", _bucket(entries))
    placed = ranked_within(old, ["_bucket"], [F.col(c) for c in KEYS], "_place").join(facts, "_bucket")
    part = F.floor((F.col("_place") - 1) * F.col("_parts") / F.col("_rows")).cast("int")
    number = F.when(part == 0, F.col("_bucket")).otherwise(F.col("_first") + part)
    commit = uuid.uuid4().hex
    cut = placed.withColumn("bucket", number).drop("_bucket", "_place", "_parts", "_rows", "_first")
    _write(cut.hint("rebalance", "bucket"), path, commit)
    lows = {e["bucket"]: (e["low_shop"], e["low_product"]) for e in large}
    made = [(b, c, *lows.get(b, (shop, product)), n) for b, c, shop, product, n in _written(spark, path, commit, schema)]
    kept = [tuple(e[c] for c in ("bucket", "commit", "low_shop", "low_product", "rows")) for e in entries if e["rows"] <= most]
    _commit(spark, path, kept + made, version + 1)
    return Merged(version + 1, len(large), len(kept) + len(made))


def _version(spark: SparkSession, path: str) -> int:
    return spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{path}/manifest").agg(F.max("version")).first()[0]


def upsert_products(spark: SparkSession, path: str, incoming: DataFrame, as_of: datetime) -> Merged:
    """``merge.upsert_products`` on the touched buckets."""
    return apply(spark, path, incoming, lambda stored, new: merge.upsert_products(stored, new, as_of))


def upsert_product_info(spark: SparkSession, path: str, incoming: DataFrame, as_of: datetime) -> Merged:
    """``merge.upsert_product_info`` on the touched buckets: vectors stay as they are."""
    return apply(spark, path, incoming, lambda stored, new: merge.upsert_product_info(stored, new, as_of))


def write_back_embeddings(spark: SparkSession, path: str, vectors: DataFrame, as_of: datetime, clear: str = "set_false") -> Merged:
    """``merge.write_back_embeddings`` on the touched buckets; vectors of unknown products are left out."""
    return apply(spark, path, vectors, lambda stored, new: merge.write_back_embeddings(stored, new, as_of, clear)[0])
