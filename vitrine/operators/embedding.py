"""Batch embedding with a pluggable embedder, and the embedding cache.

An embedder is a callable ``list[str] -> array of shape (n, dim)``; it runs in
Arrow batches inside tasks. The default needs no model: it hashes words into a
fixed number of dimensions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import predicates as P
from vitrine.functions import sizing, skew
from vitrine.functions.text import cache_key
from vitrine.operators import merge
from vitrine.session import cut_lineage
from vitrine.sources import seeds

Embedder = Callable[[list[str]], np.ndarray]
CACHE_DAYS = 7
# What an embedder is given at once, at most (a longer text goes alone), and what a task reads at once.
EMBED_ROWS, EMBED_BYTES, READ_BYTES = 512, 1 << 20, 4 << 20


def hashing_embedder(dim: int) -> Embedder:
    """Unit vectors from hashed words; equal texts get equal vectors everywhere."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for row, text in enumerate(texts):
            for word, times in Counter(text.lower().split()).items():
                digest = zlib.crc32(word.encode())
                out[row, digest % dim] += times if digest & 0x10000 else -times
            # Words that cancel out must not leave a zero vector.
            if not out[row].any():
                out[row, zlib.crc32(text.encode()) % dim] = 1.0
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)

    return embed


def word_embedder(dim: int) -> Embedder:
    """Like ``hashing_embedder``, with a hash that every engine has, and without a loop over words:
    the first four bytes of a word's MD5 give its dimension, and its sign by the first bit.
    Only the distinct words of a batch are hashed one by one."""

    def number(word: str) -> int:
        return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")

    def embed(texts: list[str]) -> np.ndarray:
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        hashes = np.array([number(w) for w in words], np.int64)
        signs = np.where(np.array([w == "" for w in words], bool), 0, np.where(hashes >> 31, 1, -1))
        codes = coded.indices.to_numpy()
        out = np.zeros((len(texts), dim))
        np.add.at(out, (row, hashes[codes] % dim), signs[codes])
        for i in np.flatnonzero(~out.any(axis=1)).tolist():  # words that cancel out must not leave a zero vector
            out[i, number(texts[i]) % dim] = 1.0
        return (out / np.sqrt((out * out).sum(axis=1, keepdims=True))).astype(np.float32)

    return embed


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of ``EMBED_ROWS`` rows and ``EMBED_BYTES`` of text in column ``at`` at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        before = int(ends[low - 1]) if low else 0
        high = min(low + EMBED_ROWS, max(low + 1, int(np.searchsorted(ends, before + EMBED_BYTES, side="right"))))
        yield batch.slice(low, high - low)
        low = high


def embed_rows(rows: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """``rows`` plus ``embedding, status, error``. A failing text fails alone.

    Texts go to the embedder some at a time, so a task's memory follows from ``EMBED_BYTES``
    and not from the number or length of texts. A call that raises is retried text by
    text, so one bad row costs its neighbours only the vectorisation.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(READ_BYTES))
    schema = T.StructType(
        [
            *rows.schema.fields,
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("status", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def one_by_one(texts: list[str]) -> tuple[list, list]:
        vectors, errors = [], []
        for item in texts:
            try:
                vectors.append(np.asarray(embedder([item])[0], dtype=np.float32))
                errors.append(None)
            except Exception as problem:  # the row's own failure, reported with it
                vectors.append(None)
                errors.append(str(problem) or type(problem).__name__)
        return vectors, errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole, whole.schema.get_field_index(text))):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            usable = [i for i, item in enumerate(texts) if item is not None and item.strip()]
            vectors: list = [None] * len(texts)
            errors: list = ["text cannot be empty"] * len(texts)
            if usable:
                asked = [texts[i] for i in usable]
                try:
                    found = list(np.asarray(embedder(asked), dtype=np.float32))
                    problems = [None] * len(asked)
                except Exception:
                    found, problems = one_by_one(asked)
                for i, vector, problem in zip(usable, found, problems):
                    vectors[i], errors[i] = vector, problem
            status = ["error" if problem else "ok" for problem in errors]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns += [
                pa.array(vectors, type=pa.list_(pa.float32())),
                pa.array(status, type=pa.string()),
                pa.array(errors, type=pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "embedding", "status", "error"])

    return rows.mapInArrow(run, schema)


def outcome(embedded: DataFrame, *keys: str) -> DataFrame:
    """Totals of a batch; the failed rows themselves carry their errors."""
    return embedded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("success"),
        F.count_if(F.col("status") != "ok").alias("failures"),
    )


def fresh_entries(cache: DataFrame, as_of: datetime, days: int = CACHE_DAYS) -> DataFrame:
    """Cache entries (``cache_key, embedding, cached_at``) not past their life, the
    newest of each key."""
    oldest = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(days)}' DAY")
    newest = F.max(F.struct("cached_at", "embedding")).alias("_last")
    live = cache.filter(F.col("cached_at") > oldest).groupBy("cache_key").agg(newest)
    return live.select("cache_key", "_last.embedding", "_last.cached_at")


def keyed(rows: DataFrame, text: str, model: str = seeds.DEFAULT_MODEL) -> DataFrame:
    return rows.withColumn("cache_key", cache_key(model, F.col(text)))


def distinct_texts(rows: DataFrame, text: str, model: str = seeds.DEFAULT_MODEL) -> DataFrame:
    """Non-blank texts, once each, with their cache key and number of rows."""
    usable = keyed(rows.filter(P.not_blank(text)), text, model)
    return usable.groupBy("cache_key").agg(F.first(text).alias("text"), F.count(F.lit(1)).alias("count"))


def cache_misses(rows: DataFrame, text: str, cache: DataFrame, as_of: datetime, model: str = seeds.DEFAULT_MODEL) -> DataFrame:
    """Distinct texts that have no live cache entry."""
    live = fresh_entries(cache, as_of).select("cache_key")
    return distinct_texts(rows, text, model).select("cache_key", "text").join(live, "cache_key", "left_anti")


def embed_through_cache(
    rows: DataFrame,
    text: str,
    cache: DataFrame,
    embedder: Embedder,
    as_of: datetime,
    spread: list[str],
    model: str = seeds.DEFAULT_MODEL,
) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``embedding``, and the entries to append to the cache.

    Each distinct text is looked up or embedded once; keys are counted without
    their texts, and only the texts of missing keys are fetched. ``spread`` names
    columns that tell rows of equal text apart, as one text may be most of the input.
    """
    usable = keyed(rows.filter(P.not_blank(text)), text, model)
    wanted = cut_lineage(usable.groupBy("cache_key").count())
    live = fresh_entries(cache, as_of)
    missing = sizing.small_side(wanted.join(live, "cache_key", "left_anti").select("cache_key"))
    texts = usable.join(missing, "cache_key", "left_semi").groupBy("cache_key").agg(F.first(text).alias("text"))
    added = cut_lineage(embed_rows(texts, "text", embedder).filter(F.col("status") == "ok"))
    new_entries = added.select("cache_key", "embedding", F.lit(as_of).cast("timestamp_ntz").alias("cached_at"))
    hits = live.join(wanted, "cache_key", "left_semi")
    known = hits.select("cache_key", "embedding").unionByName(new_entries.select("cache_key", "embedding"))
    found = skew.join(keyed(rows, text, model), known, ["cache_key"], "left", spread=spread, counts=wanted, check_small=True)
    return found.drop("cache_key"), new_entries


def regenerate(
    catalog: DataFrame, worklist: DataFrame, text: str, embedder: Embedder, as_of: datetime, clear: str
) -> tuple[DataFrame, DataFrame]:
    """Embed a worklist (keys plus its text column) and write the vectors back.

    Returns the next catalogue and the per-row outcome; failed rows keep their
    old vector and flag.
    """
    embedded = cut_lineage(embed_rows(worklist.select(*merge.PRODUCT_KEYS, text), text, embedder))
    done = embedded.filter(F.col("status") == "ok").select(*merge.PRODUCT_KEYS, "embedding")
    snapshot, _ = merge.write_back_embeddings(catalog, done, as_of, clear=clear)
    return snapshot, embedded


def cost_estimate(texts: DataFrame, text: str) -> DataFrame:
    """Embedding cost per model: a token per four characters, rounded up per text."""
    sized = texts.agg(
        F.count(F.lit(1)).alias("text_count"),
        F.coalesce(F.sum(F.ceil(F.length(text) / 4)), F.lit(0)).cast("bigint").alias("total_tokens"),
    )
    prices = F.array(
        *[
            F.struct(F.lit(model).alias("model"), F.lit(price).alias("price_per_million"))
            for model, price in seeds.MODEL_PRICES.items()
        ]
    )
    cost = (F.col("total_tokens") / 1_000_000 * F.col("price_per_million")).alias("estimated_cost")
    return sized.select("text_count", "total_tokens", F.inline(prices)).select(
        "model", "text_count", "total_tokens", "price_per_million", cost
    )


def planned_costs(plans: DataFrame, counts: str = "text_count", average: str = "average_length") -> DataFrame:
    """``planned_cost`` as data: per row of ``plans`` and model the tokens and dollars for so many
    texts of so many characters on average (NULL: 500)."""
    length = F.coalesce(F.col(average), F.lit(500))
    tokens = (F.col(counts) * F.ceil(length / 4)).cast("bigint").alias("total_tokens")
    prices = [F.struct(F.lit(m).alias("model"), F.lit(p).alias("price_per_million")) for m, p in seeds.MODEL_PRICES.items()]
    each = plans.select("*", tokens, F.inline(F.array(*prices)))
    return each.withColumn("estimated_cost", F.col("total_tokens") / 1_000_000 * F.col("price_per_million"))


def planned_cost(text_count: int, average_length: int = 500, model: str = seeds.DEFAULT_MODEL) -> tuple[int, float]:
    """Tokens and dollars for ``text_count`` texts of an average length."""
    tokens = text_count * -(-average_length // 4)
    return tokens, tokens / 1_000_000 * seeds.MODEL_PRICES.get(model, seeds.DEFAULT_MODEL_PRICE)
