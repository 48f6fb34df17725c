"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact join.

A rule is listed as host and path joined (``example.com/en/``). What a URL may be
listed under are its host's suffixes with the beginnings of its path; of those only
the filter's possible hits reach the join, which removes the false ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import sizing
from vitrine.llm import blocks

# The rules (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"

BLOCK_BITS, PROBES, BITS_PER_KEY = 512, 6, 16
#: The filter never grows beyond this; a longer list only passes more false hits on.
MOST_BITS = 1 << 28


def rules(spark: SparkSession, listed: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(listed, "verdict string, host string, path string")


def host_of(url: Column | str) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column | str) -> Column:
    """From the host's end to the next ``?``, ``#`` or the end."""
    found = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"first": F.xxhash64("key"), "second": F.xxhash64("key", F.lit(1))})


def _probe(total: int, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word and bit of each probe: one block by the first hash, bits by the second."""
    base = (first.view(np.uint64) % np.uint64(total)).astype(np.int64) * (BLOCK_BITS // 64)
    bits = second.view(np.uint64)
    for i in range(PROBES):
        place = (bits >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1)
        yield base + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))


def bloom(keys: DataFrame) -> np.ndarray:
    """The filter's words, built by tasks and merged word by word before they meet."""
    count = max(1, keys.count())
    total = min(-(-count * BITS_PER_KEY // BLOCK_BITS), MOST_BITS // BLOCK_BITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for word, bit in _probe(total, first, second):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["word", "bits"])

    words = _hashed(keys).select("first", "second").mapInArrow(blocks.tidy(run), "word bigint, bits bigint")
    merged = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(total * (BLOCK_BITS // 64), np.uint64)
    out[merged["word"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return out


def possible(candidates: DataFrame, words: np.ndarray) -> DataFrame:
    """The candidates whose key the filter may hold."""
    shipped = candidates.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            first, second = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second"))
            keep = np.ones(batch.num_rows, bool)
            for word, bit in _probe(len(known) * 64 // BLOCK_BITS, first, second):
                keep &= (known[word] & bit) != 0
            yield batch.filter(pa.array(keep))

    rows = _hashed(candidates)
    return rows.mapInArrow(blocks.tidy(run), rows.schema).drop("first", "second")


def _longest(path: Column, lengths: list[int]) -> Column:
    """The beginnings of a path that have the length of some listed path."""
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path))
    return F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))


def judge(
    pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT
) -> DataFrame:
    """The verdict on every URL: (id, host, path, rule, verdict).

    A rule (verdict, host, path) fits its host and all subdomains if the URL's
    path starts with the rule's. The longest fitting rule wins (by host and path
    together; among equals the longer host, then ``block``); without one ``rule``
    is NULL and the verdict ``default``. A URL that is NULL or has no ``://`` has an
    empty host and path. Rules with a NULL are left out. Rows come back one for
    one, NULL and repeated ids included; an empty table gives no rows; other
    columns play no part.
    """
    named = pages.select(
        pages[f"`{id_col}`"].alias("id"), host_of(pages[f"`{url_col}`"]).alias("host"), path_of(pages[f"`{url_col}`"]).alias("path")
    )
    known = listed.select("verdict", "host", "path").dropna().withColumn("key", F.concat("host", "path")).distinct()
    known = sizing.small_side(known.withColumnsRenamed({"host": "rule_host", "path": "rule_path"}))
    sizes = known.select(F.length("rule_path"), F.size(F.split("rule_host", r"\."))).distinct().collect()
    lengths, deepest = sorted({r[0] for r in sizes}), max((r[1] for r in sizes), default=1)
    if not lengths:
        return named.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # No rule has more labels than the deepest one, so a long host has no more suffixes than that.
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, deepest)
    labels = F.reverse(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(_longest(F.col("path"), lengths), lambda p: F.concat(s, p))))
    candidates = named.select("host", "path").distinct().withColumn("key", F.explode(F.array_distinct(keys)))
    hits = possible(candidates, bloom(known.select("key").distinct())).join(known, "key")
    fits = (F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), F.col("rule_host")))
    hits = hits.filter(fits & F.startswith("path", F.col("rule_path")))
    order = F.struct(F.length("key"), F.length("rule_host"), F.col("verdict") == "block")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.col("key").alias("rule"), "verdict"), order).alias("best"))
    return named.join(sizing.small_side(best), ["host", "path"], "left").select(
        "id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
