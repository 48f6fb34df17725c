"""Titles that contain a partial query, found in a sorted table of the titles' suffixes.

A title contains a text if one of its suffixes begins with it, and these stand
together when suffixes are sorted. The table is partitioned by range, so a
partial visits the partitions that its range touches, and in each the best few
titles are taken. Wildcards are tried on the suffixes that begin with what
stands before the first of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import sizing
from vitrine.session import cut_lineage

ASKED_BLOCK = 50_000
_LAST = "\U0010ffff"


def pattern(partial: str) -> tuple[str, re.Pattern | None]:
    """What a ``LIKE`` pattern begins with literally, and the whole of it, anchored at its start,
    if it has wildcards. A leading ``%`` is dropped: the partial may stand anywhere."""
    parts, literal, head, at = [], True, "", 0
    partial = re.sub(r"^%+", "", partial)
    while at < len(partial):
        char = partial[at]
        if char in "%_":
            literal = False
            parts.append(".*" if char == "%" else ".")
        else:
            if char == "\\" and at + 1 < len(partial):
                at += 1
                char = partial[at]
            parts.append(re.escape(char))
            head += char if literal else ""
        at += 1
    return head, None if literal else re.compile("".join(parts), re.DOTALL)


def _ranges(bounds: list[tuple[str, str]]):
    """The partitions that may hold suffixes of a tenant that begin with a partial's literal head."""
    firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]

    @F.pandas_udf("array<int>")
    def parts(shop: pd.Series, partial: pd.Series) -> pd.Series:
        out = []
        for s, p in zip(shop, partial, strict=True):
            low = f"{s}\0{pattern(p)[0]}"
            out.append(list(range(bisect_left(lasts, low), bisect_right(firsts, low + _LAST))))
        return pd.Series(out)

    return parts


def _find(limit: int):
    schema = pa.schema([("query_id", pa.string()), ("shop_domain", pa.string()), ("title", pa.string()), ("frequency", pa.int64())])

    def find(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("title", "ascending")])
        keys, titles = rows["key"].to_pylist(), rows["title"].to_pylist()
        frequency = rows["frequency"].to_numpy()
        order = sorted(set(zip((-frequency).tolist(), titles, strict=True)))
        number = {pair: i for i, pair in enumerate(order)}
        rank = np.array([number[-f, t] for f, t in zip(frequency.tolist(), titles, strict=True)], np.int64)
        out = []
        for query, shop, partial in zip(*(asked[c].to_pylist() for c in ("query_id", "shop_domain", "partial")), strict=True):
            head, whole = pattern(partial)
            low = f"{shop}\0{head}"
            begin, end = bisect_left(keys, low), bisect_left(keys, low + _LAST)
            if whole is None:
                found = rank[begin:end]
            else:
                skip = len(shop) + 1
                found = rank[[i for i in range(begin, end) if whole.match(keys[i], skip)]]
            out += [(query, shop, order[i][1], -order[i][0]) for i in np.unique(found)[:limit].tolist()]
        columns = [pa.array([row[i] for row in out], f.type) for i, f in enumerate(schema)]
        return pa.Table.from_arrays(columns, schema=schema)

    return find


def best_titles(counted: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """At least the ``limit`` best titles per partial (most frequent first, then by title), as
    ``query_id, shop_domain, title, frequency``; from some partitions there may be more.

    ``counted`` has ``shop_domain, title, frequency`` once per title, ``asked`` has ``query_id,
    shop_domain, partial``. Case is ignored; ``%`` and ``_`` are wildcards.
    """
    spark = counted.sparkSession
    lowered = F.lower("title")
    start = F.explode(F.sequence(F.lit(1), F.length(lowered) + 1))
    cut = counted.filter("title IS NOT NULL AND shop_domain IS NOT NULL").select("shop_domain", "title", "frequency", lowered.alias("low"), start.alias("start"))
    key = F.concat("shop_domain", F.lit("\0"), F.expr("substring(low, start)"))
    sorted_ = cut.select(key.alias("key"), "title", "frequency").repartitionByRange("key", "title")
    table = cut_lineage(sorted_.withColumn("part", F.spark_partition_id()))
    found = table.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("part").collect()
    if not found:
        return spark.createDataFrame([], "query_id string, shop_domain string, title string, frequency bigint")
    numbers = F.array(*[F.lit(r["part"]) for r in found])
    low = asked.filter("shop_domain IS NOT NULL AND partial IS NOT NULL").select(
        F.col("query_id").cast("string"), "shop_domain", F.lower("partial").alias("partial")
    )
    visits = low.withColumn("place", F.explode(_ranges([(r["first"], r["last"]) for r in found])("shop_domain", "partial")))
    visits = cut_lineage(visits.withColumn("part", F.element_at(numbers, F.col("place") + 1)).drop("place"))
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(ASKED_BLOCK)).cast("bigint").alias("blocks")
    sizes = sizing.small_side(visits.groupBy("part").agg(blocks))
    left = table.join(sizes, "part").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    right = visits.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")
    schema = T._parse_datatype_string("query_id string, shop_domain string, title string, frequency bigint")
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_find(limit), schema).distinct()
