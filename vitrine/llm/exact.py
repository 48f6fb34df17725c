"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash.

Only DataFrame functions. Lengths and prefix hashes come from one scan; the
full content is read and hashed again only for rows that still share both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import sizing
from vitrine.session import cut_lineage

PREFIX_CHARS = 256


def normalised(text: Column | str) -> Column:
    """Each run of white space as one space; NULL is empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[ \t-\r]+", " ")


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys more than one row has. The counts are combined before
    the shuffle, and a key with very many rows is split by the join."""
    several = rows.groupBy(*keys).count().filter("count > 1").select(*keys)
    return rows.join(sizing.small_side(several), keys, "left_semi")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that have an equal text elsewhere: (id, keep_id, group_size).

    Texts are equal when they agree after ``normalised``; NULL counts as empty.
    ``keep_id`` is the group's smallest id, ``group_size`` its number of rows,
    a repeated row (same id and text) counting each time but listed once. Rows
    without an id are compared with nothing. An id is taken to name one text.
    An empty table gives no rows; other columns play no part.
    """
    text = normalised(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).filter(F.col("id").isNotNull())
    sized = cut_lineage(
        rows.select(
            "id",
            F.octet_length("text").alias("size"),
            F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("head"),
        )
    )
    alike = _shared(_shared(sized, ["size"]), ["size", "head"])
    wanted = sizing.small_side(alike.select("id").distinct())
    hashed = cut_lineage(rows.join(wanted, "id", "left_semi").select("id", F.sha2("text", 256).alias("full")))
    groups = hashed.groupBy("full").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = sizing.small_side(groups.filter("group_size > 1"))
    members = hashed.join(groups, "full")
    return members.groupBy("id").agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, that of the smallest id, with all its
    columns. Of repeated rows one stays; rows without an id all stay."""
    found, own = cut_lineage(copies(docs, id_col, text_col)), F.col(f"`{id_col}`")
    dropped = sizing.small_side(found.filter("id <> keep_id").select(F.col("id").alias("_other")))
    kept = docs.join(dropped, own == F.col("_other"), "left_anti")
    firsts = found.filter("id = keep_id").select(F.col("id").alias("_other"))
    ids = docs.select(own.alias("_other"))
    repeated = ids.join(sizing.small_side(firsts), "_other", "left_semi").groupBy("_other").count().filter("count > 1")
    repeated = sizing.small_side(repeated.select("_other"))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, own == F.col("_other"), "left_semi").dropDuplicates([id_col])
    return kept.join(repeated, own == F.col("_other"), "left_anti").union(once)
