"""Catalogue snapshot comparison."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import jsonfields as J
from vitrine.functions import sizing, skew
from vitrine.operators import merge

KEYS = merge.PRODUCT_KEYS
# Key buckets of a snapshot, and their groups.
UPPER_BUCKETS, LOWER_BUCKETS = 4096, 4096


def compare(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Every incoming row with its change flags and class.

    Title and description compare null-safe, an absent incoming description
    counting as empty text; prices compare with NULL as zero. A new product is
    not a changed one. Repeated incoming keys are each compared with the stored
    row, and may be numerous, hence the salted join. A small snapshot's keys are
    sent to the stored table, of which only the matching rows are shuffled.
    """
    old = stored.select(
        *KEYS,
        F.col("title").alias("_title"),
        F.col("description").alias("_description"),
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("_price"),
        F.lit(True).alias("_known"),
    )
    keys = incoming.groupBy(*KEYS).count()
    wanted = sizing.small_side(keys.select(*KEYS))
    joined = skew.join(incoming, old.join(wanted, KEYS, "left_semi"), KEYS, "left", spread=["ordinal"], counts=keys)
    known = F.coalesce("_known", F.lit(False))
    description = F.coalesce("description", F.lit(""))
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    flags = {
        "title_changed": known & ~F.col("title").eqNullSafe(F.col("_title")),
        "description_changed": known & ~description.eqNullSafe(F.col("_description")),
        "price_changed": known & (price != F.col("_price")),
    }
    flagged = joined.withColumns({name: F.coalesce(test, F.lit(False)) for name, test in flags.items()})
    needs = F.col("title_changed") | F.col("description_changed") | F.col("price_changed")
    kind = F.when(~known, "new").when(needs, "updated").otherwise("unchanged")
    return flagged.withColumns({"needs_update": needs, "change_class": kind}).select(
        *incoming.columns, *flags, "needs_update", "change_class"
    )


def _digested(rows: DataFrame, description: Column) -> DataFrame:
    """Key buckets on two levels, and two hashes of what ``compare`` looks at."""
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    fields = [*KEYS, "title", F.col("title").isNull(), description, description.isNull(), price]
    key = F.xxhash64(*KEYS)
    return rows.withColumns(
        {
            "_upper": F.pmod(key, F.lit(UPPER_BUCKETS)),
            "_lower": F.pmod(F.shiftright(key, 32), F.lit(LOWER_BUCKETS)),
            "_h": F.xxhash64(*fields),
            "_g": F.xxhash64(F.lit(1), *fields),
        }
    )


def _unequal(one: DataFrame, other: DataFrame, level: list[str]) -> DataFrame:
    """Buckets of a level whose rows differ: their digests, which no order of rows changes, are compared."""
    low = F.lit(0xFFFFFFFF)
    digest = F.struct(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("_h").alias("h"),
        F.bit_xor("_g").alias("g"),
        F.sum(F.col("_h").bitwiseAND(low)).alias("hs"),
        F.sum(F.col("_g").bitwiseAND(low)).alias("gs"),
    )
    left, right = (rows.groupBy(*level).agg(digest.alias(name)) for rows, name in ((one, "_one"), (other, "_other")))
    return left.join(right, level, "full").filter(~F.col("_one").eqNullSafe(F.col("_other"))).select(*level)


def compare_by_digest(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``compare`` for snapshots of which little has changed.

    Rows are hashed into key buckets, buckets into upper buckets. Only digests of the
    upper buckets are shuffled, then those of the buckets in unequal upper ones, and
    rows only where buckets are unequal; rows of equal buckets are unchanged. The
    stored keys must be unique. Both tables are scanned three times: pass stored ones.
    """
    new = _digested(incoming, F.coalesce("description", F.lit("")))
    old = _digested(stored, F.col("description"))
    upper = sizing.small_side(_unequal(new, old, ["_upper"]))
    opened = [rows.join(upper, ["_upper"], "left_semi") for rows in (new, old)]
    lower = sizing.small_side(_unequal(*opened, ["_upper", "_lower"]))
    changed = compare(new.join(lower, ["_upper", "_lower"], "left_semi"), old.join(lower, ["_upper", "_lower"], "left_semi"))
    no = {name: F.lit(False) for name in ("title_changed", "description_changed", "price_changed", "needs_update")}
    rest = new.join(lower, ["_upper", "_lower"], "left_anti").withColumns({**no, "change_class": F.lit("unchanged")})
    columns = [*incoming.columns, *no, "change_class"]
    return changed.select(*columns).unionByName(rest.select(*columns))


def change_report(compared: DataFrame) -> DataFrame:
    return compared.filter("needs_update").select(
        *KEYS, "ordinal", "title", "title_changed", "description_changed", "price_changed"
    )


def class_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("shop_domain", "change_class").agg(F.count(F.lit(1)).alias("products"))


def apply_snapshot(incoming: DataFrame, stored: DataFrame, as_of: datetime) -> DataFrame:
    """Merge an incoming snapshot: the resync flag of each row goes into its
    metadata, the last of repeated rows wins, embeddings stay untouched."""
    compared = compare(incoming, stored)
    flagged = compared.withColumn("metadata", J.set_flag("metadata", "needs_resync", F.col("needs_update")))
    described = flagged.withColumn("description", F.coalesce("description", F.lit("")))
    last = merge.keep_last(described.select(*incoming.columns), KEYS)
    return merge.upsert_product_info(stored, last, as_of)


def missing_vectors(catalog: DataFrame, shop: str | None = None, limit: int | None = None) -> DataFrame:
    """Products not embedded yet, in a fixed order when limited."""
    rows = catalog.filter(F.col("embedding").isNull())
    if shop:
        rows = rows.filter(F.col("shop_domain") == shop)
    return rows if limit is None else rows.orderBy("product_id", "shop_domain").limit(limit)


def flagged_for_resync(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.get_json_object("metadata", "$.needs_resync") == "true")
