"""Set-based writes: every upsert returns the next snapshot of a table.

A merge is an update of the stored side by a left join plus an append of the
incoming keys that were not found. The incoming batch is computed once and
measured; a small one is broadcast to both joins, so that the stored table,
vectors included, is not shuffled. Of a large one only the keys are counted and
compared beforehand: wide columns cross the network once, those of stored rows
that are overwritten not at all.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import jsonfields as J
from vitrine.functions import sizing
from vitrine.session import cut_lineage
from vitrine.sources import seeds

PRODUCT_KEYS = ["shop_domain", "product_id"]
# A batch whose keys alone take more than this is not written down to be measured, but merged as a large one.
MAX_KEY_BYTES = sizing.MAX_BROADCAST_BYTES // 8


def _moment(as_of: datetime) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _named(rows: DataFrame, wanted: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` with (``left_semi``) or without (``left_anti``) the few keys of ``wanted``; NULL equals NULL."""
    few = F.broadcast(wanted.select(*[F.col(k).alias(f"_wanted_{k}") for k in keys]))
    return rows.join(few, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_wanted_{k}")) for k in keys]), how)


def keep_last(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The last row per key. Keys are counted first, without the other columns: unless very many
    are repeated, only their rows are gathered, and all others stay where they are."""
    others = [c for c in rows.columns if c not in keys]

    def last(some: DataFrame) -> DataFrame:
        newest = some.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("_row"))
        return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])

    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.count(ordinal).alias("_placed"))
    gathered, small = sizing.settle(counts.filter("_rows > 1 OR _placed = 0").select(*keys))
    if not small:
        return last(rows)
    if gathered.isEmpty():
        return rows.select(*keys, *others)
    alone = _named(rows, gathered, keys, "left_anti").select(*keys, *others)
    return alone.unionByName(last(_named(rows, gathered, keys, "left_semi")))


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with one row per key: the last by ``ordinal`` if there is such a column, else
    the greatest. Nothing is shuffled unless some key is repeated."""
    if rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        return rows
    if "ordinal" in rows.columns:
        return keep_last(rows, keys).select(*rows.columns)
    others = [c for c in rows.columns if c not in keys]
    greatest = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row"))
    return greatest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def _unmatched(incoming: DataFrame, stored: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Incoming rows with no stored key; a small batch goes to the stored keys."""
    wanted = incoming.select(*keys)
    if small or sizing.is_small(wanted):
        wanted = F.broadcast(wanted)
    known = stored.select(*keys).join(wanted, keys, "left_semi")
    return incoming.join(known, keys, "left_anti")


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    on_update: dict[str, Column],
    on_insert: dict[str, Column],
) -> DataFrame:
    """General merge. In ``on_update`` incoming columns are named ``new.<column>``
    and stored ones ``old.<column>``; in ``on_insert`` plain names are incoming.
    Columns left out keep the stored value, or are NULL in a new row. Of rows that
    repeat a key the last one counts (see ``one_per_key``)."""
    small = sizing.is_small(incoming.select(*keys), MAX_KEY_BYTES)
    if small:
        incoming, small = sizing.settle(incoming)
    incoming = one_per_key(incoming, keys)
    if not small:
        return _merged(stored, incoming, keys, on_update, on_insert)
    hits = incoming.withColumn("_hit", F.lit(True))
    old, new = stored.alias("old"), F.broadcast(hits).alias("new")
    matches = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    joined = old.join(new, matches, "left")
    updated = joined.select(
        *[
            F.when(F.col("new._hit"), on_update[c]).otherwise(F.col(f"old.{c}")).alias(c)
            if c in on_update
            else F.col(f"old.{c}").alias(c)
            for c in stored.columns
        ]
    )
    return updated.unionByName(_unmatched(incoming, stored, keys, small).select(*_inserted(stored, keys, on_insert)))


def _inserted(stored: DataFrame, keys: list[str], on_insert: dict[str, Column]) -> list[Column]:
    kinds = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    return [on_insert.get(c, F.col(c) if c in keys else F.lit(None)).cast(kinds[c]).alias(c) for c in stored.columns]


def _merged(
    stored: DataFrame, incoming: DataFrame, keys: list[str], on_update: dict[str, Column], on_insert: dict[str, Column]
) -> DataFrame:
    """``upsert`` of a large batch with one row per key.

    If few keys are on one side only, their rows are picked by a broadcast, and the rows of common
    keys are joined, of the stored ones just what an update keeps. Else all rows meet in one
    full join."""
    have, come = stored.select(*keys), incoming.select(*keys)
    kept, few_kept = sizing.settle(have.join(come, keys, "left_anti").distinct())
    added, few_added = sizing.settle(come.join(have, keys, "left_anti"))
    old, new = stored.alias("old"), incoming.alias("new")
    matches = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    inserted = _inserted(stored, keys, on_insert)
    if few_kept and few_added:
        changed = [on_update.get(c, F.col(f"old.{c}")).alias(c) for c in stored.columns]
        next_rows = old.join(new, matches).select(*changed)
        if not kept.isEmpty():
            next_rows = next_rows.unionByName(_named(stored, kept, keys, "left_semi"))
        if not added.isEmpty():
            next_rows = next_rows.unionByName(_named(incoming, added, keys, "left_semi").select(*inserted))
        return next_rows
    old = stored.withColumn("_old", F.lit(True)).alias("old")
    new = incoming.withColumn("_hit", F.lit(True)).alias("new")
    # As structs both sides keep the names that ``on_update`` has, and plain names are the incoming columns.
    both = old.join(new, matches, "full").select(
        F.struct(*[F.col(f"old.{c}") for c in [*stored.columns, "_old"]]).alias("old"),
        F.struct(*[F.col(f"new.{c}") for c in [*incoming.columns, "_hit"]]).alias("new"),
        *[F.col(f"new.{c}").alias(c) for c in incoming.columns],
    )
    return both.select(
        *[
            F.when(F.col("old._old") & F.col("new._hit"), on_update.get(c, F.col(f"old.{c}")))
            .when(F.col("old._old"), F.col(f"old.{c}"))
            .otherwise(fresh)
            .alias(c)
            for c, fresh in zip(stored.columns, inserted, strict=True)
        ]
    )


_INFO = ["title", "description", "price", "vendor", "category"]


def _product_values(prefix: str) -> dict[str, Column]:
    values = {c: F.col(f"{prefix}{c}") for c in _INFO}
    values["tags"] = F.coalesce(F.col(f"{prefix}tags"), F.array().cast("array<string>"))
    values["metadata"] = F.coalesce(F.col(f"{prefix}metadata"), F.lit("{}"))
    return values


def upsert_products(stored: DataFrame, incoming: DataFrame, as_of: datetime) -> DataFrame:
    """Full upsert: every field is overwritten, the embedding included (a NULL
    clears it). ``created_at`` survives, ``updated_at`` becomes ``as_of``."""
    now = _moment(as_of)
    update = {**_product_values("new."), "embedding": F.col("new.embedding"), "updated_at": now}
    insert = {**_product_values(""), "embedding": F.col("embedding"), "created_at": now, "updated_at": now}
    return upsert(stored, incoming, PRODUCT_KEYS, update, insert)


def upsert_product_info(stored: DataFrame, incoming: DataFrame, as_of: datetime) -> DataFrame:
    """Upsert that never touches embeddings; metadata is replaced, not merged."""
    return upsert(stored, incoming, PRODUCT_KEYS, *_info_values(as_of))


def _info_values(as_of: datetime) -> tuple[dict[str, Column], dict[str, Column]]:
    now = _moment(as_of)
    return {**_product_values("new."), "updated_at": now}, {**_product_values(""), "created_at": now, "updated_at": now}


def upsert_info_and_vectors(stored: DataFrame, incoming: DataFrame, vectors: DataFrame, as_of: datetime) -> DataFrame:
    """``upsert_product_info``, and for the products in ``vectors`` (keys, ``embedding``, ``text_key``;
    one row per key, all of them incoming) the vector and its text key, the resync flag off."""
    made = vectors.select(*PRODUCT_KEYS, F.col("embedding").alias("_vector"), F.col("text_key").alias("_made"))
    update, insert = _info_values(as_of)
    for values, new, old in ((update, "new.", "old."), (insert, "", None)):
        has = F.col(f"{new}_vector").isNotNull()
        values["metadata"] = F.when(has, J.set_flag(values["metadata"], "needs_resync", F.lit(False))).otherwise(values["metadata"])
        for column, source in (("embedding", "_vector"), ("text_key", "_made")):
            before = F.lit(None) if old is None else F.col(f"{old}{column}")
            values[column] = F.when(has, F.col(f"{new}{source}")).otherwise(before)
    return upsert(stored, incoming.join(made, PRODUCT_KEYS, "left"), PRODUCT_KEYS, update, insert)


def write_back_embeddings(
    stored: DataFrame, vectors: DataFrame, as_of: datetime, clear: str = "set_false"
) -> tuple[DataFrame, DataFrame]:
    """Store new vectors (keys plus ``embedding``) and settle the resync flag:
    ``set_false`` writes it as false, ``remove`` deletes it. ``vectors`` is read once.

    Returns the next snapshot and the vectors whose product is unknown.
    """
    if clear == "set_false":
        settled = J.set_flag(F.coalesce(F.col("old.metadata"), F.lit("{}")), "needs_resync", F.lit(False))
    else:
        settled = J.drop_key(F.col("old.metadata"), "needs_resync")
    update = {
        "embedding": F.col("new.embedding").cast(stored.schema["embedding"].dataType.simpleString()),
        "metadata": settled,
        "updated_at": _moment(as_of),
    }
    old = stored.alias("old")
    vectors, small = sizing.settle(vectors)
    vectors = one_per_key(vectors, PRODUCT_KEYS)
    hits = vectors.select(*PRODUCT_KEYS, "embedding").withColumn("_hit", F.lit(True))
    new = (F.broadcast(hits) if small else hits).alias("new")
    joined = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in PRODUCT_KEYS], "left")
    snapshot = joined.select(
        *[
            F.when(F.col("new._hit"), update[c]).otherwise(F.col(f"old.{c}")).alias(c)
            if c in update
            else F.col(f"old.{c}").alias(c)
            for c in stored.columns
        ]
    )
    return snapshot, _unmatched(vectors, stored, PRODUCT_KEYS, small)


def add_usage(stored: DataFrame, increments: DataFrame) -> DataFrame:
    """Additive upsert of daily counters."""
    keys = ["shop_domain", "usage_type", "usage_date"]
    rows = stored.select(*keys, "usage_count").unionByName(increments.select(*keys, "usage_count"))
    return rows.groupBy(*keys).agg(F.sum("usage_count").cast("bigint").alias("usage_count"))


def last_write_wins(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """Newest value per settings key; a tie in time goes to the greater value."""
    columns = ["key", "value", "updated_at"]
    rows = stored.select(*columns).unionByName(writes.select(*columns))
    newest = rows.groupBy("key").agg(F.max(F.struct("updated_at", "value")).alias("_last"))
    return newest.select("key", F.col("_last.value").alias("value"), F.col("_last.updated_at").alias("updated_at"))


def upsert_plans(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Price and limits of known plans change; unknown plans are added as active, with
    ids that follow the largest one in order of their names."""
    fields = ["price", "max_products", "max_searches_per_month"]
    insert = {c: F.col(c) for c in ["name", *fields]}
    insert |= {"features": F.lit(seeds.DEFAULT_PLAN_FEATURES), "active": F.lit(True)}
    merged = cut_lineage(upsert(stored, incoming, ["name"], {c: F.col(f"new.{c}") for c in fields}, insert))
    last = merged.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    following = F.row_number().over(Window.partitionBy(F.col("id").isNull()).orderBy("name"))
    new = F.when(F.col("id").isNull(), last + following).otherwise(F.col("id"))
    return merged.withColumn("id", new.cast(stored.schema["id"].dataType))


def deactivate_plans(plans: DataFrame, names: list[str]) -> DataFrame:
    return plans.withColumn("active", F.when(F.col("name").isin(names), F.lit(False)).otherwise(F.col("active")))


def active_plans(plans: DataFrame) -> DataFrame:
    return plans.filter("active").orderBy(F.asc_nulls_last("price"), "name")


def upgrade_subscriptions(
    subscriptions: DataFrame, requests: DataFrame, plans: DataFrame, as_of: date
) -> tuple[DataFrame, DataFrame]:
    """Apply upgrade requests (``shop_domain, plan_name, ordinal``): the new plan,
    active, with a 30-day cycle from ``as_of``. A tenant's last valid request wins.

    Returns the next subscriptions and the requests naming no active plan.
    """
    offered = plans.filter("active").select(F.col("name").alias("plan_name"), F.col("id").alias("plan_id"))
    accepted = keep_last(requests.join(offered, "plan_name"), ["shop_domain"])
    today = F.lit(as_of).cast("date")
    cycle = {
        "status": F.lit("active"),
        "billing_cycle_start": today,
        "billing_cycle_end": F.date_add(today, 30),
    }
    update = {"plan_id": F.col("new.plan_id"), **cycle}
    insert = {"plan_id": F.col("plan_id"), "searches_this_month": F.lit(0), "search_reset_date": today, **cycle}
    merged = upsert(subscriptions, accepted, ["shop_domain"], update, insert)
    return merged, requests.join(offered, "plan_name", "left_anti")


def subscribe_new(
    subscriptions: DataFrame, tenants: DataFrame, plans: DataFrame, as_of: date, plan_name: str = seeds.DEFAULT_PLAN
) -> DataFrame:
    """Add a default subscription for every tenant that has none."""
    today = F.lit(as_of).cast("date")
    plan = plans.filter(F.col("name") == plan_name).groupBy().agg(F.min("id").alias("plan_id"))
    new = tenants.select("shop_domain").distinct().join(subscriptions, "shop_domain", "left_anti")
    kinds = {f.name: f.dataType.simpleString() for f in subscriptions.schema.fields}
    values = {
        "shop_domain": F.col("shop_domain"),
        "plan_id": plan.scalar(),
        "status": F.lit("active"),
        "searches_this_month": F.lit(0),
        "search_reset_date": today,
        "billing_cycle_start": today,
        "billing_cycle_end": F.date_add(today, 30),
    }
    added = new.select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in subscriptions.columns])
    return subscriptions.unionByName(added)


def initialise_config(settings: DataFrame, tenants: DataFrame, config_json: str, as_of: datetime) -> DataFrame:
    """Write the installation defaults for tenants without a configuration."""
    keyed = tenants.select(F.concat_ws(":", "shop_domain", F.lit("ai_search")).alias("key")).distinct()
    added = keyed.join(settings, "key", "left_anti").select(
        "key", F.lit(config_json).alias("value"), _moment(as_of).alias("updated_at")
    )
    return settings.select("key", "value", "updated_at").unionByName(added)


def write_snapshot(table: DataFrame, path: str, partition: str = "shop_domain", rows_per_file: int = 1_000_000) -> None:
    """Write a snapshot to a new path, partitioned by tenant.

    The rebalance hint lets adaptive execution split a hot tenant over several
    writers and merge small ones. The path read from is never the path written.
    """
    (
        table.hint("rebalance", partition)
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(partition)
        .parquet(path)
    )


def replace_tenants(table: DataFrame, path: str, partition: str = "shop_domain") -> None:
    """Overwrite only the tenants present in ``table``, leaving the other partitions."""
    (
        table.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def search_events(results: DataFrame, as_of: datetime) -> DataFrame:
    """One event per request: ``query_id, query, shop_domain, results_count`` in,
    the logged event out (original query and filters kept beside the corrected one)."""
    return results.select(
        F.lit("search").alias("event_type"),
        _moment(as_of).alias("timestamp"),
        F.col("corrected_query").alias("query"),
        F.col("query").alias("original_query"),
        "results_count",
        F.col("shop_domain").alias("store_id"),
        F.col("query_id").cast("string").alias("session_id"),
        J.document("max_price", "k", "min_similarity").alias("filters"),
    )
