"""Size checks before a broadcast.

Adaptive execution finds out that a join side is small only after both sides
were shuffled. Where the other side is the catalogue that is too late, so the
possibly small side is computed first, measured, and broadcast if it is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.session import cut_lineage

MAX_BROADCAST_BYTES = 64 << 20


def _width(field: T.StructField) -> Column:
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column).cast("bigint") + 8
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
        size = F.size(column).cast("bigint") * 8 + 8
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        size = F.octet_length(column.cast("string")).cast("bigint") * 2 + 16
    else:
        size = F.lit(16).cast("bigint")
    return F.coalesce(F.greatest(size, F.lit(8).cast("bigint")), F.lit(8).cast("bigint"))


def _total_bytes(rows: DataFrame) -> Column:
    row = reduce(lambda a, b: a + b, [_width(f) for f in rows.schema.fields], F.lit(16).cast("bigint"))
    return F.coalesce(F.sum(row), F.lit(0)).alias("bytes")


def is_small(rows: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether the rows take no more than ``max_bytes``, by their own widths."""
    return rows.agg(_total_bytes(rows)).first()["bytes"] <= max_bytes


def settle(rows: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """The rows computed once and kept, and whether they are small.

    The size is observed while they are written, so it costs no further pass.
    """
    size = Observation()
    kept = cut_lineage(rows.observe(size, _total_bytes(rows)))
    return kept, size.get["bytes"] <= max_bytes


def small_side(rows: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The rows computed once, marked for broadcast if they are small."""
    kept, small = settle(rows, max_bytes)
    return F.broadcast(kept) if small else kept


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined to the matching rows of a large table.

    With few distinct keys the table is only scanned: it is first cut down to
    the wanted keys by a broadcast semi-join.
    """
    wanted = small_side(rows.select(*keys).distinct())
    return rows.join(table.join(wanted, keys, "left_semi"), keys, how)
