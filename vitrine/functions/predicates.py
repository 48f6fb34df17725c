"""Row predicates. Each returns a Column; ``all_of`` folds the ones in use."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import jsonfields as J


def all_of(conditions: Iterable[Column | None]) -> Column:
    """Conjunction of the given conditions; an absent one (None) does not filter."""
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def tenant(shop: str | None) -> Column | None:
    return F.col("shop_domain") == shop if shop else None


def tenant_in_metadata(shop: str) -> Column | None:
    """Tenant named in the metadata; the empty string matches every row."""
    return F.get_json_object("metadata", "$.shop") == shop if shop else None


def price_between(low: float | None = None, high: float | None = None, column: str = "price") -> Column | None:
    """Closed range. Zero is a real bound; a NULL price never passes a bound."""
    bounds = []
    if low is not None:
        bounds.append(F.col(column) >= F.lit(low))
    if high is not None:
        bounds.append(F.col(column) <= F.lit(high))
    return all_of(bounds) if bounds else None


def in_stock_flag() -> Column:
    return J.flag("metadata", "in_stock")


def not_archived() -> Column:
    return ~J.flag("metadata", "archived")


def has_embedding() -> Column:
    return F.col("embedding").isNotNull()


def missing_embedding() -> Column:
    return F.col("embedding").isNull()


def needs_resync() -> Column:
    return F.get_json_object("metadata", "$.needs_resync") == "true"


def contains(column: str, fragment: str | None) -> Column | None:
    """Case-insensitive containment; ``%`` and ``_`` in the fragment are wildcards."""
    return F.col(column).ilike(f"%{fragment}%") if fragment else None


def any_tag(tags: list[str] | None, column: str = "tags") -> Column | None:
    if not tags:
        return None
    return F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(t) for t in tags])), F.lit(False))


def any_of(column: str, values: list[str] | None) -> Column | None:
    return F.col(column).isin(values) if values else None


def stocked(column: str = "inventory_quantity") -> Column:
    return F.coalesce(F.col(column), F.lit(0)) > 0


def since_days(column: str, as_of: datetime, days: int) -> Column:
    """Closed trailing window of whole days before ``as_of``, without an upper bound."""
    return F.col(column) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(days)}' DAY")


def within_hours(column: str, as_of: datetime, hours: int) -> Column:
    """Strictly later than ``as_of`` minus ``hours``."""
    return F.col(column) > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(hours)}' HOUR")


def not_blank(column: str) -> Column:
    return F.length(F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)\s+", " "))) > 0


def product_filters(
    price_min: float | None = None,
    price_max: float | None = None,
    vendor: str | None = None,
    product_type: str | None = None,
    tags: list[str] | None = None,
    in_stock: bool = False,
) -> Column:
    """Filters of the storefront search; ``None`` or an empty value means unused."""
    return all_of(
        [
            F.col("price_min") >= F.lit(price_min) if price_min is not None else None,
            F.col("price_max") <= F.lit(price_max) if price_max is not None else None,
            contains("vendor", vendor),
            contains("product_type", product_type),
            any_tag(tags),
            stocked() if in_stock else None,
        ]
    )
