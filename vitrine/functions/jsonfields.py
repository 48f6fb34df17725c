"""Typed access to, and edits of, the JSON text columns.

``try_variant_get`` returns NULL on bad text where a plain cast would raise
under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP_TYPE = "map<string,variant>"


def _column(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def _variant(doc: str | Column, key: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(_column(doc)), f"$.{key}", kind)


def flag(doc: str | Column, key: str, default: bool | None = False) -> Column:
    value = _variant(doc, key, "boolean")
    return value if default is None else F.coalesce(value, F.lit(default))


def integer(doc: str | Column, key: str, default: int | None = 0) -> Column:
    value = _variant(doc, key, "bigint")
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def number(doc: str | Column, key: str, default: float | None = None) -> Column:
    value = _variant(doc, key, "double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def string(doc: str | Column, key: str, default: str | None = None) -> Column:
    value = F.get_json_object(_column(doc), f"$.{key}")
    return value if default is None else F.coalesce(value, F.lit(default))


def string_list(doc: str | Column, key: str) -> Column:
    return F.coalesce(_variant(doc, key, "array<string>"), F.array().cast("array<string>"))


def as_map(doc: str | Column) -> Column:
    """The document as a map of variants; NULL or unreadable text counts as ``{}``."""
    parsed = F.from_json(_column(doc), _MAP_TYPE)
    return F.coalesce(parsed, F.from_json(F.lit("{}"), _MAP_TYPE))


def set_flag(doc: str | Column, key: str, value: Column) -> Column:
    """Add or replace one boolean key, keeping the others."""
    kept = F.map_filter(as_map(doc), lambda k, _: k != key)
    entry = F.create_map(F.lit(key), F.parse_json(value.cast("string")))
    return F.to_json(F.map_concat(kept, entry), {"ignoreNullFields": "false"})


def drop_key(doc: str | Column, key: str) -> Column:
    return F.to_json(F.map_filter(as_map(doc), lambda k, _: k != key), {"ignoreNullFields": "false"})


def document(*columns: Column | str) -> Column:
    """One JSON object per row; NULL fields stay visible."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
