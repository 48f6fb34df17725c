"""Bindings of the operators to the given tables, and their registered queries."""

from __future__ import annotations

import importlib

from vitrine.plans.registry import ORACLES, QUERIES, Query

_MODULES = ["search_queries", "table_queries", "analytics_queries", "stream_queries"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"vitrine.plans.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
