"""Registered queries with the DuckDB statements they are checked against."""

from __future__ import annotations

from importlib import import_module

from broadsheet.queryset import registry

_MODULES = [
    "warehouse_queries", "report_queries", "vector_queries", "search_queries", "answer_queries",
    "page_queries", "stream_queries",
]


def _load() -> None:
    for name in _MODULES:
        import_module(f"broadsheet.queryset.{name}")


def all_queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(registry.ORACLES)
