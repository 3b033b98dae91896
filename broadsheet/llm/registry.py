"""Where the query modules of this subpackage put their queries and DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register the decorated function under ``key``."""

    def register(function):
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return register
