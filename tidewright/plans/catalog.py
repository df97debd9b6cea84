"""Registry of the engine's queries and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Adds a query (a function of session and table folder), with its oracle where SQL has one."""

    def add(function: Callable) -> Callable:
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return add


def _load() -> None:
    """The modules of queries register them as they are imported."""
    from tidewright.plans import evaluation, feature_queries, model_queries, operation_queries, preparation, source_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
