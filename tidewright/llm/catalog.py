"""Queries of this subpackage, by name; oracles where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from tidewright.llm import corpus_queries

_FOUND = {k: f for k, f in vars(corpus_queries).items() if k.startswith("op") and callable(f)}


def queries() -> dict[str, Callable]:
    return dict(sorted(_FOUND.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(corpus_queries.ORACLES)
