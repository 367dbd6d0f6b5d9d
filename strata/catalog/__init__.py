"""Registered queries: one Spark query per operator of the inventory, each paired (where the
semantics are SQL-expressible) with an equivalent DuckDB oracle over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from ._registry import REGISTRY, Query, query  # noqa: F401
from . import retrieval, text, extraction, answers, dedup, storage, reports, streams  # noqa: F401,E402


def queries() -> dict[str, Callable]:
    return {name: q.fn for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
