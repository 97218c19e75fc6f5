"""Registered queries: one per operator of the survey's inventory, each with
an equivalent DuckDB SQL text where the operator has a SQL meaning.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables
(through the role layer), whole tables, no row caps.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` as query ``name`` with its oracle SQL (if any)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from stormrail.catalog import (  # noqa: F401
        q_scalar, q_filters, q_windows, q_aggregates, q_joins, q_sequences,
        q_sampling, q_metrics, q_models, q_plans, q_io,
    )
