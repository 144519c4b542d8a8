"""Registered queries: each runs an operator on the derived views of the test
tables and has, where SQL can express it, a DuckDB oracle with the same
column names. Every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # importing the modules registers their queries
    from demandflow.plans import (q_forecast, q_profile, q_clean, q_features,  # noqa: F401
                                  q_cluster, q_models, q_interpret, q_closed, q_requests)
    return REGISTRY
