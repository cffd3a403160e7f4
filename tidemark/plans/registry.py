"""Where queries and their SQL twins are filed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """File a query under ``name``; without ``sql`` only its rows can be checked."""

    def file(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return file


MODULES = [
    "q_diff",
    "q_filters",
    "q_patches",
    "q_merge",
    "q_imports",
    "q_history",
    "q_workspace",
    "q_scalars",
    "q_spatial",
    "q_tiles",
    "q_streams",
]


def load_all() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"tidemark.plans.{name}")
