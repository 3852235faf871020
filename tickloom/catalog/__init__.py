"""Registered queries: one Spark callable each, and the oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import apply_defaults

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "ticks",
    "book",
    "families",
    "sequences",
    "lifecycle",
    "crosssection",
    "panels",
    "evidence",
    "series",
    "market",
    "daily",
    "live",
)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_defaults(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from importlib.util import find_spec

    for module in MODULES:
        if find_spec(f"tickloom.catalog.{module}"):
            import_module(f"tickloom.catalog.{module}")
    return QUERIES, ORACLES
