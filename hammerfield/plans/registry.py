"""Named queries and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The modules that register queries.
MODULES = ("search", "counts", "scalars", "runlog", "entities", "ingesting", "notices", "listings", "pages", "site", "streams", "sites", "upkeep")


def query(name: str, oracle: str | None = None):
    """Register f(views) under a name; oracle is DuckDB SQL over the driver tables and the proxy views."""

    def add(f):
        from .proxies import Views, oracle_views

        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle_views(oracle)
        return f

    return add


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"hammerfield.plans.{name}")
