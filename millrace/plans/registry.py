"""Every query of the engine's own operators, with the DuckDB SQL that states the same result.

A plan module calls ``query(name, sql)`` as a decorator on a function of (spark, sf_dir).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("corpus", "sequences", "retrieval", "evals", "mining", "governance", "code", "sources", "tokens", "streams", "suites")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(plan: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return add


for _name in MODULES:
    importlib.import_module(f"millrace.plans.{_name}")
