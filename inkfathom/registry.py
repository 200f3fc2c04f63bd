
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the function under its own name. ``covers``: row ids, blank-separated."""

    def put(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put
