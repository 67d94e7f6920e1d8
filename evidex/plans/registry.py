"""Names of queries, the functions behind them, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle over the given tables and views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            from evidex.sources.views import duck

            ORACLES[name] = duck(oracle)
        return f

    return add


def sql_list(values) -> str:
    """A SQL list literal of strings."""
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"
