"""All queries over the generated tables, with a SQL oracle for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name that no other has."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return put


def queries() -> dict[str, Query]:
    _load()
    return {name: _shipped(f) for name, f in _QUERIES.items()}


def _shipped(f: Query) -> Query:
    """Some functions run in Python workers, which need the package."""
    return lambda spark, sf_dir: f(ship(spark), sf_dir)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    from . import aggregates, clicks, families, functions, joins, more, scans, texts, tpch, writes  # noqa: F401
