"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opslake.sources.fixtures import Domain, with_views

_QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query over the domain tables, with the SQL giving the same rows."""

    def register(fn: Callable[[Domain], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return register


def _load() -> None:
    from opslake.plans import alerts, jobs, logs, metrics, notifications, quality, queue, statements  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def runner(fn):
        return lambda spark, directory: fn(Domain(spark, directory))

    return {name: runner(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, sql in _ORACLES.items()}
