"""Statement statistics and index catalogue of a monitored database, read in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# What is asked of the database.
STATEMENTS_QUERY = """
SELECT query, calls, mean_exec_time, max_exec_time, rows, shared_blks_hit, shared_blks_read
FROM pg_stat_statements
WHERE mean_exec_time > {threshold} AND query NOT LIKE '%pg_stat_statements%'
ORDER BY mean_exec_time DESC LIMIT {limit}"""
INDEXES_QUERY = """
SELECT tablename, indexdef FROM pg_indexes WHERE schemaname NOT IN ('pg_catalog', 'information_schema')"""


def statements_query(threshold_ms: float = 1000, limit: int = 100) -> str:
    return STATEMENTS_QUERY.format(threshold=float(threshold_ms), limit=int(limit)).strip()


def _read(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_statements(
    spark: SparkSession, url: str, threshold_ms: float = 1000, limit: int = 100, **options: str
) -> DataFrame:
    """Top slow statements; filter, order and limit run in the database."""
    return _read(spark, url, statements_query(threshold_ms, limit), **options)


def read_indexes(spark: SparkSession, url: str, **options: str) -> DataFrame:
    return _read(spark, url, INDEXES_QUERY.strip(), **options)
