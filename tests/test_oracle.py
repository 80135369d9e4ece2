"""Every registered query with its SQL, at the smallest scale."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name not in ORACLES:
        pytest.skip("no SQL for this query")
    problems, _ = compare(spark, duck, DATA, QUERIES[name], ORACLES[name])
    assert not problems


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert "p95_duration_ms" in df.columns and df.count() > 0
