"""Every query with an SQL twin gives the same rows as DuckDB (row count,
column names and types, order-insensitive values) at the driver's scale."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_DIR
from tools.oracle_check import compare

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, key):
    problems, n, _, _ = compare(spark, duck, key, QUERIES[key], ORACLES[key], SF_DIR)
    assert not problems, problems


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["district", "state", "literacy", "rnk"]
    assert len(rows) > 0 and all(r.rnk <= 3 for r in rows)
