"""Every registered query against its SQL on the smallest driver tables."""

import pytest
from check import duck, duck_rows, spark_rows

from __spark_entry__ import entry, oracle_sql, queries
from ripplemap.bridge import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    got = spark_rows(queries()[name](spark, SMALL))
    assert name in oracle_sql()
    assert got == duck_rows(con, oracle_sql()[name])


def test_entry(spark):
    assert entry(spark).columns[:2] == ["profile", "scope_id"]
