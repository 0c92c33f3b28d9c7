"""Every registered query against its SQL twin."""

import os

import pytest
from oracle import connect, spark_rows, sql_rows

import __spark_entry__ as entry_point

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = spark_rows(QUERIES[name](spark, SF_DIR))
    assert result[1], "no rows"
    if name in ORACLES:
        expected = sql_rows(con, ORACLES[name])
        assert result[0] == expected[0]
        assert len(result[1]) == len(expected[1])
        assert result[1] == expected[1]


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    assert df.count() > 0
