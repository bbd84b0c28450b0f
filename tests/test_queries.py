"""Every registered query against its SQL twin, whole results, on the given tables."""

import os

import pytest
from compare import spark_rows, sql_connection, sql_rows

import __spark_entry__ as contract
from threadloom.plans.oracles import ORACLES
from threadloom.plans.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return sql_connection(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, con, name):
    got = spark_rows(contract.queries()[name](spark, SF_DIR))
    assert got == sql_rows(con, contract.oracle_sql()[name])


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["conversid", "messageid", "instruction", "input", "output"]
    assert rows.count() > 0
