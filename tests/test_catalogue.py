"""Every catalogued query runs on the smallest tables and agrees with its SQL twin."""

import pytest

import __spark_entry__ as entry
from framekit.plans import catalogue
from tests.conftest import SMALL
from tests.oracle_check import connect, differ


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    if name in catalogue.ORACLE_SQL:
        assert differ(df, con, catalogue.ORACLE_SQL[name]) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
