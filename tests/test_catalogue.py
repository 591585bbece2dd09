"""Every named query runs; those with a SQL twin give the same rows and types."""

import pytest
from compare import differences, duck, duck_rows, spark_rows
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries

NAMES, ORACLES = sorted(queries()), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(NAMES)


def test_entry(spark):
    assert len(entry(spark).columns) == 35


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    found = spark_rows(queries()[name](spark, SF))
    if name in ORACLES:
        assert differences(found, duck_rows(con, ORACLES[name])) is None
    else:
        assert found[1]
