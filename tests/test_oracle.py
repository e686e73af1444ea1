"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as registered
from compare import connect, differences
from conftest import FOLDER

ORACLES = registered.oracle_sql()
QUERIES = registered.queries()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    assert differences(spark, QUERIES[name], ORACLES[name], FOLDER, db) == []


def test_entry(spark):
    assert registered.entry(spark).count() == 1
