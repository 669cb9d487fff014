"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from cellquery import catalog
from check_oracle import compare, connect
from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SMALL, name) == ""


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["model", "seed", "accuracy"] and df.count() > 0


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
