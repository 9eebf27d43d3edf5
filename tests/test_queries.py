import pytest

import __spark_entry__ as entry_points
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None
