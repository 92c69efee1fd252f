"""Every registered query beside its SQL on the smallest tables."""

import pytest
from compare import compare, engine

import __spark_entry__ as entry
from scoreloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return engine(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    status, n, _, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert status == "same", f"{status} {note}"
    assert not note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1500 and "grade" in df.columns
