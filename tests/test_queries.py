"""Every query of the motion library against its SQL."""

import pytest

from posegrid.plans import catalog
from tests.sql_compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.ORACLES:
        compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES[name])
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
