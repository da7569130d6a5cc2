"""Every query with SQL gives the SQL's result on the small tables."""

import pytest

import __spark_entry__ as registry
from catalog.compare import differences
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = differences(spark, duck, SMALL, name)
    assert found is None or found == "no rows on either side", found


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["column", "count", "percentage"]
    assert df.count() > 0
