"""Every core query against its SQL on the smallest tables."""

import pytest
from compare import assert_same, views
from conftest import DATA

from emberline.plans import registry

FOLDER = DATA / "sf0.001"
SQL = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert_same(registry.queries()[name](spark, str(FOLDER)), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    df = registry.queries()[name](spark, str(FOLDER))
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
