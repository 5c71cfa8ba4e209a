"""Every query of the core against its SQL on the smallest tables; those without SQL must give a stable schema."""

import pytest

from tesserine.plans import catalogue
from tests.compare import same
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, str(DATA)), duck.execute(catalogue.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
