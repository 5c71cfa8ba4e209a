"""The queries of this subpackage against their SQL on the smallest tables."""

import pytest

from tesserine.llm import queries
from tests.compare import same
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, str(DATA)), duck.execute(queries.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    assert df.collect() and len(set(df.columns)) == len(df.columns)
