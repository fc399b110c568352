import pytest

from helixlake.llm import queries
from tests import compare

pytestmark = pytest.mark.skipif(not compare.DATA.exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert compare.differences(spark, compare.oracle(), queries.QUERIES[name], queries.SQL[name]) == ([], [], 0)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, str(compare.DATA)).count() >= 0
