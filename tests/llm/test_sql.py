import pytest

from gridloom.llm.queries import ORACLES, QUERIES
from oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01")
