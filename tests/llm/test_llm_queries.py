import pytest

from millrace.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query(agrees, name):
    agrees(QUERIES[name], ORACLE.get(name))
