import pytest

from millrace.plans import problem_queries, reference_queries, stage_queries

QUERIES = {**reference_queries.QUERIES, **stage_queries.QUERIES, **problem_queries.QUERIES}
SQL = {**reference_queries.ORACLE, **stage_queries.ORACLE, **problem_queries.ORACLE}


@pytest.mark.parametrize("name", QUERIES)
def test_query(agrees, name):
    agrees(QUERIES[name], SQL.get(name))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
