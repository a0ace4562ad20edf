import os

import pytest

from foliora.plans.oracles import SQL
from foliora.plans.queries import QUERIES
from tests import compare

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connection()


def test_every_statement_has_its_query():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    compare.same(spark, con, QUERIES[name], SQL[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and entry.queries().keys() >= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, compare.DATA).count() > 0
