import os

import duckdb
import pytest
from sqlcheck import DATA, compare, views

from tessel.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return views(duckdb.connect())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
