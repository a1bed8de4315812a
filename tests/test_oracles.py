import os

import pytest
from oracle import connect, same

from larkspur.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert same(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
