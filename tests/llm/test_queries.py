import os

import pytest
from oracle import connect, same

import __spark_entry__ as entry
from larkspur.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert same(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) > 0


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
