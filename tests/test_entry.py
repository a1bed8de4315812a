import sys

import pytest

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_other_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("larkspur.llm")] + ["larkspur.llm"]:
        monkeypatch.setitem(sys.modules, name, None)
    names = entry.queries()
    assert "temporal_cube" in names and not any(n.startswith("op1_") for n in names)


def test_core_queries_survive_a_missing_library(monkeypatch):
    """What the other subpackage needs may be missing: its queries are left out with a warning, the rest stay."""
    if "op1_sharding" not in entry.queries():
        pytest.skip("the subpackage isn't here")
    for name in [n for n in sys.modules if n.startswith("larkspur.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.warns(UserWarning, match="xxhash"):
        names = entry.queries()
    assert "temporal_cube" in names and "op2_line_dedup" not in names and "pipeline" not in names
