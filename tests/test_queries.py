"""Every registered query runs; those with SQL equal DuckDB's rows."""

import importlib.util

import pytest

import __spark_entry__ as entry
from tests.oracle import assert_same

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert_same(df, duck, SQL[name])
    else:
        assert df.count() >= 0


def test_llm_is_optional():
    """Nothing outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(importlib.util.find_spec("brepflow").origin).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "brepflow.llm" not in path.read_text(), path
