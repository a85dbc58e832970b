"""Every query with SQL gives DuckDB's rows."""

import pytest
from compare import difference

from semloom.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert difference(registry.queries()[name](spark, sf), SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_imports_without_the_training_data_operators():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
