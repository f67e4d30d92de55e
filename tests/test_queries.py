"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from compare import difference
from suite.registry import QUERIES, SQL


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(registry.queries()) and set(SQL) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(name, spark, con, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan
    assert difference(df, con, SQL[name]) is None


def test_entry_runs(spark):
    df = registry.entry(spark)
    assert df.columns == ["agri_code", "c_length", "n", "first_year"] and df.count() > 0
