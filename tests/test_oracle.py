"""Every registered query against its SQL twin, and a look at its plan."""

from __future__ import annotations

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from dealgrid.plans import catalog  # noqa: E402
from dealgrid.plans.views import BASE_TABLES  # noqa: E402
from tools.check import compare  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables on this machine")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for table in BASE_TABLES:
        c.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name in catalog.ORACLES:
        message, _ = compare(df, con, catalog.ORACLES[name])
        assert not message
    else:
        assert df.count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
