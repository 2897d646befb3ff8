"""Every query of the library against its SQL, and what its plan must not hold."""

import re

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from driftmap.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: The syntax reader and the scan of file trees are Python.
PYTHON = ("fct", "prj6", "prj7", "agg4", "agg6", "agg7", "agg10", "src1_")
WRITES = ("str", "src9", "src10", "src12", "src13", "src14", "src16", "ing13", "ing14_bucketed")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same, note = compare(df, con, ORACLES[name])
        assert same, note
    else:
        assert df.count() > 0
    if not name.startswith(WRITES):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("NestedLoopJoin|CartesianProduct|BatchEvalPython|ArrowEvalPython", plan)
        assert "MapInArrow" not in plan or name.startswith(PYTHON)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["change_id", "diagram_id", "affected", "total", "impact_pct", "impact_level"]
    assert df.count() > 0
