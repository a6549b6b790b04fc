"""Every registered query against its DuckDB twin on the smallest data set;
no plan may pair rows without a key or leave the JVM."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402
from scenaria.workload.catalog import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="TESTDATA not present")


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF_DIR)


BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas")


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name].plan(spark, SF_DIR)
    result = check_oracle.compare(spark, con, name, SF_DIR, df)
    assert result.startswith("ok") and "TYPES" not in result, result
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BANNED if b in plan]
