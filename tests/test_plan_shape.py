"""What the physical plans may and may not contain."""

import os

import pytest

from conftest import final_plan
from scenaria.workload.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="TESTDATA not present")

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    text = plan_of(QUERIES["generation_share"].plan(spark, SF_DIR))
    assert "l_extendedprice" not in text and "l_comment" not in text and "s_suppkey" not in text


def test_year_selection_reaches_the_scan(spark):
    text = plan_of(QUERIES["canonical_flow"].plan(spark, SF_DIR))
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_shipdate" in text


def test_scenario_filter_reaches_the_orders_scan(spark):
    text = plan_of(QUERIES["annual_panel_given_bins"].plan(spark, SF_DIR))
    assert "In(o_orderpriority" in text


def test_completion_reads_the_facts_once(spark):
    df = QUERIES["flow_heatmap"].plan(spark, SF_DIR)
    df.collect()
    assert final_plan(df).count("FileScan parquet [l_orderkey") == 1


def test_hourly_panel_reads_the_events_once(spark):
    df = QUERIES["hourly_balance_dense"].plan(spark, SF_DIR)
    df.collect()
    assert final_plan(df).count("FileScan parquet [ts") == 1


@pytest.mark.parametrize(
    "name,scan,times",
    [
        ("daily_balance", "FileScan parquet [ts", 1),
        ("daily_dated_view", "FileScan parquet [ts", 1),
        ("daily_view_trade_hidden", "FileScan parquet [ts", 1),
        ("hour_window_view", "FileScan parquet [ts", 1),
        ("dispatch_hourly_scenario", "FileScan parquet [ts", 1),
        ("window_with_overlay", "FileScan parquet [ts", 2),
        ("cost_pct_gdp", "FileScan parquet [l_orderkey", 1),
        ("cost_per_decade", "FileScan parquet [l_orderkey", 1),
        ("right_join_fill", "FileScan parquet [l_orderkey", 1),
        ("node_flow_with_losses", "FileScan parquet [l_orderkey", 1),
        ("generation_share", "FileScan parquet [l_orderkey", 1),
        ("price_curve_every_line", "FileScan parquet [l_orderkey", 1),
    ],
)
def test_facts_are_read_once(spark, name, scan, times):
    df = QUERIES[name].plan(spark, SF_DIR)
    df.collect()
    assert final_plan(df).count(scan) == times


def test_shares_need_no_window(spark):
    df = QUERIES["generation_share"].plan(spark, SF_DIR)
    df.collect()
    assert "Window" not in final_plan(df)


def test_large_joins_do_not_depend_on_broadcast(spark):
    """With broadcasting off the plans still are equi-joins on shuffled keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("generation_mix", "net_trade", "weighted_price_totals", "trade_vs_demand", "right_join_fill"):
            text = plan_of(QUERIES[name].plan(spark, SF_DIR))
            assert "SortMergeJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
