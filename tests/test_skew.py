"""Hot keys: a third of all rows share one order, part, supplier, customer or user.

Results must not change, and with broadcasting off Spark must be able to split
the hot partitions of the large joins.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402
from conftest import final_plan  # noqa: E402
from scenaria.workload.catalog import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="TESTDATA not present")

HOT = {
    "lineitem": "SELECT * REPLACE (CASE WHEN l_quantity <= 17 THEN 1 ELSE l_orderkey END AS l_orderkey,"
    " CASE WHEN l_linenumber <= 2 THEN 1 ELSE l_partkey END AS l_partkey,"
    " CASE WHEN l_linenumber >= 6 THEN 1 ELSE l_suppkey END AS l_suppkey)",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE o_custkey END AS o_custkey)",
    "events": "SELECT * REPLACE (CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE user_id END AS user_id)",
}
CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000",
    "spark.sql.shuffle.partitions": "16",
    # several map tasks: a hot partition is split along the map outputs
    "spark.sql.files.maxPartitionBytes": "150000",
}
CHECKED = [
    "generation_share",
    "net_trade",
    "hourly_balance_dense",
    "weighted_price_totals",
    "link_cost_split",
    "gdp_discounted",
    "price_curve_every_line",
]


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    out = tmp_path_factory.mktemp("hot")
    for t in check_oracle.TABLES:
        select = HOT.get(t, "SELECT *")
        duckdb.sql(f"COPY ({select} FROM '{SF_DIR}/{t}.parquet') TO '{out}/{t}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 8000)")
    return str(out)


@pytest.fixture(scope="module")
def hot_spark(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", CHECKED)
def test_results_hold_under_skew(hot_spark, hot_dir, name):
    result = check_oracle.compare(hot_spark, check_oracle.connect(hot_dir), name, hot_dir)
    assert result.startswith("ok"), result


def test_hot_join_partitions_are_split(hot_spark, hot_dir):
    df = QUERIES["generation_mix"].plan(hot_spark, hot_dir)
    df.collect()
    assert "skew=true" in final_plan(df)


def test_rank_spreads_a_hot_group(hot_spark, hot_dir):
    """No bin of the ranking may hold much of the hot group."""
    from scenaria.operators.rank import binned_rows
    from scenaria.workload import emulate as em

    rows = em.lines(hot_spark, hot_dir).select("Sc", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    binned = binned_rows(rows, ["Sc"], "l_extendedprice", ["l_partkey"], 500)
    bins = [r["count"] for r in binned.groupBy("Sc", "__b1", "__b2").count().collect()]
    groups = [r["count"] for r in rows.groupBy("Sc").count().collect()]
    assert max(groups) > sum(groups) / 3
    assert max(bins) < max(groups) / 20


def pieces_of(df, keys, order, target):
    """Rows in the largest piece of a cut."""
    from scenaria.operators.rank import BINS_OF, cut_rows

    return max(r["count"] for r in cut_rows(df, keys, order, target).groupBy(*keys, *BINS_OF).count().collect())


@pytest.mark.parametrize(
    "tie",
    [
        "concat('customer#', lpad(id, 9, '0'))",
        "concat(repeat('é', 200), id)",
        "date_add(date'2000-01-01', cast(id as int))",
        "timestamp_seconds(id)",
        "timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)",
        "cast(id as decimal(20, 3))",
        "encode(concat('x', lpad(id, 9, '0')), 'utf-8')",
    ],
)
def test_a_run_of_equal_values_is_cut_by_its_tie(spark, tie):
    """One value throughout a group, told apart by the tie column alone, of any type."""
    from scenaria import operators as op

    df = spark.range(20_000).selectExpr("1 AS g", "cast(7 AS double) AS v", f"{tie} AS tie", "id")
    assert pieces_of(df, ["g"], [("v", True), ("tie", False)], 500) < 1000
    some = df.sample(0.1, 3).union(df.limit(3).selectExpr("g", "v", "null AS tie", "-1 AS id"))
    got, want = (sorted(map(tuple, f(some, ["g"], "v", ["tie", "id"], **how).collect()), key=str) for f, how in ((op.rank_rows, {"target": 100}), (op.duration_curve, {})))
    assert got == want


def test_a_share_has_no_hot_task(hot_spark, hot_dir):
    df = QUERIES["generation_share"].plan(hot_spark, hot_dir)
    df.collect()
    assert "Window" not in final_plan(df)


def hot_series(spark):
    """One group of 60,000 steps with long gaps, some small ones, one without any value."""
    big = spark.range(60_000).selectExpr("'big' AS g", "concat('D', lpad(id * 3, 9, '0')) AS t", "if(id % 997 = 5 or id between 20000 and 20010, cast(id as double), null) AS v")
    small = spark.range(40).selectExpr("concat('s', id % 3) AS g", "concat('D', lpad(id, 9, '0')) AS t", "if(id % 7 = 3 and id % 3 < 2, cast(id as double), null) AS v")
    rest = spark.range(9).selectExpr("cast(null as string) AS g", "concat('D', lpad(id, 9, '0')) AS t", "if(id = 4, 1.5D, null) AS v")
    return big.union(small).union(rest)


@pytest.mark.parametrize("name", ["carry_backward", "interpolate"])
def test_fills_across_pieces_equal_the_window(spark, name):
    from scenaria import operators as op

    df, fill = hot_series(spark), getattr(op, name)
    assert pieces_of(df, ["g"], [("t", False)], 1000) <= 1100
    want = {(r.g, r.t): r.v for r in fill(df, ["g"], "t", "v").collect()}
    got = fill(df, ["g"], "t", "v", target=1000)
    assert got.columns == df.columns
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.g, r.t]
        assert r.v == w or abs(r.v - w) < 1e-6, (r, w)
